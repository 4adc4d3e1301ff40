"""Seamark: site-audit analytics and corpus preparation, declared as Spark DataFrame plans."""

__version__ = "0.1.0"
