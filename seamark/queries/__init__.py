"""The named queries of the core library and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def core_queries() -> dict[str, Query]:
    from seamark.queries import crawl, general, graph

    return {**general.QUERIES, **crawl.QUERIES, **graph.QUERIES}


def core_oracles() -> dict[str, str]:
    from seamark.queries import crawl, general, graph

    return {**general.ORACLES, **crawl.ORACLES, **graph.ORACLES}
