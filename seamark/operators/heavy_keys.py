"""Link and page figures per site and per target although a few keys hold most entries (problem 2)."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.page_key import key_host, page_key
from seamark.plans.skew import tree_aggregate
from seamark.session import cut

#: Shares from which a site or a target is hot.
SITE_SHARE, TARGET_SHARE = 0.03, 0.005


def target_figures(pages: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row a target's page key: ``target_key, entries, main_entries, first_day, last_day``.

    Counts every entry of ``internal_link_urls`` in every row, copies included; null entries in a
    list are no entries, entries with a null or blank target have the empty key. Spellings are
    combined as written before keys are computed, so each spelling is parsed once per chunk.
    """
    links = pages.select("crawl_day", F.explode("internal_link_urls").alias("e")).filter(F.col("e").isNotNull())
    spellings = tree_aggregate(
        links.select("crawl_day", F.col("e.target").alias("target"), F.col("e.placement").alias("placement")),
        ["target"],
        sums={"entries": F.lit(1).cast("long"), "main_entries": (F.coalesce(F.col("placement"), F.lit("")) == "main").cast("long")},
        mins={"first_day": F.col("crawl_day")},
        maxs={"last_day": F.col("crawl_day")},
        fan_in=fan_in,
    )
    # a hot page has many spellings, whose states come from all chunks again: they are merged by a tree too
    return tree_aggregate(
        cut(spellings).select(page_key(F.col("target")).alias("target_key"), "entries", "main_entries", "first_day", "last_day"),
        ["target_key"],
        sums={"entries": F.col("entries"), "main_entries": F.col("main_entries")},
        mins={"first_day": F.col("first_day")},
        maxs={"last_day": F.col("last_day")},
        fan_in=fan_in,
    )


def site_figures(targets: DataFrame, pages: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row a host: ``site, entries, main_entries, targets, page_rows, word_count``, from target_figures and the page rows."""
    linked = tree_aggregate(
        targets.withColumn("site", key_host(F.col("target_key"))),
        ["site"],
        sums={"entries": F.col("entries"), "main_entries": F.col("main_entries"), "targets": F.lit(1).cast("long")},
        fan_in=fan_in,
    )
    own = tree_aggregate(
        pages.select(key_host(page_key(F.col("url"))).alias("site"), "word_count"),
        ["site"],
        sums={"page_rows": F.lit(1).cast("long"), "word_count": F.coalesce(F.col("word_count"), F.lit(0)).cast("long")},
        fan_in=fan_in,
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "main_entries", "targets", "page_rows", "word_count")]
    return linked.join(own, "site", "full_outer").select("site", *zero)


def _least(share: float, total: int) -> int:
    """Fewest entries that are at least that share of the total, in exact numbers."""
    return math.ceil(Fraction(str(share)) * total)


def hot_keys(pages: DataFrame, site_share: float = SITE_SHARE, target_share: float = TARGET_SHARE, fan_in: int = 16) -> DataFrame:
    """``key_kind, hot_key``: hosts with at least ``site_share`` and page keys with at least ``target_share`` of all link entries."""
    targets = cut(target_figures(pages, fan_in))
    total = targets.agg(F.sum("entries")).first()[0] or 0
    sites = tree_aggregate(targets.withColumn("site", key_host(F.col("target_key"))), ["site"], sums={"entries": F.col("entries")}, fan_in=fan_in)
    return (
        sites.filter(F.col("entries") >= _least(site_share, total))
        .select(F.lit("site").alias("key_kind"), F.col("site").alias("hot_key"))
        .unionByName(
            targets.filter(F.col("entries") >= _least(target_share, total)).select(F.lit("target").alias("key_kind"), F.col("target_key").alias("hot_key"))
        )
    )
