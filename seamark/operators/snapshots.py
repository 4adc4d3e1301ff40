"""What changed between consecutive full snapshots (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions.page_key import key_host, page_key
from seamark.plans.skew import lookup_join
from seamark.session import cut


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, outer ones dropped; null as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), r"^ | $", "")


def page_states(snaps: DataFrame) -> DataFrame:
    """``site, snap_no, page_key, state``: of each page in each snapshot the row delivered last, as a hash of what counts.

    Rows with a null delivery count as delivered first; of rows delivered at the same moment the one
    with the larger hash stands, so the result does not depend on row order. Rows without a snapshot
    number or site belong to no snapshot.
    """
    key = page_key(F.col("url"))
    rows = snaps.filter(F.col("site").isNotNull() & F.col("snap_no").isNotNull()).select("site", "snap_no", key.alias("page_key"), "delivered_at", "status_code", "title", "canonical")
    state = F.xxhash64(F.coalesce(F.col("status_code").cast("string"), F.lit("")), squeezed(F.col("title")), page_key(F.col("canonical"), key_host(F.col("page_key"))))
    return (
        rows.withColumn("state", state)
        .groupBy("site", "snap_no", "page_key")
        .agg(F.max(F.struct("delivered_at", "state")).alias("m"))
        .select("site", "snap_no", "page_key", F.col("m.state").alias("state"))
    )


def snapshot_order(snaps: DataFrame) -> DataFrame:
    """``site, snap_no, idx, next_snap``: the snapshots a site has, numbered without gaps. One row a snapshot."""
    w = Window.partitionBy("site").orderBy("snap_no")
    return (
        snaps.filter(F.col("site").isNotNull() & F.col("snap_no").isNotNull()).groupBy("site", "snap_no").agg(F.lit(1).alias("_one")).drop("_one")
        .select("site", "snap_no", F.row_number().over(w).alias("idx"), F.lead("snap_no").over(w).alias("next_snap"))
    )


def snapshot_changes(snaps: DataFrame) -> DataFrame:
    """``site, snap_no, page_key, change_kind`` for every snapshot but a site's first.

    Each page's snapshots are lined up by snapshot index: a lagged hash that differs is a change, a
    gap in the index is a removal and a later addition. Windows are per page, so no site, however
    large, is gathered in one task. A site with one snapshot and an empty table give no rows.
    """
    order = cut(snapshot_order(snaps))
    rows = lookup_join(page_states(snaps), order, ["site", "snap_no"])
    w = Window.partitionBy("site", "page_key").orderBy("idx")
    seen = rows.select(
        "site", "snap_no", "page_key", "idx", "next_snap", "state",
        F.lag("idx").over(w).alias("before"), F.lag("state").over(w).alias("old_state"), F.lead("idx").over(w).alias("after"),
    )
    here = F.when((F.col("idx") > 1) & (F.coalesce(F.col("before"), F.lit(0)) < F.col("idx") - 1), F.lit("added")).when(
        (F.col("before") == F.col("idx") - 1) & (F.col("state") != F.col("old_state")), F.lit("changed")
    )
    # the first snapshot's idx is 1, so a page's first row at idx 1 has no change
    gone = F.col("next_snap").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("idx") + 1))
    events = F.array_compact(
        F.array(
            F.when(here.isNotNull(), F.struct(F.col("snap_no").alias("snap_no"), here.alias("change_kind"))),
            F.when(gone, F.struct(F.col("next_snap").alias("snap_no"), F.lit("removed").alias("change_kind"))),
        )
    )
    return seen.select("site", "page_key", F.explode(events).alias("e")).select("site", "e.snap_no", "page_key", "e.change_kind")
