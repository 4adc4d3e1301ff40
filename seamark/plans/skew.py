"""Joins and aggregations that stay balanced when one key holds much of the data."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that may be broadcast after they were counted.
BROADCAST_ROWS = 100_000
#: Most keys treated as hot at once; bounds what the hot branch of a join broadcasts.
HOT_KEYS = 10_000
#: Rows from which a key can be hot; below, one task takes a key easily.
HOT_ROWS = 100_000


def hot_split_join(big: DataFrame, resolved: DataFrame, keys: list[str], count_col: str, hot_keys: int = HOT_KEYS, hot_rows: int = HOT_ROWS, keep: Column | None = None) -> DataFrame:
    """Inner join of ``big`` with ``resolved``, which is unique on ``keys`` and counts ``big``'s rows per key.

    Keys that hold more than ``max(hot_rows, total / hot_keys)`` rows number at most ``hot_keys``:
    they are broadcast, so that their rows of ``big`` are joined where they lie. All others are
    joined by a shuffle. ``resolved`` is read several times: pass a table cut from its lineage.
    ``resolved`` must hold every key that may be hot, wanted or not; ``keep`` tells which of its rows are wanted. Null
    keys equal each other.
    """
    total = resolved.agg(F.sum(count_col)).first()[0] or 0
    limit = max(hot_rows, total // hot_keys)
    named = {k: f"_{k}_" for k in keys}

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed(named)
        same = reduce(lambda x, y: x & y, (left[k].eqNullSafe(right[named[k]]) for k in keys))
        return left.join(right, same, how).drop(*named.values())

    hot, cold = resolved.filter(F.col(count_col) > limit), resolved.filter(~(F.col(count_col) > limit))
    wanted = (lambda df: df) if keep is None else (lambda df: df.filter(keep))
    if hot.isEmpty():
        return joined(big, wanted(resolved), "inner")
    rest = joined(big, F.broadcast(hot.select(*keys)), "left_anti")
    return joined(big, F.broadcast(wanted(hot)), "inner").unionByName(joined(rest, wanted(cold), "inner"))


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join ``big`` with ``small``, unique on ``keys``: broadcast if ``small`` was counted to hold at most
    ``rows`` rows, else by a shuffle in which each key is spread over ``salts`` tasks.

    ``how`` is inner, left, left_semi or left_anti. ``small`` is read twice: pass a table cut from its lineage.
    """
    if small.count() <= rows:
        return big.join(F.broadcast(small), keys, how)
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    fan_in: int = 16,
) -> DataFrame:
    """Per-key sums, minima and maxima by multi-level tree aggregation.

    Each input chunk (a scan split, of fixed size by ``spark.sql.files.maxPartitionBytes``, or an
    upstream partition) is combined locally. The partial states of at most ``fan_in`` neighbouring
    chunks are then merged per key, round after round, so that the number of chunks falls by
    ``fan_in`` each time: after ``ceil(log(chunks, fan_in))`` rounds one state a key is left. No task
    ever receives the partial states of a key from all chunks, however many rows the key holds.
    Keys may be null (a group of their own); an empty input gives no rows.
    """
    sums, mins, maxs = sums or {}, mins or {}, maxs or {}
    chunks = max(1, df.rdd.getNumPartitions())
    state = df.select(
        *keys,
        *(c.alias(n) for part in (sums, mins, maxs) for n, c in part.items()),
        F.spark_partition_id().alias("_chunk"),
    )
    merge = [*(F.sum(n).alias(n) for n in sums), *(F.min(n).alias(n) for n in mins), *(F.max(n).alias(n) for n in maxs)]
    for _ in range(max(0, math.ceil(math.log(chunks, fan_in) - 1e-9) - 1)):
        state = state.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("int")).groupBy(*keys, "_chunk").agg(*merge)
    return state.groupBy(*keys).agg(*merge)
