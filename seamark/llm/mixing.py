"""Mixing sources to target shares of the total size (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.tokens import TOKENIZER, with_token_counts
from seamark.session import cut

#: Most sources that may have a target; the table of targets is gathered after it was counted.
MAX_SOURCES = 10_000


def source_name(c: Column) -> Column:
    """Source names count as the same whatever their letter case, outer spaces and ``-`` or ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def read_targets(targets: DataFrame) -> dict[str, tuple[Fraction, int]]:
    """Source -> (share, most uses of a text). Shares are scaled to add up to 1; null and non-positive ones count as 0."""
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    share = {r["source"]: Fraction(str(max(0.0, r["target_share"] or 0.0))) for r in rows}
    total = sum(share.values()) or Fraction(1)
    return {r["source"]: (share[r["source"]] / total, max(0, r["max_repeats"] or 0)) for r in rows}


def budgets(sizes: dict[str, int], targets: dict[str, tuple[Fraction, int]]) -> dict[str, tuple[int, int]]:
    """Source -> (full epochs, tokens of the last, partial epoch) of the largest mix that keeps every share.

    The total is bounded by the source that runs out first at its most repeats. Sources without text,
    share or repeats are left out, and the shares of the others keep their proportions.
    """
    live = {s: t for s, t in targets.items() if sizes.get(s) and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in live.values()) or Fraction(1)
    total = min((sizes[s] * most / (share / whole) for s, (share, most) in live.items()), default=Fraction(0))
    out = {}
    for s, (share, _most) in live.items():
        tokens = int(total * share / whole)
        out[s] = divmod(tokens, sizes[s])
    return out


def shuffled_texts(docs: DataFrame, targets: dict[str, tuple[Fraction, int]], seed: int = 13, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens, key, pid``: one document a text, range-partitioned by source and hash-random key, cut from lineage.

    Equal texts count as one, under the smallest doc_id: otherwise a text could be used more often
    than its source allows. Texts of sources without a target, of no source and of no tokens are left out.
    """
    named = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter(F.col("source").isin(*targets) if targets else F.lit(False))
    texts = (
        with_token_counts(named, path=tokenizer)
        .filter("n_tokens > 0")
        .groupBy("text_hash")
        .agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("m"))
        .select("m.*")
        .withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "key", "doc_id"]
    return cut(texts.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 13, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens, uses``: how often each text is used in the mix. Unused texts give no rows.

    Each source's texts are range-sorted by a hash-random key; sums per partition and source give
    every partition its offset, and one pass over the sorted partitions adds up token counts. A text
    is used once per full epoch, and once more if the middle of its span of the running total lies
    within the budget of the last epoch, so a source misses its budget by less than one text. The
    driver holds a sum per partition and source, whatever the number of texts.
    """
    want = read_targets(targets)
    texts = shuffled_texts(docs, want, seed, tokenizer)
    sums = texts.groupBy("pid", "source").agg(F.sum("n_tokens").alias("n")).collect()
    sizes: dict[str, int] = {}
    offsets: dict[tuple[int, str], int] = {}
    for r in sorted(sums, key=lambda r: (r["source"], r["pid"])):
        offsets[r["pid"], r["source"]] = sizes.get(r["source"], 0)
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["n"]
    plan = budgets(sizes, want)
    most = {s: m for s, (_, m) in want.items()}

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, run = TaskContext.get().partitionId(), {}
        for b in batches:
            uses = []
            for source, n in zip(b["source"], b["n_tokens"], strict=True):
                before = run.get(source, offsets.get((pid, source), 0))
                run[source] = before + n
                epochs, rest = plan.get(source, (0, 0))
                uses.append(min(most[source], epochs + (2 * before + n <= 2 * rest)))
            b["uses"] = uses
            yield b[b["uses"] > 0][["doc_id", "source", "n_tokens", "uses"]]

    named = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "n_tokens")
    return named.mapInPandas(used, "doc_id string, source string, n_tokens long, uses int").withColumn("doc_id", F.col("doc_id").cast("long"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, texts, tokens, share, most_uses``: the shares reached, sources without text included."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    both = want.join(got, "source", "left").select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("texts", "tokens", "most_uses")))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # at most MAX_SOURCES rows
    return both.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
