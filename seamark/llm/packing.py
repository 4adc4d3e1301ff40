"""Filling containers of fixed capacity with texts (problem 8)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.mixing import source_name
from seamark.llm.tokens import TOKENIZER, with_token_counts
from seamark.session import cut

#: Tokens packed by one task. A shard leaves at most a few bins badly filled, so larger shards waste less.
SHARD_TOKENS = 4_000_000
#: Containers that a shard should fill at least.
LEAST_BINS = 100
#: Containers filled less than this after the first round are opened again and packed together.
REOPEN = 0.97
#: Most kinds of containers; the table of capacities is gathered after it was counted.
MAX_PACKS = 1_000

PLACED = "pack_name string, container string, doc_id long, piece int, n_tokens long"


def best_fit(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int, forbidden: Sequence[int] = ()) -> tuple[list[int], list[int]]:
    """Bin of each item, and the room left in each bin, by conflict-constrained best fit in decreasing order of size.

    Open bins are kept ordered by residual room. Each carries a bitmap of the sources and one of the
    duplicate clusters it holds. The search begins at the tightest bin with room enough and goes on
    to its successors until a bin is compatible: it holds no member of the item's cluster, and no
    source that ``forbidden[source]`` names. Only then is a bin opened. Cluster -1 conflicts with none.
    A cluster of more members than there must be bins at least is split into parts of that many,
    which conflict within themselves only: else one text with many copies would force empty bins.
    """
    n = len(sizes)
    least = max(1, -(-sum(sizes) // capacity))
    seen: Counter = Counter()
    bit_of: dict[tuple[int, int], int] = {}
    bits = []
    for c in clusters:
        if c < 0:
            bits.append(0)
            continue
        part = (c, seen[c] // least)
        seen[c] += 1
        bits.append(1 << bit_of.setdefault(part, len(bit_of)))
    # clusters that need a large part of the bins are spread first, as long as all bins have room for them
    wide = [c >= 0 and 4 * min(seen[c], least) >= least for c in clusters]
    order = sorted(range(n), key=lambda i: (not wide[i], -sizes[i], -seen[clusters[i]], i))
    open_bins: list[tuple[int, int]] = []
    room: list[int] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    where = [-1] * n
    for i in order:
        size, bit = sizes[i], bits[i]
        avoid = forbidden[sources[i]] if forbidden else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (held_clusters[b] & bit or held_sources[b] & avoid):
                break
            at += 1
        if at < len(open_bins):
            b = open_bins.pop(at)[1]
        else:
            b = len(room)
            room.append(capacity)
            held_sources.append(0)
            held_clusters.append(0)
        where[i] = b
        room[b] -= size
        held_sources[b] |= 1 << sources[i]
        held_clusters[b] |= bit
        if room[b] > 0:
            insort(open_bins, (room[b], b))
    return where, room


def _packer(prefix: str, forbidden: dict[str, Sequence[str]]):
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        name, shard = key
        items = items.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        names = sorted(set(items["source"]) | set(forbidden) | {s for v in forbidden.values() for s in v})
        number = {s: i for i, s in enumerate(names)}
        masks = [sum(1 << number[s] for s in forbidden.get(a, ())) | sum(1 << number[s] for s in names if a in forbidden.get(s, ())) for a in names] if forbidden else ()
        copies = items["cluster"].map(items["cluster"].value_counts())
        code = pd.factorize(items["cluster"])[0]
        clusters = [int(c) if k > 1 else -1 for c, k in zip(code, copies, strict=True)]
        capacity = int(items["capacity"].iloc[0])
        where, room = best_fit(items["n_tokens"].tolist(), [number[s] for s in items["source"]], clusters, capacity, masks)
        items["container"] = [f"{prefix}{shard}-{b}" for b in where]
        items["room"] = [room[b] for b in where]
        return items[["pack_name", "capacity", "container", "doc_id", "piece", "n_tokens", "source", "cluster", "room"]]

    return pack


def _round(items: DataFrame, prefix: str, shard_tokens: int, least_bins: int, forbidden: dict[str, Sequence[str]], seed: int) -> tuple[DataFrame, bool]:
    """Packs all items shard by shard; also tells whether any pack took more than one shard."""
    totals = items.groupBy("pack_name", "capacity").agg(F.sum("n_tokens").alias("n")).collect()
    shards = {r["pack_name"]: max(1, -(-r["n"] // max(shard_tokens, least_bins * r["capacity"]))) for r in totals}
    if not shards:
        return items.withColumns({"container": F.lit(""), "room": F.lit(0).cast("long")}), False
    count = F.create_map(*(x for k, v in shards.items() for x in (F.lit(k), F.lit(v))))
    keyed = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), count[F.col("pack_name")])).withColumn("doc_id", F.col("doc_id").cast("string"))
    out = keyed.groupBy("pack_name", "shard").applyInPandas(
        _packer(prefix, forbidden), "pack_name string, capacity long, container string, doc_id string, piece int, n_tokens long, source string, cluster long, room long"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))
    return out, max(shards.values()) > 1


def pack(docs: DataFrame, limits: DataFrame, shard_tokens: int = SHARD_TOKENS, least_bins: int = LEAST_BINS, reopen: float = REOPEN, forbidden: dict[str, Sequence[str]] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """PLACED: which container each text lies in, for every row of ``limits`` (pack_name, capacity_tokens).

    A text within the capacity lies whole in one container. A larger one fills containers of its own
    with pieces of exactly the capacity (``piece`` 0, 1, ...), and its last piece is packed like a
    text. Texts of no tokens (null or empty) take no room: their container is null. Two copies of a
    text share a container only where there are more copies than containers. ``forbidden`` names
    sources that may not share a container with a source.

    Texts are spread by hash over shards of about ``shard_tokens`` tokens, and ``least_bins`` containers at least, each packed by one task;
    containers that stay below ``reopen`` of their capacity are emptied and their texts packed again
    together in a second round. All texts are packed, in full; rows of limits without a name or with
    no positive capacity are left out, and of equal names the smallest capacity counts.
    """
    rows = limits.filter("pack_name IS NOT NULL AND capacity_tokens > 0").groupBy("pack_name").agg(F.min("capacity_tokens").cast("long").alias("capacity")).limit(MAX_PACKS + 1).collect()
    if len(rows) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} kinds of containers")
    packs = F.array(*(F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in rows))
    sized = cut(
        with_token_counts(docs.select("doc_id", F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), "text"), path=tokenizer)
        .select("doc_id", "source", "n_tokens", F.xxhash64("text_hash").alias("cluster"))
    )
    if not rows:
        return sized.select(F.lit("").alias("pack_name"), F.lit("").alias("container"), "doc_id", F.lit(0).alias("piece"), "n_tokens").limit(0)
    each = sized.withColumn("p", F.explode(packs)).select("p.*", "doc_id", "source", "cluster", "n_tokens")
    full = F.floor(F.col("n_tokens") / F.col("capacity"))
    whole = (
        each.filter("n_tokens >= capacity")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))))
        .select("pack_name", F.concat(F.lit("f-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("-"), F.col("piece").cast("string")).alias("container"), "doc_id", "piece", F.col("capacity").alias("n_tokens"))
    )
    none = each.filter("n_tokens = 0").select("pack_name", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece"), "n_tokens")
    rest = F.col("n_tokens") % F.col("capacity")
    items = each.filter(rest > 0).select("pack_name", "capacity", "doc_id", "source", "cluster", full.cast("int").alias("piece"), rest.alias("n_tokens"))
    forbidden = forbidden or {}
    first, many = _round(items, "a-", shard_tokens, least_bins, forbidden, 1)
    placed = ["pack_name", "container", "doc_id", "piece", "n_tokens"]
    done = whole.unionByName(none)
    if not many:
        return done.unionByName(first.select(*placed))
    first = cut(first)
    loose = F.col("room") > (1 - reopen) * F.col("capacity")
    again, _ = _round(first.filter(loose).drop("container", "room"), "b-", shard_tokens, least_bins, forbidden, 2)
    return done.unionByName(first.filter(~loose).select(*placed)).unionByName(again.select(*placed))


def fill_report(placed: DataFrame, limits: DataFrame) -> DataFrame:
    """``pack_name, capacity, containers, least_containers, tokens, room, fill, pieces`` of every kind of container."""
    bins = placed.filter("container IS NOT NULL").groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    by = bins.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.sum("pieces").alias("pieces"))
    cap = limits.groupBy("pack_name").agg(F.min("capacity_tokens").cast("long").alias("capacity"))
    return by.join(F.broadcast(cap), "pack_name").select(
        "pack_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "tokens",
        (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("room"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"), "fullest", "pieces",
    )
