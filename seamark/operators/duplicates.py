"""Near-duplicate texts: an exact set-similarity join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions import text
from seamark.plans.skew import BROADCAST_ROWS, lookup_join
from seamark.session import cut, cut_table, shuffles_removed

#: Words of a shingle, least words of a text, least similarity.
WORDS, LEAST_WORDS, SIMILARITY = 5, 20, 0.8
#: Groups of shingles whose frequency orders them, words of parity bits of a set, rounds of the join; powers of two. None changes a result.
LOADS, BITS, PARTS = 1 << 18, 4, 8
#: Ids that are broadcast at once, counted before: a number each.
IDS = 1_000_000
#: Pairs, counted before, whose whole sets are joined at once.
PAIRS = 100_000
_BITS = [f"b{w}" for w in range(BITS)]


def eligible(url: Column, canonical: Column, indexable: Column) -> Column:
    """Pages whose text is compared: no other canonical (by spelling), not marked noindex."""
    return ((F.coalesce(canonical, F.lit("")) == "") | (canonical == url)) & F.coalesce(indexable, F.lit(True))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of words' hashes, the last column, as sorted lists of the hashes of their different shingles."""
    for batch in batches:
        at, w, n = _flat(batch.columns[-1])
        m = np.maximum(0, n - WORDS + 1)
        starts = max(0, len(w) - WORDS + 1)
        s = np.zeros(starts, np.uint64)
        for k in range(WORDS):  # the 64-bit mixer of splitmix, word after word
            s = (s ^ w[k : k + starts].view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                s = (s ^ (s >> np.uint64(shift))) * np.uint64(by)
            s ^= s >> np.uint64(31)
        text_of = np.repeat(np.arange(len(n)), n)
        within = text_of[:starts] == text_of[len(text_of) - starts :]
        s, text_of = s[within].view(np.int64), text_of[:starts][within]
        ends = np.cumsum(m)
        for i, j in zip(ends - m, ends, strict=True):
            s[i:j].sort()
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (text_of[1:] != text_of[:-1])
        lists = _lists(np.bincount(text_of[fresh], minlength=len(n)), s[fresh])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "shingles"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lists begin and end among all elements, these, and the lists' lengths."""
    at = lists.offsets.to_numpy()
    return at - at[0], lists.values.to_numpy()[at[0] : at[-1]], np.diff(at)


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS, common_only: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, shingles``, and the columns ``keep``: sorted 64-bit hashes of the different shingles of each text of at least ``least_words`` content words.

    With ``common_only``, words that occur in one text only are dropped before shingles are formed, so
    that gaps close; a text left with fewer words than a shingle has has an empty set. Words are written once, as hashes, which
    repeat and so are smaller than their texts; sets, which are larger, are made from them whenever they are read.
    """
    with shuffles_removed(docs.sparkSession):
        # a list of none or one, taken apart: words are made once, for the filter and for their hashes
        held = F.filter(F.array(text.content_tokens(F.col(text_col))), lambda w: F.size(w) >= least_words)
        held = docs.select(F.col(id_col).alias("id"), *keep, F.explode(held).alias("w"))
        words = cut_table(held.select("id", *keep, F.transform("w", lambda t: F.xxhash64(t)).alias("w")), "zstd")
        if common_only:
            seen = words.select("id", F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max("id").alias("id"))
            # a word of one text belongs to that text only: one small list a text that has any
            gone = cut_table(seen.filter("df = 1").groupBy("id").agg(F.collect_list("t").alias("gone")))
            if rows := gone.count():
                left = words.join(F.broadcast(gone) if rows <= BROADCAST_ROWS else gone, "id", "left")
                left = left.select("id", *keep, F.when(F.col("gone").isNull(), F.col("w")).otherwise(F.filter("w", lambda t: ~F.array_contains("gone", t))).alias("w"))
                words = left if rows <= BROADCAST_ROWS else cut_table(left, "zstd")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields[:-1])
    return words.mapInArrow(_runs, f"{kinds}, shingles array<bigint>")


def _keys() -> list[Column]:
    """128 bits for a whole set, in place of the set, to group and join by."""
    return [F.xxhash64("shingles").alias("k1"), F.xxhash64(F.lit("set"), "shingles").alias("k2")]


def classes(sets: DataFrame) -> DataFrame:
    """``class_id, copies, shingles``: texts with equal shingle sets as one, under the smallest id."""
    return sets.filter(F.size("shingles") > 0).groupBy(*_keys()).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles")).drop("k1", "k2")


def _loads(sets: DataFrame) -> np.ndarray:
    """For each of ``LOADS`` groups of shingles, by hash, four times the logarithm of how often all texts hold one of it."""
    load = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(LOADS - 1).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("c")).toArrow()
    out = np.zeros(LOADS, np.int64)
    out[load["g"].to_numpy()] = np.minimum(127, 4 * np.log2(load["c"].to_numpy()))
    return out


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``id, k1, k2, n, bits, prefix``: of each set the size, a parity bit a group of hashes, and the first of its shingles, rare ones before frequent ones, each as a number that tells its place in that order."""
    loads = _loads(sets)

    def rows(batches):
        for batch in batches:
            at, s, n = _flat(batch.column("shingles"))
            order = (loads[s & (LOADS - 1)] << 56) | (s >> 8 & (1 << 56) - 1)
            keep = (n - np.ceil(n * similarity - 1e-9) + 1).astype(np.int64)
            for i, j in zip(at[:-1], at[1:], strict=True):
                order[i:j].sort()
            first = np.arange(len(s)) - np.repeat(at[:-1], n) < np.repeat(keep, n)
            bit, word = np.uint64(1) << (s >> 32 & 63).astype(np.uint64), s >> 38 & (BITS - 1)
            bits = [np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), at[:-1]).view(np.int64) if len(n) else np.zeros(0, np.int64) for w in range(BITS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "k1", "k2")), pa.array(n, pa.int32()), *map(pa.array, bits), _lists(keep, order[first])], names=["id", "k1", "k2", "n", *_BITS, "prefix"])

    kind = sets.schema["id"].dataType.simpleString()
    held = sets.filter(F.size("shingles") > 0).select("id", *_keys(), "shingles")
    return held.mapInArrow(rows, f"id {kind}, k1 bigint, k2 bigint, n int, {', '.join(f'{b} bigint' for b in _BITS)}, prefix array<bigint>")


def _candidates(reps: DataFrame, similarity: float, part: int) -> DataFrame:
    """``class_a, class_b, na, nb, c, ia, ib``: texts that share ``c`` shingles of their prefixes, the last at places ``ia`` and ``ib``, of one part in ``PARTS`` of the shingles, and that sizes and bits don't rule out."""
    prefix = reps.select("class_id", "n", *_BITS, F.posexplode("prefix").alias("i", "s")).filter(F.pmod("s", F.lit(PARTS)) == part)
    a, b = (prefix.select("s", *(F.col(c).alias(c + x) for c in ("class_id", "n", "i", *_BITS))) for x in "ab")
    na, nb = F.col("na"), F.col("nb")
    sizes = (na * similarity <= nb + 1e-9) & (nb * similarity <= na + 1e-9)
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(w + "a").bitwiseXOR(F.col(w + "b"))) for w in _BITS))
    alike = apart <= (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-9
    pairs = a.join(b, (a["s"] == b["s"]) & (F.col("class_ida") < F.col("class_idb")) & sizes & alike)
    return pairs.groupBy(F.col("class_ida").alias("class_a"), F.col("class_idb").alias("class_b"), "na", "nb").agg(F.count(F.lit(1)).alias("c"), (F.max("ia") + 1).alias("ia"), (F.max("ib") + 1).alias("ib"))


def _possible(similarity: float) -> Column:
    """Whether two sets, of ``na`` and ``nb`` shingles, can be similar enough, by what their prefixes share in all.

    The prefix that ends first is known in full: of it, all but ``c`` are not in the other set. Up to the last shingle that is shared, both are.
    """
    na, nb, c, ia, ib = (F.col(x) for x in ("na", "nb", "c", "ia", "ib"))
    prefix = lambda n: n - F.ceil(n * similarity - 1e-9) + 1
    least = F.ceil((na + nb) * (similarity / (1 + similarity)) - 1e-9) - F.ceil(F.greatest(na, nb) * similarity - 1e-9) + 1
    apart = ia + ib - 2 * c + F.least(prefix(na) - ia, prefix(nb) - ib)
    return (c >= least) & (apart <= (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def _verified(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """``class_a, class_b, similarity`` of those of at most some ``PAIRS`` pairs that are similar enough."""

    def side(x):
        ids = F.broadcast(pairs.select(F.col("class_" + x).alias("class_id")).distinct())
        return whole.join(ids, "class_id", "left_semi").select(F.col("class_id").alias("class_" + x), F.col("shingles").alias("s" + x))

    inter = F.size(F.array_intersect("sa", "sb"))
    ratio = inter / (F.size("sa") + F.size("sb") - inter)
    return pairs.join(side("a"), "class_a").join(side("b"), "class_b").select("class_a", "class_b", ratio.alias("r")).filter(F.col("r") >= similarity).select("class_a", "class_b", F.round("r", 4).alias("similarity"))


def similar_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``class_a, class_b, similarity`` of every two different texts whose Jaccard similarity is at least ``similarity``.

    Exact, by prefix filtering: in any one order of shingles, two texts that are similar enough share
    one of the first ``n - ceil(similarity * n) + 1`` of either. The order is by how often shingles of the
    same group of hashes are held, so that mostly rare ones are joined on, in ``PARTS`` rounds, with bounds on sizes
    and on differing parity bits as join conditions, and on how many are shared in all. Candidates are then verified on the
    whole sets, which are made again for them only. Equal texts are joined once, as a class. ``sets`` is read three times.
    """
    with shuffles_removed(sets.sparkSession):
        same = [F.min("id").alias("class_id"), *(F.first(c).alias(c) for c in ("n", *_BITS, "prefix"))]
        reps = cut_table(_prefixes(sets, similarity).groupBy("k1", "k2").agg(*same).drop("k1", "k2"))
        found = reduce(DataFrame.unionByName, [cut_table(_candidates(reps, similarity, part)) for part in range(PARTS)])
        pairs = cut_table(found.groupBy("class_a", "class_b", "na", "nb").agg(F.sum("c").alias("c"), F.max("ia").alias("ia"), F.max("ib").alias("ib")).filter(_possible(similarity)).select("class_a", "class_b").distinct())
        ends = cut_table(pairs.select(F.explode(F.array("class_a", "class_b")).alias("id")).distinct())
        rounds = ends.count() // IDS + 1
        some = [ends.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r) for r in range(rounds)]
        whole = reduce(DataFrame.unionByName, [cut_table(classes(sets.join(F.broadcast(part), "id", "left_semi"))) for part in some])
        rounds = pairs.count() // PAIRS + 1
        some = [pairs.filter(F.pmod(F.xxhash64("class_a", "class_b"), F.lit(rounds)) == r) for r in range(rounds)]
        return reduce(DataFrame.unionByName, [cut_table(_verified(part, whole, similarity)) for part in some])


def _keyed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``membership`` of rows ``id, k1, k2``, which are read twice."""
    named = sets.groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    linked = named.join(ends, "class_id", "left").select("k1", "k2", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return sets.join(linked, ["k1", "k2"]).select("id", "class_id", "copies", "links")


def membership(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, class_id, copies, links``: each text's class, its size, and how many other classes are similar to it."""
    return _keyed(cut_table(sets.filter(F.size("shingles") > 0).select("id", *_keys())), pairs)


def document_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, class_id, copies, links`` of every text, however short: texts with equal shingle sets are one class.

    Texts without shingles (too few common words in ASCII letters) are classed by their whole text, apart from case and
    white space, and have no links; null is an empty text.
    """
    whole = F.sha2(text.squeeze(F.lower(F.coalesce(F.col(text_col), F.lit("")))), 256)
    sets = shingle_sets(docs.select(id_col, text_col, whole.alias("whole")), id_col, text_col, least_words=0, keep=("whole",))
    pairs = similar_pairs(sets.select("id", "shingles"))
    keyed = cut_table(sets.select("id", *_keys(), F.when(F.size("shingles") == 0, F.col("whole")).alias("whole")))
    bare = keyed.filter("whole IS NOT NULL").select("id", "whole")
    alike = cut(bare.groupBy("whole").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")))
    rest = lookup_join(bare, alike, ["whole"]).select("id", "class_id", "copies", F.lit(0).cast("long").alias("links"))
    return _keyed(keyed.filter("whole IS NULL").select("id", "k1", "k2"), pairs).unionByName(rest)


def shared_phrase(a: Column, b: Column) -> Column:
    """The first shingle, in order of text, that two texts share; null if none."""
    return F.array_min(F.array_intersect(text.shingles(text.content_tokens(a)), text.shingles(text.content_tokens(b))))


def shared_sentences(a: Column, b: Column, least: int = 4) -> Column:
    """Sentences of ``a`` with at least ``least`` content words that ``b`` has too."""
    theirs = text.content_tokens(b)
    return F.filter(F.split(a, r"(?<=[.!?])\s+"), lambda s: F.size(F.array_intersect(F.array_distinct(text.content_tokens(s)), theirs)) >= least)
