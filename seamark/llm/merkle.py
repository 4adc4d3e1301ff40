"""Duplicates hidden by formatting: bottom-up digests of nested records (problem 7)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from seamark.functions.page_key import key_host, page_key
from seamark.plans.skew import hot_split_join, lookup_join
from seamark.session import cut


def plain_text(c: Column) -> Column:
    """Leaf normaliser for text: lower case, punctuation and runs of white space as one space, outer ones dropped. Null stays apart from empty.

    Words stay apart, and numbers what they are: a sign, point, comma, colon or slash directly before a digit and a per cent sign after one count.
    """
    bare = F.regexp_replace(c, r"(?![\-.,:/](?=[0-9]))(?!(?<=[0-9])%)\p{P}", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", ""))


def normalised(c: Column, dtype: DataType, leaf: Callable[[Column], Column] = plain_text, unordered: bool = False) -> Column:
    """``c`` with every text leaf normalised and, if ``unordered``, every list sorted: the structure that is compared in full."""
    if isinstance(dtype, StructType):
        return F.struct(*(normalised(c.getField(f.name), f.dataType, leaf, unordered).alias(f.name) for f in sorted(dtype.fields, key=lambda f: f.name)))
    if isinstance(dtype, ArrayType):
        out = F.transform(c, lambda x: normalised(x, dtype.elementType, leaf, unordered))
        return F.array_sort(out) if unordered else out
    if isinstance(dtype, MapType):
        entry = F.transform(F.map_entries(c), lambda e: F.struct(normalised(e["key"], dtype.keyType, leaf, unordered).alias("key"), normalised(e["value"], dtype.valueType, leaf, unordered).alias("value")))
        return F.array_sort(entry)
    return leaf(c) if isinstance(dtype, StringType) else c


def merkle_digest(c: Column, dtype: DataType, leaf: Callable[[Column], Column] = plain_text, unordered: bool = False) -> Column:
    """64-bit root digest of a nested value, built bottom-up.

    Leaves are normalised and hashed with their type. Records and maps are unordered nodes: the
    digests of their members (name and value) are sorted before they are hashed, so field order does
    not count. Lists keep their order unless ``unordered``. Null has a digest of its own at any depth.
    """
    null = F.xxhash64(F.lit("null"))
    if isinstance(dtype, StructType):
        parts = [F.xxhash64(F.lit(f.name), merkle_digest(c.getField(f.name), f.dataType, leaf, unordered)) for f in dtype.fields]
        return F.when(c.isNull(), null).otherwise(F.xxhash64(F.lit("{}"), F.array_sort(F.array(*parts))))
    if isinstance(dtype, ArrayType):
        parts = F.transform(c, lambda x: merkle_digest(x, dtype.elementType, leaf, unordered))
        return F.when(c.isNull(), null).otherwise(F.xxhash64(F.lit("[]"), F.array_sort(parts) if unordered else parts))
    if isinstance(dtype, MapType):
        parts = F.transform(F.map_entries(c), lambda e: F.xxhash64(merkle_digest(e["key"], dtype.keyType, leaf, unordered), merkle_digest(e["value"], dtype.valueType, leaf, unordered)))
        return F.when(c.isNull(), null).otherwise(F.xxhash64(F.lit("{}"), F.array_sort(parts)))
    value = leaf(c) if isinstance(dtype, StringType) else c
    return F.when(c.isNull(), null).otherwise(F.xxhash64(F.lit(dtype.simpleString()), value))


def collapse(df: DataFrame, id_col: str, structure: Column, root: Column) -> DataFrame:
    """One row a class of structurally equal records: ``root, structure, keep_id, copies``.

    Records are grouped by root digest and, within it, by the whole normalised structure: that is the
    full comparison, so records whose digests merely collide stay apart. The grouping is combined
    before the shuffle, so a class may hold any share of the rows. ``keep_id`` is the smallest id;
    rows without an id are counted, and a class of such rows only has a null keep_id.
    """
    return df.select(F.col(id_col).alias("_id"), structure.alias("structure"), root.alias("root")).groupBy("root", "structure").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def members(df: DataFrame, id_col: str, structure: Column, root: Column) -> DataFrame:
    """``keep_id, id, copies`` of every record of a class of two or more but its kept one."""
    classes = cut(collapse(df, id_col, structure, root))
    same = classes.select("root", F.struct("structure").alias("_whole"), "keep_id", "copies")
    # one row a digest for the join; classes that collide travel together and are told apart by their structure
    packed = cut(same.groupBy("root").agg(F.collect_list(F.struct("_whole", "keep_id", "copies")).alias("classes"), F.sum("copies").alias("n")))
    rows = df.select(F.col(id_col).alias("id"), F.struct(structure.alias("structure")).alias("_mine"), root.alias("root"))
    hit = hot_split_join(rows, packed, ["root"], "n")
    own = F.filter("classes", lambda k: k["_whole"].eqNullSafe(F.col("_mine")))[0]
    return hit.select(own["keep_id"].alias("keep_id"), "id", own["copies"].alias("copies")).filter("copies > 1 AND id <> keep_id")


def page_structure(pages: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Pages with ``crawl_id, url_key, canonical_key``, the structure compared and its root digest."""
    keyed = pages.select("page_id", "crawl_id", page_key(F.col("url")).alias("url_key"), "canonical")
    keyed = keyed.select("page_id", "crawl_id", "url_key", page_key(F.col("canonical"), key_host(F.col("url_key"))).alias("canonical_key"))
    whole = F.struct("crawl_id", "url_key", "canonical_key")
    dtype = keyed.select(whole.alias("w")).schema["w"].dataType
    return keyed, whole, merkle_digest(whole, dtype, leaf=lambda c: c)


def page_copies(pages: DataFrame) -> DataFrame:
    """``keep_id, page_id``: rows of a crawl with equal page keys of url and canonical, each but the one with the smallest page_id.

    The leaves are normalised to page keys; a null canonical equals an empty one, and rows without a
    crawl_id count as one crawl of their own.
    """
    keyed, whole, root = page_structure(pages)
    return members(keyed, "page_id", whole, root).select("keep_id", F.col("id").alias("page_id"))


def page_classes(pages: DataFrame) -> DataFrame:
    """``keep_id, crawl_id, url_key, canonical_key, copies``: one row a page and canonical of each crawl."""
    keyed, whole, root = page_structure(pages)
    return collapse(keyed, "page_id", whole, root).select("keep_id", "structure.*", "copies")


def text_classes(docs: DataFrame, columns: Sequence[str] = ("text",)) -> DataFrame:
    """``keep_id, copies`` of documents whose ``columns`` differ in letter case, punctuation and white space only.

    Digests are counted first; only records whose digest occurs more than once are compared in full, so a text without copies is never shuffled.
    """
    whole = F.struct(*columns)
    dtype = docs.select(whole.alias("w")).schema["w"].dataType
    rows = docs.select("doc_id", whole.alias("w"), merkle_digest(whole, dtype).alias("root"))
    seen = cut(rows.groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")))
    several = lookup_join(rows, cut(seen.filter("copies > 1").select("root")), ["root"], "left_semi")
    return seen.filter("copies = 1").select("keep_id", "copies").unionByName(collapse(several, "doc_id", normalised(F.col("w"), dtype), F.col("root")).select("keep_id", "copies"))
