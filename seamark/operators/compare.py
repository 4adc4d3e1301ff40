"""Comparing two crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions import text, urls
from seamark.operators.reports import exact_mean, status_class

#: Columns whose change is reported; null and empty are equal, 0 and empty are not.
WATCHED = (
    "status_code title title_len meta_description meta_len h1 word_count canonical redirect_url indexable depth response_time internal_links external_links images_no_alt body_hash"
).split()


def last_by_key(pages: DataFrame, seq: str, watched: list[str]) -> DataFrame:
    """One row a key (address without last slash, lower case): the one that came last."""
    rows = pages.select(urls.compare_key(F.col("url")).alias("key"), F.struct(F.col(seq).alias("seq"), "url", *watched).alias("row"))
    return rows.groupBy("key").agg(F.max_by("row", "row.seq").alias("row"))


def page_diff(a: DataFrame, b: DataFrame, seq: str) -> DataFrame:
    """``key, kind, fields``: added, removed, changed (with the changed columns, in fixed order) or unchanged pages of crawl ``b`` against ``a``."""
    have = [c for c in WATCHED if c in a.columns and c in b.columns]
    both = last_by_key(a, seq, have).withColumnRenamed("row", "x").join(last_by_key(b, seq, have).withColumnRenamed("row", "y"), "key", "full_outer")
    said = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    fields = F.array_compact(F.array(*(F.when(said("x", c) != said("y", c), c) for c in have)))
    kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.size(fields) > 0, "changed").otherwise("unchanged")
    return both.select("key", kind.alias("kind"), F.when(kind == "changed", F.array_join(fields, ",")).otherwise("").alias("fields"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count(F.lit(1)).alias("pages"))


def totals(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of a crawl, over all its rows: no gate, response times averaged over those above 0"""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    status, n = F.coalesce(F.col("status_code"), F.lit(0)), F.lit(0)
    bucket = status_class(F.col("status_code"))
    out = [F.count(F.lit(1)).alias("pages")]
    out += [F.count_if(bucket == b).alias(f"codes_{b}") for b in ("2xx", "3xx", "4xx", "5xx", "other")]
    out += [
        F.count_if((status >= 400) | ~blank("error")).alias("errors"),
        F.coalesce(F.max(F.coalesce("depth", n)), n).alias("max_depth"),
        exact_mean(F.coalesce("depth", n), F.count(F.lit(1)), 2).alias("avg_depth"),
        exact_mean(F.when(F.col("response_time") != 0, F.col("response_time")), F.count_if(F.col("response_time") != 0), 2).alias("avg_response_time"),
        F.count_if(F.col("indexable")).alias("indexable"),
        F.count_if(~F.col("indexable")).alias("noindex"),
        F.count_if(~blank("redirect_url")).alias("redirects"),
        F.count_if(blank("title")).alias("missing_title"),
        F.count_if(~blank("title") & (F.coalesce("title_len", n) > 60)).alias("title_too_long"),
        F.count_if(blank("meta_description")).alias("missing_meta"),
        F.count_if(~blank("meta_description") & (F.length("meta_description") > 160)).alias("meta_too_long"),
        F.count_if(blank("h1")).alias("missing_h1"),
        F.count_if(blank("canonical")).alias("missing_canonical"),
        F.count_if(F.coalesce("word_count", n) < 200).alias("thin"),
        F.count_if(F.coalesce("response_time", F.lit(0.0)) > 3).alias("slow"),
    ]
    return pages.groupBy(*by).agg(*out) if by else pages.agg(*out)


def issue_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``issue, a, b, delta, only_a, only_b, both``: per issue, the different addresses that have it in either crawl."""
    one = lambda df, side: df.select(F.explode("issues").alias("i"), "url").select(text.issue_compare_key(F.col("i")).alias("issue"), "url", F.lit(side).alias("side"))
    sides = one(a, 1).unionByName(one(b, 2)).groupBy("issue", "url").agg(F.max((F.col("side") == 1).cast("int")).alias("in_a"), F.max((F.col("side") == 2).cast("int")).alias("in_b"))
    both = F.col("in_a") * F.col("in_b")
    out = sides.groupBy("issue").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"), F.sum(F.col("in_a") - both).alias("only_a"), F.sum(F.col("in_b") - both).alias("only_b"), F.sum(both).alias("both"))
    return out.withColumn("delta", F.col("b") - F.col("a"))


def ordered_issue_diff(diff: DataFrame) -> DataFrame:
    return diff.orderBy(F.abs("delta").desc(), (F.col("a") + F.col("b")).desc(), "issue")


def structure_diff(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """``path, a, b, delta``: pages under each first directory; with ``most``, the largest ones only."""
    one = lambda df, x, y: df.select(urls.first_segment(F.col("url")).alias("path"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    out = one(a, 1, 0).unionByName(one(b, 0, 1)).groupBy("path").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("delta", F.col("b") - F.col("a"))
    return out.orderBy((F.col("a") + F.col("b")).desc(), "path").limit(most) if most else out
