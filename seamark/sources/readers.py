"""Sources: saved crawls, sitemaps, robots.txt, keyword payloads, page-speed reports, rows from requests."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.functions.robots import sitemap_lines
from seamark.operators.sitemap import DEFAULT_PATHS
from seamark.session import cut

#: One explicit schema of page rows; absent members read as null, unknown ones are ignored.
PAGE_ROW = (
    "url string, original_url string, status_code int, content_type string, last_modified string, response_time double, title string, title_len int, meta_description string, meta_len int, "
    "h1 string, h1_list array<string>, h2_list array<string>, h2_count int, canonical string, canonical_match boolean, canonical_kind string, word_count int, body_text string, body_hash string, "
    "internal_links int, external_links int, internal_link_urls array<array<string>>, external_link_urls array<array<string>>, images_total int, images_no_alt int, images_empty_alt int, "
    "images_empty_alt_content int, schema_types array<string>, indexable boolean, is_pagination boolean, issues array<string>, error string, depth int, redirect_url string, redirect_kind string, "
    "redirect_status int, redirect_hops int, redirect_chain array<struct<url:string,status:int>>, mixed_content array<string>, url_issues array<string>, "
    "hreflang array<struct<lang:string,href:string>>, og_tags map<string,string>, twitter_tags map<string,string>, analytics array<string>"
)
_ROW_MEMBERS = re.sub(r"(^|, )(\w+) ", r"\1\2: ", PAGE_ROW)
SAVED_CRAWL = f"name string, saved_at long, pages int, seed string, saved_by string, results array<struct<{_ROW_MEMBERS}>>"


def saved_crawls(spark: SparkSession, folders: list[str], file_name: str | None = None) -> DataFrame:
    """One row a saved crawl file of several folders; of files of the same name, the one of the first folder counts.

    Unreadable files are skipped, and absent members are null. ``file_name`` reads one file only; it
    may hold no path.
    """
    if file_name is not None and ("/" in file_name or "\\" in file_name or ".." in file_name):
        raise ValueError("a file name without a path is needed")
    out = None
    for rank, folder in enumerate(folders):
        reader = spark.read.schema(SAVED_CRAWL).option("multiLine", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True)
        rows = reader.json(folder, pathGlobFilter=file_name or "*.json").select(F.col("_metadata.file_name").alias("file_name"), F.lit(rank).alias("folder_rank"), "*")
        out = rows if out is None else out.unionByName(rows)
    first = out.withColumn("_rn", F.row_number().over(Window.partitionBy("file_name").orderBy("folder_rank"))).filter("_rn = 1").drop("_rn")
    return first.filter(F.col("saved_at").isNotNull() | F.col("results").isNotNull())


def crawl_rows(crawls: DataFrame) -> DataFrame:
    """Page rows of saved crawls with their file and position."""
    return crawls.select("file_name", "saved_at", F.posexplode("results").alias("seq", "r")).select("file_name", "saved_at", "seq", "r.*")


def named_savers(crawls: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``saved_by_name``: the friendly name of an address, else the address, else unknown."""
    n = names.select(F.col("ip").alias("saved_by"), "name_of")
    return crawls.join(n, "saved_by", "left").withColumn("saved_by_name", F.coalesce("name_of", "saved_by", F.lit("unknown"))).drop("name_of")


def rows_of_request(spark: SparkSession, rows: list[dict], schema: str = PAGE_ROW) -> DataFrame:
    """Rows that came with a request, under one schema."""
    import json

    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


# ---- sitemaps ----

_ENTRY = "source_sitemap string, kind string, url string, lastmod string, error string"


def parse_sitemap(name: str, content: bytes | None) -> list[tuple]:
    """(source, kind, url, lastmod, error) rows of a sitemap file, plain or gzipped; kind is url, sitemap, file (one a file, url holding the count) or error."""
    if content is None:
        return [(name, "error", None, None, "missing")]
    if name.lower().endswith(".gz"):
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError):
            pass
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return [(name, "error", None, None, f"xml_parse: {str(e)[:120]}")]
    bare = lambda t: t.rpartition("}")[2]
    index = bare(root.tag) == "sitemapindex"
    rows = []
    for node in root:
        if bare(node.tag) != ("sitemap" if index else "url"):
            continue
        have = {bare(c.tag): (c.text or "").strip() for c in node}
        if have.get("loc"):
            rows.append((name, "sitemap" if index else "url", have["loc"], have.get("lastmod") or None, None))
    return [*rows, (name, "file", str(0 if index else len(rows)), None, None)]


def walk_sitemaps(files: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """Rows of _ENTRY with ``depth``, from fetched files (``url, content`` binary) and seeds (``url``): indexes are followed level by level, each file once."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for u, c in zip(b["url"], b["content"], strict=True) for r in parse_sitemap(u, c)]
            yield pd.DataFrame(rows, columns=["source_sitemap", "kind", "url", "lastmod", "error"])

    frontier = seeds.select("url").distinct()
    seen, out = frontier, None
    for depth in range(max_depth + 1):
        level = cut(frontier.join(files, "url", "left").select("url", "content").mapInPandas(parse, _ENTRY).withColumn("depth", F.lit(depth)))
        out = level if out is None else out.unionByName(level)
        frontier = cut(level.filter("kind = 'sitemap'").select("url").distinct().join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return out


def sitemap_seeds(robots_text: str | None, root: str) -> list[str]:
    """Sitemaps that robots.txt names, else the usual places."""
    return sitemap_lines(robots_text) or [root.rstrip("/") + p for p in DEFAULT_PATHS]


# ---- page-speed reports ----

AUDITS = "largest-contentful-paint first-contentful-paint cumulative-layout-shift total-blocking-time speed-index interactive server-response-time".split()


def page_speed(reports: DataFrame) -> DataFrame:
    """Flat metrics of page-speed reports (``url, payload`` JSON): score out of 100 and the audits' numbers, all times in milliseconds."""
    v = F.try_parse_json("payload")
    at = lambda path, kind: F.try_variant_get(v, f"$.lighthouseResult.{path}", kind)
    cols = [at(f"audits['{a}'].numericValue", "double").alias(a.replace("-", "_")) for a in AUDITS]
    return reports.select("url", F.round(at("categories.performance.score", "double") * 100, 0).cast("int").alias("score"), *cols)


def failing_audits(reports: DataFrame, limit: float = 0.9) -> DataFrame:
    """``url, audit, score`` of audits under the limit, worst first within a page."""
    audits = F.from_json(F.get_json_object("payload", "$.lighthouseResult.audits"), "map<string,struct<score:double,title:string>>")
    return reports.select("url", F.explode(audits).alias("audit", "a")).filter(F.col("a.score") < limit).select("url", "audit", F.col("a.score").alias("score"), F.col("a.title").alias("title")).orderBy("url", "score", "audit")
