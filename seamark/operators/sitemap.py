"""Sitemaps against crawls, and sitemaps made from crawls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import text, urls

#: Fixed value: most addresses of a sitemap file.
FILE_SIZE = 50_000
#: Fixed value: where sitemaps lie if robots.txt names none.
DEFAULT_PATHS = "/sitemap.xml /sitemap_index.xml /sitemap-index.xml /wp-sitemap.xml /sitemap.xml.gz /sitemap1.xml /sitemap-1.xml /post-sitemap.xml /page-sitemap.xml".split()

_NUMBERED = r"(?:/page/\d+/?\z)|(?:[?&]_?(?:page|paged|pg)=\d+)"


def crawl_by_key(crawl: DataFrame, seq: str) -> DataFrame:
    """The last row of each key of a crawl."""
    cols = ["url", "status_code", "indexable", "redirect_url", "canonical"]
    rows = crawl.select(urls.sitemap_key(F.col("url")).alias("key"), F.struct(F.col(seq).alias("seq"), *cols).alias("r"))
    return rows.groupBy("key").agg(F.max_by("r", "r.seq").alias("r")).select("key", "r.*")


def missing_from_sitemap(crawl: DataFrame, sitemap: DataFrame, seq: str) -> DataFrame:
    """Crawled pages that a sitemap should list and doesn't: 200 or unknown status, indexable, HTML, no redirect, no pagination, canonical to themselves."""
    c = crawl_by_key(crawl, seq)
    status = F.coalesce("status_code", F.lit(0))
    canonical = F.coalesce("canonical", F.lit(""))
    fit = (
        status.isin(0, 200) & F.coalesce("indexable", F.lit(True)) & (F.coalesce("redirect_url", F.lit("")) == "") & ~urls.is_non_html(F.col("url"))
        & ~F.col("url").rlike(_NUMBERED) & ((canonical == "") | (urls.sitemap_key(canonical) == F.col("key")))
    )
    listed = sitemap.select(urls.sitemap_key(F.col("url")).alias("key")).distinct()
    return c.filter(fit).join(listed, "key", "left_anti").select("key", "url")


def sitemap_matches(crawl: DataFrame, sitemap: DataFrame, seq: str) -> DataFrame:
    """Sitemap entries with the crawled row that answers for them: the one with their key, else the first that names it as canonical."""
    c = crawl_by_key(crawl, seq)
    alias = (
        crawl.filter(F.coalesce("canonical", F.lit("")) != "").select(urls.sitemap_key(F.col("canonical")).alias("key"), F.struct(F.col(seq).alias("seq"), "url", "status_code", "indexable", "redirect_url", "canonical").alias("r"))
        .groupBy("key").agg(F.min_by("r", "r.seq").alias("r"))
    )
    s = sitemap.select(F.col("url").alias("listed"), urls.sitemap_key(F.col("url")).alias("key"), *(["lastmod"] if "lastmod" in sitemap.columns else []))
    direct = c.select("key", F.struct("seq", "url", "status_code", "indexable", "redirect_url", "canonical").alias("direct"))
    return s.join(direct, "key", "left").join(alias, "key", "left").withColumn("row", F.coalesce("direct", "r")).drop("direct", "r")


def sitemap_reports(crawl: DataFrame, sitemap: DataFrame, link_targets: DataFrame, seq: str) -> DataFrame:
    """``report, listed, detail``: entries that are uncrawled, not 200, redirects, noindex, without inlinks, or later pages of a list.

    The reports are not exclusive. ``link_targets`` has a column ``target``.
    """
    m = sitemap_matches(crawl, sitemap, seq)
    linked = link_targets.select(urls.sitemap_key(F.col("target")).alias("key")).distinct().withColumn("linked", F.lit(True))
    m = m.join(linked, "key", "left")
    status = F.coalesce("row.status_code", F.lit(0))
    found = F.col("row").isNotNull()
    to = F.coalesce("row.redirect_url", F.lit(""))
    numbered = F.col("listed").rlike(_NUMBERED)
    events = F.array_compact(
        F.array(
            *(
                F.when(cond, F.struct(F.lit(name).alias("report"), F.col("listed").alias("listed"), detail.alias("detail")))
                for name, cond, detail in (
                    ("sitemap_only", ~found & ~numbered, F.lit("")),
                    ("pagination", numbered, F.lit("")),
                    ("non_200", found & (status != 0) & (status != 200), status.cast("string")),
                    ("redirects", found & (to != "") & (urls.sitemap_key(to) != F.col("key")), to),
                    ("non_indexable", found & (F.col("row.indexable") == F.lit(False)), F.lit("noindex")),
                    ("no_inlinks", found & (status == 200) & F.col("linked").isNull(), F.lit("")),
                )
            )
        )
    )
    return m.select(F.explode(events).alias("e")).select("e.*")


def orphans(sitemap: DataFrame, crawl: DataFrame, most: int = 200) -> DataFrame:
    """The first ``most`` sitemap addresses, in order, that were neither crawled nor the target of a redirect (a last slash apart)."""
    bare = lambda c: F.regexp_replace(c, r"/+\z", "")
    known = crawl.select(bare(F.col("url")).alias("u")).unionByName(crawl.select(bare(F.col("redirect_url")).alias("u")).filter("u IS NOT NULL"))
    return sitemap.select(bare(F.col("url")).alias("u")).distinct().join(known, "u", "left_anti").orderBy("u").limit(most)


def own_host(sitemap: DataFrame, domain: str) -> DataFrame:
    h = urls.bare_host(F.col("url"))
    base = domain.lower().removeprefix("www.")
    return sitemap.filter((h == "") | (h == base))


def foreign_hosts(sitemap: DataFrame, domain: str) -> DataFrame:
    """``host, n``: entries of other hosts than the domain."""
    h = urls.bare_host(F.col("url"))
    base = domain.lower().removeprefix("www.")
    return sitemap.filter((h != "") & (h != base)).groupBy(h.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def sitemap_totals(sitemap: DataFrame) -> DataFrame:
    """One row: entries, files, share without a date, and which warnings hold (too many entries, too few dates, plain http)."""
    t = sitemap.agg(
        F.count(F.lit(1)).alias("urls"), F.count_distinct("source_sitemap").alias("files"), F.count_if(F.coalesce("lastmod", F.lit("")) == "").alias("undated"), F.count_if(F.col("url").startswith("http://")).alias("plain_http")
    )
    share = F.col("undated") / F.greatest(F.lit(1), F.col("urls"))
    return t.select("urls", "files", F.round(share, 4).alias("undated_share"), (F.col("urls") > FILE_SIZE).alias("too_large"), (share > 0.5).alias("few_dates"), (F.col("plain_http") > 0).alias("has_http"))


def exportable() -> Column:
    """Pages that belong in a sitemap: status 200, indexable, HTML or XML, no redirect, no pagination, canonical to themselves, no error."""
    canonical = F.coalesce("canonical", F.lit(""))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return (
        (F.col("status_code") == 200) & F.coalesce("indexable", F.lit(True)) & (F.coalesce("redirect_url", F.lit("")) == "") & (F.coalesce("error", F.lit("")) == "")
        & ((kind == "") | kind.rlike("html|xml")) & ~urls.is_non_html(F.col("url")) & ~urls.is_pagination(F.col("url")) & ((canonical == "") | (urls.sitemap_key(canonical) == urls.sitemap_key(F.col("url"))))
    )


def sitemap_entries(pages: DataFrame, seq: str) -> DataFrame:
    """``url, lastmod, seq``: each exportable address once, as first seen."""
    has = "last_modified" in pages.columns
    rows = pages.filter(exportable()).select("url", F.col(seq).alias("seq"), (text.http_date(F.col("last_modified")) if has else F.lit("")).alias("lastmod"))
    return rows.groupBy("url").agg(F.min(F.struct("seq", "lastmod")).alias("m")).select("url", "m.lastmod", "m.seq")


def chunked(entries: DataFrame, size: int = FILE_SIZE) -> DataFrame:
    """Adds ``chunk`` (from 1), the sitemap file of each entry by order of ``seq``.

    Entries are range-partitioned and numbered within partitions; the offsets of the partitions are
    added, so no task orders all entries.
    """
    from seamark.session import cut

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(entries.repartitionByRange(n, "seq", "url").sortWithinPartitions("seq", "url").withColumn("_pid", F.spark_partition_id()))
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_pid", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_pid").orderBy("seq", "url")) - 1 + F.col("_before")
    return parts.join(F.broadcast(offsets), "_pid").withColumn("chunk", (F.floor(place / size) + 1).cast("int")).drop("_pid", "_before")
