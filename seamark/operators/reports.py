"""Reports over the rows of a crawl: totals, groups, rankings, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import text, urls


def exact_mean(c: Column, n: Column, digits: int) -> Column:
    """Sum of ``c`` (a measure to hundredths) over ``n``, rounded half up at ``digits`` decimals in whole numbers: no result depends on the order of a sum."""
    unit = 10**digits
    total = F.coalesce(F.sum(F.round(c * 100, 0).cast("long")), F.lit(0))
    return F.when(n > 0, F.floor((total * (2 * unit) + n * 100) / (n * 200)) / unit).otherwise(0.0)


def summary(pages: DataFrame) -> DataFrame:
    """One row: ``pages, errors, with_issues, avg_response_time`` (errors counted as 0 s)."""
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
        F.count_if(F.size("issues") > 0).alias("with_issues"),
        exact_mean(F.coalesce(F.col("response_time"), F.lit(0.0)), F.count(F.lit(1)), 2).alias("avg_response_time"),
    )


def status_class(status: Column) -> Column:
    s = F.coalesce(status, F.lit(0))
    return F.when(s.between(200, 599), F.concat(F.floor(s / 100).cast("string"), F.lit("xx"))).otherwise("other")


def response_codes(pages: DataFrame) -> DataFrame:
    return pages.groupBy(status_class(F.col("status_code")).alias("bucket")).agg(F.count(F.lit(1)).alias("pages"))


def code_table(pages: DataFrame, seq: str, examples: int = 3) -> DataFrame:
    """``status_code, pages, pct, first_urls``: per status the count, its share in percent and the first addresses.

    The bound on the rank is pushed below the shuffle (WindowGroupLimit): a task sends ``examples`` rows a status at most.
    """
    by = pages.groupBy(F.coalesce("status_code", F.lit(0)).alias("status_code")).agg(F.count(F.lit(1)).alias("pages"))
    share = by.withColumn("pct", F.round(F.col("pages") * 100.0 / F.sum("pages").over(Window.partitionBy(F.lit(1))), 1))
    rows = pages.select(F.coalesce("status_code", F.lit(0)).alias("status_code"), seq, "url")
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("status_code").orderBy(seq))).filter(F.col("_rn") <= examples)
    first = ranked.groupBy("status_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "url"))), lambda x: x["url"]), " ").alias("first_urls"))
    return share.join(first, "status_code")


def depth_distribution(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce("depth", F.lit(0)).alias("depth")).agg(F.count(F.lit(1)).alias("pages"))


def deep_pages(pages: DataFrame, least: int = 4) -> DataFrame:
    return pages.filter(F.col("depth") >= least).select("page_id", "url", "depth", "status_code")


def redirect_chains(pages: DataFrame, seq: str, most: int = 200) -> DataFrame:
    """The first ``most`` redirects of at least two hops."""
    return (
        pages.filter((F.size("redirect_chain") - 1 >= 2)).orderBy(seq).limit(most)
        .select(seq, "url", "redirect_hops", F.array_join(F.transform("redirect_chain", lambda h: F.concat(h["url"], F.lit(" "), h["status"].cast("string"))), " > ").alias("chain"))
    )


def duplicate_gate(ignore_noindex: bool = False) -> Column:
    status = F.coalesce(F.col("status_code"), F.lit(0))
    canonical = F.coalesce(F.col("canonical"), F.lit(""))
    return (
        (F.coalesce(F.col("indexable"), F.lit(True)) | F.lit(ignore_noindex))
        & (F.coalesce(F.col("redirect_url"), F.lit("")) == "")
        & (status < 300)
        & ((canonical == "") | (urls.sitemap_key(canonical) == urls.sitemap_key(F.col("url"))))
    )


def duplicate_groups(pages: DataFrame, value: Column, seq: str, scope: list[str] | None = None) -> DataFrame:
    """``*scope, value, urls, first_url``: values that several different pages share.

    Addresses that are the same page count once. Grouping is by partial aggregation in two steps, so a
    value that a third of all pages share is no burden; the pages of a group come from a join on value.
    """
    scope = scope or []
    rows = pages.filter(duplicate_gate()).select(*scope, value.alias("value"), urls.duplicate_key(F.col("url")).alias("page"), seq, "url").filter(F.coalesce(F.col("value"), F.lit("")) != "")
    once = rows.groupBy(*scope, "value", "page").agg(F.min(F.struct(seq, "url")).alias("m"))
    groups = once.groupBy(*scope, "value").agg(F.count(F.lit(1)).alias("urls"), F.min("m").alias("m"))
    return groups.filter("urls > 1").select(*scope, "value", "urls", F.col("m.url").alias("first_url"))


def largest_groups(groups: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` largest groups, numbered by size, then value."""
    top = groups.orderBy(F.col("urls").desc(), "value").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("urls").desc(), "value")))


def path_tree(pages: DataFrame) -> DataFrame:
    """``node, level, pages, issues, errors``: roll-up over every prefix of the path; the root is empty."""
    parts = F.filter(F.split(urls.path(F.col("url")), "/"), lambda s: s != "")
    nodes = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.struct(i.alias("level"), F.when(i == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, i), "/"))).alias("node")))
    rows = pages.select(parts.alias("parts"), F.size("issues").alias("n"), (F.coalesce(F.col("status_code"), F.lit(0)) >= 400).cast("int").alias("bad")).select(F.explode_outer(nodes).alias("x"), "n", "bad")
    return rows.groupBy("x.node", "x.level").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").cast("long").alias("issues"), F.sum("bad").cast("long").alias("errors"))


def all_values(pages: DataFrame, field: str, limit: int | None) -> DataFrame:
    """One row: ``rows, filled, empty, over_limit`` of a text field over reportable pages."""
    v = F.coalesce(F.col(field), F.lit(""))
    over = F.count_if(F.length(v) > limit) if limit else F.lit(0).cast("long")
    return pages.agg(F.count(F.lit(1)).alias("rows"), F.count_if(v != "").alias("filled"), F.count_if(v == "").alias("empty"), over.alias("over_limit"))


def value_list(pages: DataFrame, field: str) -> DataFrame:
    """Pages ordered by a text field, empty ones last."""
    v = F.coalesce(F.col(field), F.lit(""))
    return pages.orderBy(v == "", F.lower(v), "url").select("page_id", "url", v.alias("value"), F.length(v).alias("len"))


def performance_totals(perf: DataFrame) -> DataFrame:
    """One row from ``load_time_s, ttfb_ms, html_kb, warnings``: averages, slow pages, pages with and without warnings."""
    return perf.agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg("load_time_s"), 2).alias("avg_load"), F.round(F.avg("ttfb_ms"), 0).alias("avg_ttfb"), F.round(F.avg("html_kb"), 1).alias("avg_kb"),
        F.count_if(F.col("load_time_s") > 3).alias("slow"), F.count_if(F.size("warnings") > 0).alias("with_warnings"), F.count_if(F.size("warnings") <= 0).alias("clean"),
    )


def slowest(perf: DataFrame, most: int = 100) -> DataFrame:
    return perf.orderBy(F.col("load_time_s").desc_nulls_last(), F.col("html_kb").desc_nulls_last(), "rec_id", "page_pos").limit(most)


def js_diff_counts(pages: DataFrame) -> DataFrame:
    """One row over ``js_diff``: pages compared, different, and per severity."""
    level = F.col("js_diff.severity")
    return pages.filter(F.col("js_diff").isNotNull()).agg(
        F.count(F.lit(1)).alias("total_compared"), F.count_if(level != "none").alias("pages_with_diff"), *(F.count_if(level == s).alias(s) for s in ("critical", "high", "medium"))
    )


def grid_sort(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a text column as a grid sorts them: blanks last in either direction; by number if all cells are numbers, else by lower-case text."""
    c = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    number = F.expr(f"try_cast(trim(cast(`{column}` as string)) as double)")
    numeric = df.agg(F.coalesce(F.bool_and((c == "") | number.isNotNull()), F.lit(True))).first()[0]
    key = number if numeric else F.lower(c)
    return df.orderBy(c == "", key.desc() if descending else key.asc())


def search(pages: DataFrame, words: str, *columns: str) -> DataFrame:
    """Rows of which a column contains the words, whatever their case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.lower(F.coalesce(F.col(c), F.lit(""))).contains(words.lower())
    return pages.filter(hit)


def upsert(pages: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of ``pages`` replaced by those of ``again`` with the same url, which keep the old depth; new ones are added."""
    old = pages.select("url", F.col("depth").alias("_depth")).dropDuplicates(["url"])
    fresh = again.join(old, "url", "left").withColumn("depth", F.coalesce("_depth", "depth")).drop("_depth").select(*pages.columns)
    return pages.join(again.select("url"), "url", "left_anti").select(*pages.columns).unionByName(fresh)


def stop_reason(pages: DataFrame) -> DataFrame:
    """One row: why a crawl of at most one page ended; null for larger ones."""
    row = pages.agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error"), F.max(F.size("internal_link_urls")).alias("links"))
    return row.select(
        F.when(F.col("n") == 0, "start page not fetched").when(F.col("n") > 1, F.lit(None).cast("string"))
        .when(F.coalesce(F.col("error"), F.lit("")) != "", "start page has an error").when(F.coalesce(F.col("links"), F.lit(0)) <= 0, "no internal links").otherwise("no link could be crawled").alias("reason")
    )


def title_text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def body_digest(c: Column) -> Column:
    return text.body_hash(c)
