"""Queries over crawl rows: addresses, issues, scores, reports, duplicates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import scoring, text, urls
from seamark.operators import audit, reports
from seamark.queries import sql
from seamark.session import table


def _pages(spark, d):
    return table(spark, d, "page_audit")


def _issues(spark, d):
    return audit.page_issues(_pages(spark, d))


QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- addresses ----


@query(f"SELECT page_id, lower({sql.part('url', 1)}) AS scheme, {sql.host('url')} AS host, {sql.path('url')} AS path, {sql.part('url', 4)} AS query, {sql.part('url', 5)} AS fragment FROM page_audit")
def url_parts(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.part(u, 4).alias("query"), urls.part(u, 5).alias("fragment"))


@query(f"SELECT page_id, {sql.sitemap_key('url')} AS sitemap_key, {sql.duplicate_key('url')} AS duplicate_key, {sql.compare_key('url')} AS compare_key FROM page_audit")
def url_keys(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.sitemap_key(u).alias("sitemap_key"), urls.duplicate_key(u).alias("duplicate_key"), urls.compare_key(u).alias("compare_key"))


@query()
def url_crawl_form(spark, d):
    return _pages(spark, d).select("page_id", urls.crawl_form("url").alias("crawl_url"), urls.slash_twin(F.col("url")).alias("twin"))


@query(f"SELECT page_id, array_to_string({sql.hygiene('url')}, ', ') AS flags, {sql.pagination('url')} AS is_pagination, {sql.first_segment('url')} AS segment FROM page_audit")
def url_hygiene(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", F.array_join(urls.hygiene_flags(u), ", ").alias("flags"), urls.is_pagination(u).alias("is_pagination"), urls.first_segment(u).alias("segment"))


@query(f"SELECT {sql.host('url')} AS host, count(*) AS pages, count(DISTINCT url) AS urls, CAST(count(*) FILTER (lower({sql.part('url', 1)}) = 'http') AS BIGINT) AS plain_http FROM page_audit GROUP BY 1")
def host_counts(spark, d):
    u = F.col("url")
    rows = _pages(spark, d).select(urls.host(u).alias("host"), "url", (urls.scheme(u) == "http").cast("int").alias("plain"))
    once = rows.groupBy("host", "url").agg(F.count(F.lit(1)).alias("n"), F.sum("plain").alias("plain"))
    return once.groupBy("host").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("urls"), F.sum("plain").alias("plain_http"))


@query(f"SELECT page_id, {sql.redirect_kind('asked', 'answered')} AS kind FROM (SELECT page_id, coalesce(original_url, url) AS asked, coalesce(redirect_url, url) AS answered FROM page_audit)")
def redirect_kinds(spark, d):
    asked, answered = F.coalesce("original_url", "url"), F.coalesce("redirect_url", "url")
    return _pages(spark, d).select("page_id", urls.redirect_kind(asked, answered).alias("kind"))


@query(
    f"""SELECT page_id, NOT {sql.non_html('url')} AND NOT regexp_matches({sql.part('url', 4)}, '(?:^|&)(?:e-page-|e-filter-|infinity)')
    AND len(list_filter(string_split(lower({sql.path('url')}), '/'), lambda s: length(s) >= 4 AND NOT regexp_matches(s, '^\\d+$')))
      = len(list_distinct(list_filter(string_split(lower({sql.path('url')}), '/'), lambda s: length(s) >= 4 AND NOT regexp_matches(s, '^\\d+$'))))
    AND NOT starts_with({sql.path('url')}, '/archive/') AND NOT contains({sql.path('url')} || '?' || {sql.part('url', 4)}, '?print=') AS admissible FROM page_audit"""
)
def admissible_urls(spark, d):
    return _pages(spark, d).select("page_id", urls.is_admissible(F.col("url"), exclude=["/archive/*", "*?print=*"]).alias("admissible"))


# ---- issues and scores ----


@query(f"SELECT page_id, array_to_string(issues, '; ') AS issues FROM ({sql.ISSUES})")
def page_issues(spark, d):
    return _issues(spark, d).select("page_id", F.array_join("issues", "; ").alias("issues"))


@query(f"SELECT trim(string_split(issue, '(')[1]) AS issue, count(*) AS n FROM ({sql.EACH}) GROUP BY 1")
def issue_histogram(spark, d):
    return audit.issue_histogram(_issues(spark, d))


@query(
    f"""SELECT issue, count(*) AS n, array_to_string(list(url ORDER BY page_id)[1:10], ' ') AS urls FROM ({sql.EACH}) GROUP BY issue"""
)
def issue_examples(spark, d):
    return audit.issue_examples(_issues(spark, d), "page_id").withColumn("urls", F.array_join("urls", " "))


@query(
    f"""SELECT s AS severity, count(DISTINCT page_id) AS pages FROM (SELECT page_id, {sql.severity('issue')} AS s FROM ({sql.EACH})) GROUP BY 1"""
)
def severity_counts(spark, d):
    return audit.severity_counts(_issues(spark, d))


@query(f"SELECT page_id, {sql.SCORE} AS score FROM ({sql.ISSUES})")
def page_scores(spark, d):
    return audit.scored(_issues(spark, d)).select("page_id", F.col("score").cast("long").alias("score"))


@query(f"SELECT {sql.host('url')} AS site, count(*) AS pages, CAST(floor(sum({sql.SCORE}) / count(*) + 0.5) AS BIGINT) AS score FROM ({sql.ISSUES}) GROUP BY 1")
def site_scores(spark, d):
    return audit.site_score(_issues(spark, d))


_LABEL = (
    "CASE " + " ".join(f"WHEN h = {sql.q(k)} THEN {sql.q(v)}" for k, v in text.ISSUE_LABELS.items()) + " " + " ".join(f"WHEN regexp_matches(issue, {sql.q(rx)}) THEN {sql.q(v)}" for rx, v in text.ISSUE_GROUPS) + " ELSE h END"
)


@query(
    f"""SELECT CASE o WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END AS severity, label, count(*) AS pages FROM (
    SELECT page_id, label, min(CASE s WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END) AS o FROM (SELECT page_id, {_LABEL} AS label, {sql.severity('issue', True)} AS s
        FROM (SELECT *, trim(regexp_replace(issue, '(?s)\\s*\\(.*', '')) AS h FROM ({sql.EACH}))) GROUP BY page_id, label) GROUP BY 1, 2"""
)
def issue_cards(spark, d):
    return audit.issue_cards(_issues(spark, d), "page_id")


@query(
    f"""WITH i AS ({sql.ISSUES}) SELECT 'HTTP' AS category, count(*) FILTER (status_code BETWEEN 400 AND 599) AS pages FROM i UNION ALL SELECT 'Redirect', count(*) FILTER (ru <> '') FROM i
    UNION ALL SELECT 'noindex', count(*) FILTER (list_contains(issues, 'noindex')) FROM i UNION ALL SELECT 'Canonicalised', count(*) FILTER (list_contains(issues, 'Canonicalised (points elsewhere)')) FROM i
    UNION ALL SELECT 'Thin content', count(*) FILTER (contains(array_to_string(issues, ' '), 'Thin content')) FROM i"""
)
def category_counts(spark, d):
    names = ("HTTP", "Redirect", "noindex", "Canonicalised", "Thin content")
    row = _issues(spark, d).agg(*(F.count_if(audit.in_category(n)).alias(n) for n in names))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("category"), F.col(n).alias("pages")) for n in names))).alias("x")).select("x.*")


# ---- reports ----


@query(
    f"""SELECT count(*) AS pages, count(*) FILTER (coalesce(error, '') <> '') AS errors, count(*) FILTER (len(issues) > 0) AS with_issues,
    CASE WHEN count(*) > 0 THEN floor((coalesce(sum(CAST(round(coalesce(response_time, 0) * 100) AS BIGINT)), 0) * 200 + count(*) * 100) / (count(*) * 200)) / 100 ELSE 0 END AS avg_response_time FROM ({sql.ISSUES})"""
)
def crawl_summary(spark, d):
    return reports.summary(_issues(spark, d))


_BUCKET = "CASE WHEN coalesce(status_code, 0) BETWEEN 200 AND 599 THEN (coalesce(status_code, 0) // 100) || 'xx' ELSE 'other' END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS pages FROM page_audit GROUP BY 1")
def response_codes(spark, d):
    return reports.response_codes(_pages(spark, d))


@query(
    """SELECT sc AS status_code, count(*) AS pages, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct, array_to_string(list(url ORDER BY page_id)[1:3], ' ') AS first_urls
    FROM (SELECT *, coalesce(status_code, 0) AS sc FROM page_audit) GROUP BY sc"""
)
def code_table(spark, d):
    return reports.code_table(_pages(spark, d), "page_id")


@query("SELECT coalesce(depth, 0) AS depth, count(*) AS pages FROM page_audit GROUP BY 1")
def depth_distribution(spark, d):
    return reports.depth_distribution(_pages(spark, d))


@query("SELECT page_id, url, depth, status_code FROM page_audit WHERE depth >= 4")
def deep_pages(spark, d):
    return reports.deep_pages(_pages(spark, d))


@query(
    """SELECT page_id, url, redirect_hops, array_to_string(list_transform(redirect_chain, lambda h: h.url || ' ' || coalesce(CAST(h.status AS VARCHAR), '')), ' > ') AS chain
    FROM page_audit WHERE len(redirect_chain) - 1 >= 2 ORDER BY page_id LIMIT 200"""
)
def redirect_chains(spark, d):
    return reports.redirect_chains(_pages(spark, d), "page_id")


def _dup_sql(value: str) -> str:
    return f"""SELECT site, value, count(*) AS urls, arg_min(url, page_id) AS first_url FROM (SELECT site, value, page, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (
        SELECT {sql.host('url')} AS site, {value} AS value, {sql.duplicate_key('url')} AS page, page_id, url FROM page_audit
        WHERE coalesce(indexable, true) AND coalesce(redirect_url, '') = '' AND coalesce(status_code, 0) < 300 AND (coalesce(canonical, '') = '' OR {sql.sitemap_key('canonical')} = {sql.sitemap_key('url')}))
        WHERE value <> '' GROUP BY site, value, page) GROUP BY site, value HAVING count(*) > 1"""


def _dups(spark, d, value):
    return reports.duplicate_groups(_pages(spark, d).withColumn("site", urls.host(F.col("url"))), value, "page_id", ["site"])


@query(_dup_sql("lower(trim(coalesce(title, '')))"))
def duplicate_titles(spark, d):
    return _dups(spark, d, reports.title_text(F.col("title")))


@query(_dup_sql("lower(trim(coalesce(meta_description, '')))"))
def duplicate_descriptions(spark, d):
    return _dups(spark, d, reports.title_text(F.col("meta_description")))


@query(_dup_sql("lower(trim(coalesce(h1, '')))"))
def duplicate_headings(spark, d):
    return _dups(spark, d, reports.title_text(F.col("h1")))


_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_BODY = f"trim(regexp_replace(lower(coalesce(body_text, '')), {sql.q(_SPACE)}, ' ', 'g'))"


@query(_dup_sql(f"CASE WHEN {_BODY} = '' THEN '' ELSE md5({_BODY}) END"))
def duplicate_bodies(spark, d):
    return _dups(spark, d, reports.body_digest(F.col("body_text")))


_TITLES = _dup_sql("lower(trim(coalesce(title, '')))")


@query(f"SELECT *, row_number() OVER (ORDER BY urls DESC, value) AS rank FROM (SELECT value, CAST(sum(urls) AS BIGINT) AS urls FROM ({_TITLES}) GROUP BY value) ORDER BY urls DESC, value LIMIT 100")
def largest_title_groups(spark, d):
    groups = duplicate_titles(spark, d).groupBy("value").agg(F.sum("urls").alias("urls"))
    return reports.largest_groups(groups)


@query(
    f"""SELECT node, level, count(*) AS pages, CAST(sum(n) AS BIGINT) AS issues, CAST(sum(bad) AS BIGINT) AS errors FROM (
    SELECT n, bad, unnest(list_transform(range(0, len(p) + 1), lambda i: CASE WHEN i = 0 THEN '' ELSE '/' || array_to_string(p[1:i], '/') END)) AS node, unnest(range(0, len(p) + 1)) AS level
    FROM (SELECT len(issues) AS n, CASE WHEN sc >= 400 THEN 1 ELSE 0 END AS bad, list_filter(string_split({sql.path('url')}, '/'), lambda s: s <> '') AS p FROM ({sql.ISSUES}))) GROUP BY node, level"""
)
def path_tree(spark, d):
    return reports.path_tree(_issues(spark, d)).withColumn("level", F.col("level").cast("long"))


_REPORTABLE = f"NOT {sql.pagination('url')} AND coalesce(indexable, true) AND coalesce(redirect_url, '') = '' AND (coalesce(status_code, 0) = 0 OR status_code BETWEEN 200 AND 299)"


def _all_sql(*fields: tuple[str, int | None]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS field, count(*) AS rows, count(*) FILTER (coalesce({f}, '') <> '') AS filled, count(*) FILTER (coalesce({f}, '') = '') AS empty,
        {f"count(*) FILTER (length(coalesce({f}, '')) > {n})" if n else "CAST(0 AS BIGINT)"} AS over_limit FROM page_audit WHERE {_REPORTABLE}"""
        for f, n in fields
    )


_FIELDS = (("title", 60), ("meta_description", 150), ("h1", None), ("canonical", None))


@query(_all_sql(*_FIELDS))
def all_values(spark, d):
    pages = _pages(spark, d).filter(audit.reportable())
    out = None
    for f, n in _FIELDS:
        row = reports.all_values(pages, f, n).select(F.lit(f).alias("field"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"SELECT page_id, url, coalesce(title, '') AS value, length(coalesce(title, '')) AS len FROM page_audit WHERE {_REPORTABLE}")
def title_list(spark, d):
    return reports.value_list(_pages(spark, d).filter(audit.reportable()), "title").withColumn("len", F.col("len").cast("long"))


# ---- texts ----


@query(f"SELECT doc_id, CASE WHEN t = '' THEN '' ELSE md5(t) END AS body_hash, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), {sql.q(_SPACE)}, ' ', 'g')) AS t FROM documents)")
def body_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", text.body_hash(F.col("text")).alias("body_hash"), text.word_count(F.col("text")).cast("long").alias("words"))


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''\\-]{1,}')"
_STOP = ", ".join(sql.q(w) for w in text.STOP_WORDS)
_CONTENT = f"list_filter({_TOK}, lambda t: t NOT IN ({_STOP}))"


@query(f"SELECT t AS term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({_CONTENT}) AS t FROM documents) GROUP BY ALL) GROUP BY t")
def term_frequencies(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode_outer(text.content_tokens(F.col("text"))).alias("term")).filter("term IS NOT NULL")
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


@query(
    f"""SELECT doc_id, len(w) AS words, CASE WHEN len(w) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS shingles
    FROM (SELECT doc_id, {_CONTENT} AS w FROM documents)"""
)
def shingle_counts(spark, d):
    words = table(spark, d, "documents").select("doc_id", text.content_tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("words"), F.size(text.shingles(F.col("w"))).cast("long").alias("shingles"))


@query()
def vital_ratings(spark, d):
    """Ratings of response times as if they were times to first byte."""
    return _pages(spark, d).select("page_id", scoring.vital_rating("ttfb_ms", F.col("response_time") * 1000).alias("rating"))


ORACLES["vital_ratings"] = "SELECT page_id, CASE WHEN response_time IS NULL THEN NULL WHEN response_time * 1000 <= 800 THEN 'good' WHEN response_time * 1000 <= 1800 THEN 'warn' ELSE 'poor' END AS rating FROM page_audit"
