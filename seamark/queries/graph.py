"""Queries over links, pairs of crawls, sitemaps, robots rules, nested reports, keywords and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import detect, html_page, robots, scoring, text, urls
from seamark.operators import audit, compare, duplicates, extract, keywords, links, nested, reports, sitemap
from seamark.queries import general, sql
from seamark.sources import sinks
from seamark.session import cut, spread, table
from seamark.streaming import crawl as streams

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _pages(spark, d):
    return table(spark, d, "page_audit")


# ---- links ----

_EDGES = "SELECT page_id, crawl_id, url AS source, e.target AS target, e.anchor AS anchor, e.placement AS placement FROM (SELECT *, unnest(internal_link_urls) AS e FROM page_audit) WHERE e IS NOT NULL"


@query(f"SELECT crawl_id, target, count(*) AS links, count(DISTINCT source) AS sources FROM (SELECT DISTINCT crawl_id, target, source, anchor, placement FROM ({_EDGES})) GROUP BY crawl_id, target")
def inlinks(spark, d):
    return links.inlinks(links.edges(_pages(spark, d)))


@query("SELECT page_id, url, coalesce(len(internal_link_urls), 0) AS links, CASE WHEN internal_link_urls IS NULL THEN NULL ELSE len(list_distinct(list_transform(internal_link_urls, lambda e: e.placement))) END AS placements FROM page_audit")
def outlinks(spark, d):
    return links.outlinks(_pages(spark, d)).withColumns({c: F.col(c).cast("long") for c in ("links", "placements")})


@query(f"SELECT placement, count(*) AS links, count(DISTINCT target) AS targets FROM ({_EDGES}) GROUP BY placement")
def link_placements(spark, d):
    once = links.edges(_pages(spark, d)).groupBy("placement", "target").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("placement").agg(F.sum("n").alias("links"), F.count("target").alias("targets"))


@query(
    f"""SELECT b.crawl_id, b.page_id, b.url, b.status_code, e.source, e.anchor FROM page_audit b
    LEFT JOIN ({_EDGES}) e ON e.crawl_id = b.crawl_id AND regexp_replace(e.target, '/+$', '') = regexp_replace(b.url, '/+$', '') WHERE b.status_code >= 400"""
)
def broken_with_inlinks(spark, d):
    pages = _pages(spark, d)
    return links.broken_with_inlinks(pages, links.edges(pages))


_ANCHOR = "trim(coalesce(anchor, ''))"
_CLOUD = f"""SELECT a AS anchor, count(*) AS links, count(DISTINCT target) AS targets FROM (SELECT lower(CASE WHEN length({_ANCHOR}) > 60 THEN left({_ANCHOR}, 60) || '…' ELSE {_ANCHOR} END) AS a, target
    FROM ({_EDGES}) WHERE {_ANCHOR} <> '') GROUP BY a ORDER BY links DESC, anchor LIMIT 80"""
_GENERIC = """'click here', 'read more', 'learn more', 'more', 'here', 'this', 'this page', 'find out more', 'find out', 'more info', 'more information', 'details', 'view', 'view more', 'see more', 'see details',
    'link', 'website', 'this link', 'click', 'tap here', 'tap', 'open', 'go', 'go here', 'continue', 'continue reading', 'full story'"""


@query(
    f"""SELECT anchor, links, targets, anchor IN ({_GENERIC}) AS generic, round(CASE WHEN max(links) OVER () = min(links) OVER () THEN 1.0 ELSE (links - min(links) OVER ()) / (max(links) OVER () - min(links) OVER ()) END, 6) AS weight FROM ({_CLOUD})"""
)
def anchor_cloud(spark, d):
    return links.anchor_cloud(links.edges(_pages(spark, d)))


@query(f"SELECT *, round(generic / greatest(1, links), 6) AS share FROM (SELECT count(*) AS links, count(*) FILTER (lower({_ANCHOR}) IN ({_GENERIC})) AS generic FROM ({_EDGES}) WHERE {_ANCHOR} <> '')")
def generic_anchors(spark, d):
    return links.generic_share(links.edges(_pages(spark, d)))


_BFS_EDGES = f"SELECT DISTINCT {sql.sitemap_key('source')} AS s, {sql.sitemap_key('target')} AS t FROM ({_EDGES})"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED ({_BFS_EDGES}), w(node, depth) AS (SELECT DISTINCT {sql.sitemap_key('url')}, 0 FROM page_audit WHERE {sql.path('url')} IN ('', '/') AND coalesce(url, '') <> ''
    UNION SELECT t, depth + 1 FROM w JOIN e ON s = node WHERE depth < 6) SELECT node, min(depth) AS depth FROM w GROUP BY node"""
)
def link_depth(spark, d):
    """Clicks from each site's start page, however many; the SQL stops at 6, which no page of the test data is beyond."""
    pages = _pages(spark, d)
    graph = links.edges(pages).select(urls.sitemap_key(F.col("source")).alias("source"), urls.sitemap_key(F.col("target")).alias("target"))
    seeds = pages.filter(urls.path(F.col("url")).isin("", "/") & (F.coalesce("url", F.lit("")) != "")).select(urls.sitemap_key(F.col("url")).alias("node"))
    return links.breadth_first(graph, seeds, None)


@query("SELECT page_id, url, len(list_filter(string_split(p, '/'), lambda s: s <> '')) AS segments FROM (SELECT *, " + sql.path("url") + " AS p FROM page_audit) WHERE status_code = 200 AND coalesce(redirect_url, '') = '' AND len(list_filter(string_split(p, '/'), lambda s: s <> '')) >= 1 ORDER BY segments <> 1, page_id LIMIT 1")
def trap_probe_parent(spark, d):
    return links.trap_probe_parent(_pages(spark, d), "page_id").withColumn("segments", F.col("segments").cast("long"))


# ---- two crawls of each site: its first and its last ----

_SIDES = f"SELECT *, {sql.host('url')} AS h FROM page_audit"
_AB = f"SELECT p.*, CASE WHEN crawl_id = lo THEN 'a' WHEN crawl_id = hi THEN 'b' END AS side FROM ({_SIDES}) p JOIN (SELECT {sql.host('url')} AS h, min(crawl_id) AS lo, max(crawl_id) AS hi FROM page_audit GROUP BY 1) USING (h)"


def _sides(spark, d, pages=None):
    pages = (pages if pages is not None else _pages(spark, d)).withColumn("_h", urls.host(F.col("url")))
    ends = pages.groupBy("_h").agg(F.min("crawl_id").alias("_lo"), F.max("crawl_id").alias("_hi"))
    both = pages.join(ends, "_h")
    return both.filter("crawl_id = _lo").drop("_h", "_lo", "_hi"), both.filter("crawl_id = _hi AND _hi > _lo").drop("_h", "_lo", "_hi")


_DIFFED = [c for c in compare.WATCHED if c in ("status_code", "title", "title_len", "meta_description", "h1", "word_count", "canonical", "redirect_url", "indexable", "depth", "internal_links")]
_LASTS = "SELECT {k} AS key, {cols} FROM ({ab}) WHERE side = '{s}' GROUP BY 1"


def _last(side: str) -> str:
    cols = ", ".join(f"coalesce(CAST(arg_max(struct_pack(v := {c}), page_id).v AS VARCHAR), '') AS {c}" for c in _DIFFED)
    return _LASTS.format(k=sql.compare_key("url"), cols=cols, ab=_AB, s=side)


_CHANGED = "list_filter([" + ", ".join(f"CASE WHEN a.{c} <> b.{c} THEN '{c}' END" for c in _DIFFED) + "], lambda f: f IS NOT NULL)"
_DIFF = f"""SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN len({_CHANGED}) > 0 THEN 'changed' ELSE 'unchanged' END AS kind,
    CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN array_to_string({_CHANGED}, ',') ELSE '' END AS fields FROM ({_last('a')}) a FULL JOIN ({_last('b')}) b ON a.key = b.key"""


def _page_diff(spark, d):
    keep = ["page_id", "url", "crawl_id", *_DIFFED]
    a, b = _sides(spark, d, _pages(spark, d).select(*keep))
    return compare.page_diff(a, b, "page_id")


@query(_DIFF)
def crawl_diff(spark, d):
    return _page_diff(spark, d)


@query(f"SELECT kind, count(*) AS pages FROM ({_DIFF}) GROUP BY kind")
def crawl_diff_summary(spark, d):
    return compare.diff_summary(_page_diff(spark, d))


def _count(cond: str, name: str) -> str:
    return f"count(*) FILTER ({cond}) AS {name}"


@query(
    "SELECT crawl_id, count(*) AS pages, " + ", ".join(_count(f"coalesce(status_code, 0) BETWEEN {n}00 AND {n}99", f"codes_{n}xx") for n in (2, 3, 4, 5)) + ", "
    + ", ".join(_count(c, n) for c, n in (
        ("coalesce(status_code, 0) NOT BETWEEN 200 AND 599", "codes_other"), ("coalesce(status_code, 0) >= 400 OR coalesce(error, '') <> ''", "errors"), ("indexable", "indexable"), ("NOT indexable", "noindex"),
        ("coalesce(redirect_url, '') <> ''", "redirects"), ("coalesce(title, '') = ''", "missing_title"), ("coalesce(title, '') <> '' AND coalesce(title_len, 0) > 60", "title_too_long"),
        ("coalesce(meta_description, '') = ''", "missing_meta"), ("length(coalesce(meta_description, '')) > 160", "meta_too_long"), ("coalesce(h1, '') = ''", "missing_h1"), ("coalesce(canonical, '') = ''", "missing_canonical"),
        ("coalesce(word_count, 0) < 200", "thin"), ("coalesce(response_time, 0) > 3", "slow"),
    ))
    + ", max(coalesce(depth, 0)) AS max_depth, CASE WHEN count(*) > 0 THEN floor((coalesce(sum(CAST(round(coalesce(depth, 0) * 100) AS BIGINT)), 0) * 200 + count(*) * 100) / (count(*) * 200)) / 100 ELSE 0 END AS avg_depth, CASE WHEN count(*) FILTER (response_time <> 0) > 0 THEN floor((coalesce(sum(CAST(round(nullif(response_time, 0) * 100) AS BIGINT)), 0) * 200 + count(*) FILTER (response_time <> 0) * 100) / (count(*) FILTER (response_time <> 0) * 200)) / 100 ELSE 0 END AS avg_response_time FROM page_audit GROUP BY crawl_id"
)
def crawl_totals(spark, d):
    return compare.totals(_pages(spark, d), ["crawl_id"])


@query(
    f"""WITH i AS (SELECT s.side, x.url, coalesce(nullif(trim(regexp_replace(trim(regexp_replace(issue, '\\s*\\([^)]*\\)\\s*$', '')), '^\\d+\\s+', '')), ''), issue) AS issue FROM (SELECT page_id, url, unnest(issues) AS issue FROM ({sql.ISSUES})) x JOIN ({_AB}) s USING (page_id) WHERE s.side IS NOT NULL),
    u AS (SELECT issue, url, max(CASE WHEN side = 'a' THEN 1 ELSE 0 END) AS ia, max(CASE WHEN side = 'b' THEN 1 ELSE 0 END) AS ib FROM i GROUP BY ALL)
    SELECT issue, CAST(sum(ia) AS BIGINT) AS a, CAST(sum(ib) AS BIGINT) AS b, CAST(sum(ib) - sum(ia) AS BIGINT) AS delta, CAST(sum(ia * (1 - ib)) AS BIGINT) AS only_a, CAST(sum(ib * (1 - ia)) AS BIGINT) AS only_b, CAST(sum(ia * ib) AS BIGINT) AS both FROM u GROUP BY issue"""
)
def crawl_issue_diff(spark, d):
    a, b = _sides(spark, d, audit.page_issues(_pages(spark, d)).select("url", "crawl_id", "issues"))
    return compare.issue_diff(a, b)


@query(f"SELECT {sql.first_segment('url')} AS path, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'b') - count(*) FILTER (side = 'a') AS delta FROM ({_AB}) WHERE side IS NOT NULL GROUP BY 1 ORDER BY a + b DESC, path LIMIT 30")
def crawl_structure_diff(spark, d):
    a, b = _sides(spark, d, _pages(spark, d).select("url", "crawl_id"))
    return compare.structure_diff(a, b, 30)


# ---- sitemaps: the last snapshot's addresses stand for a site's sitemap ----

_MAP = "SELECT DISTINCT url FROM page_snapshots s JOIN (SELECT site, max(snap_no) AS snap_no FROM page_snapshots GROUP BY site) USING (site, snap_no)"
_CRAWL = f"SELECT {sql.sitemap_key('url')} AS key, max(page_id) AS seq, arg_max(url, page_id) AS url, arg_max(struct_pack(v := status_code), page_id).v AS status_code, arg_max(struct_pack(v := indexable), page_id).v AS indexable, arg_max(struct_pack(v := redirect_url), page_id).v AS redirect_url, arg_max(struct_pack(v := canonical), page_id).v AS canonical FROM page_audit GROUP BY 1"
_NUM = "(?:/page/\\d+/?$)|(?:[?&]_?(?:page|paged|pg)=\\d+)"


def _listed(spark, d):
    snaps = table(spark, d, "page_snapshots").select("site", "snap_no", "url")
    last = snaps.groupBy("site").agg(F.max("snap_no").alias("snap_no"))
    return snaps.join(last, ["site", "snap_no"]).select("url").distinct()


@query(
    f"""SELECT key, url FROM ({_CRAWL}) WHERE coalesce(status_code, 0) IN (0, 200) AND coalesce(indexable, true) AND coalesce(redirect_url, '') = '' AND NOT {sql.non_html('url')} AND NOT regexp_matches(url, {sql.q(_NUM)})
    AND (coalesce(canonical, '') = '' OR {sql.sitemap_key('canonical')} = key) AND key NOT IN (SELECT {sql.sitemap_key('url')} FROM ({_MAP}))"""
)
def sitemap_missing(spark, d):
    return sitemap.missing_from_sitemap(_pages(spark, d), _listed(spark, d), "page_id")


@query(
    f"""WITH c AS ({_CRAWL}), al AS (SELECT {sql.sitemap_key('canonical')} AS key, arg_min(struct_pack(sc := status_code, ix := indexable, ru := redirect_url), page_id) AS r FROM page_audit WHERE coalesce(canonical, '') <> '' GROUP BY 1),
    s AS (SELECT url AS listed, {sql.sitemap_key('url')} AS key FROM ({_MAP})), l AS (SELECT DISTINCT {sql.sitemap_key('target')} AS key, true AS linked FROM ({_EDGES})),
    m AS (SELECT s.listed, s.key, c.key IS NOT NULL OR al.key IS NOT NULL AS found, CASE WHEN c.key IS NOT NULL THEN c.status_code ELSE al.r.sc END AS sc, CASE WHEN c.key IS NOT NULL THEN c.indexable ELSE al.r.ix END AS ix,
        coalesce(CASE WHEN c.key IS NOT NULL THEN c.redirect_url ELSE al.r.ru END, '') AS ru, l.linked FROM s LEFT JOIN c ON s.key = c.key LEFT JOIN al ON s.key = al.key LEFT JOIN l ON s.key = l.key)
    SELECT 'sitemap_only' AS report, listed, '' AS detail FROM m WHERE NOT found AND NOT regexp_matches(listed, {sql.q(_NUM)})
    UNION ALL SELECT 'pagination', listed, '' FROM m WHERE regexp_matches(listed, {sql.q(_NUM)}) UNION ALL SELECT 'non_200', listed, CAST(sc AS VARCHAR) FROM m WHERE found AND coalesce(sc, 0) NOT IN (0, 200)
    UNION ALL SELECT 'redirects', listed, ru FROM m WHERE found AND ru <> '' AND {sql.sitemap_key('ru')} <> key UNION ALL SELECT 'non_indexable', listed, 'noindex' FROM m WHERE found AND ix = false
    UNION ALL SELECT 'no_inlinks', listed, '' FROM m WHERE found AND sc = 200 AND linked IS NULL"""
)
def sitemap_reports(spark, d):
    pages = _pages(spark, d)
    return sitemap.sitemap_reports(pages, _listed(spark, d), links.edges(pages), "page_id")


@query(
    f"""SELECT u FROM (SELECT DISTINCT regexp_replace(url, '/+$', '') AS u FROM ({_MAP})) WHERE u NOT IN (SELECT regexp_replace(url, '/+$', '') FROM page_audit WHERE url IS NOT NULL)
    AND u NOT IN (SELECT regexp_replace(redirect_url, '/+$', '') FROM page_audit WHERE redirect_url IS NOT NULL) ORDER BY u LIMIT 200"""
)
def sitemap_orphans(spark, d):
    return sitemap.orphans(_listed(spark, d), _pages(spark, d))


@query(f"SELECT h AS host, count(*) AS n FROM (SELECT regexp_extract(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(url, ''), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')), 'https?://', '', 'g'), '/+$', ''), '^www\\.', ''), '^[^/]*') AS h FROM ({_MAP})) WHERE h <> '' AND h <> 'lindenpost.example' GROUP BY h")
def sitemap_foreign_hosts(spark, d):
    return sitemap.foreign_hosts(_listed(spark, d), "www.lindenpost.example")


@query(
    f"""SELECT url, CAST((row_number() OVER (ORDER BY seq, url) - 1) // 50000 + 1 AS INT) AS chunk FROM (SELECT url, min(page_id) AS seq FROM page_audit WHERE status_code = 200 AND coalesce(indexable, true) AND coalesce(redirect_url, '') = ''
    AND coalesce(error, '') = '' AND (coalesce(content_type, '') = '' OR regexp_matches(lower(content_type), 'html|xml')) AND NOT {sql.non_html('url')} AND NOT {sql.pagination('url')}
    AND (coalesce(canonical, '') = '' OR {sql.sitemap_key('canonical')} = {sql.sitemap_key('url')}) GROUP BY url)"""
)
def sitemap_chunks(spark, d):
    return sitemap.chunked(sitemap.sitemap_entries(_pages(spark, d), "page_id")).select("url", "chunk")


# ---- robots rules ----

_ROBOTS = (("disallow", "/archive/"), ("allow", "/archive/*seed"), ("disallow", "*?*page="), ("disallow", "/*.html$"), ("allow", "/shop/*.html$"), ("disallow", ""))


def _robots_sql(kind: str) -> str:
    pq = f"{sql.path('url')} || CASE WHEN {sql.part('url', 4)} <> '' THEN '?' || {sql.part('url', 4)} ELSE '' END"
    hits = [f"CASE WHEN regexp_matches({pq}, {sql.q(urls.pattern_regex(p).replace(chr(92) + 'z', '$'))}) OR regexp_matches(url, {sql.q(urls.pattern_regex(p).replace(chr(92) + 'z', '$'))}) THEN {len(p)} END" for k, p in _ROBOTS if k == kind and p]
    return f"coalesce(greatest({', '.join(hits)}), -1)"


@query(f"SELECT page_id, {_robots_sql('disallow')} <= {_robots_sql('allow')} AS allowed FROM page_audit")
def robots_decisions(spark, d):
    rules = spark.createDataFrame(list(_ROBOTS), "kind string, pattern string")
    return robots.decide(_pages(spark, d).select("page_id", "url"), rules).select("page_id", "allowed")


# ---- nested reports ----


_HREFLANG = "json_extract(page, '$.hreflang')"
_DECLARED = f"WITH {general._RECORDS}, d AS (SELECT {general._field('page', 'url')}, {general._field('v', 'lang')}, {general._field('v', 'href')} FROM ({general._each('q', 'rec_id, page_pos, page', general._listed(_HREFLANG))}) WHERE json_type(v) <> 'NULL')"


@query(
    f"""{_DECLARED}, l AS (SELECT * FROM d WHERE coalesce(lang, '') <> ''),
    t AS (SELECT DISTINCT url, href FROM l WHERE lang <> 'x-default' AND href IS NOT NULL)
    SELECT * FROM (SELECT 'invalid_code' AS kind, count(*) AS n FROM l WHERE NOT regexp_full_match(lang, 'x-default|[a-z]{{2,3}}(-[A-Z]{{2}})?')
    UNION ALL SELECT 'dup_x_default', count(*) FROM (SELECT url FROM l WHERE lang = 'x-default' GROUP BY url HAVING count(*) > 1)
    UNION ALL SELECT 'no_return_tag', count(*) FROM t WHERE href IN (SELECT url FROM l WHERE url IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM l WHERE l.url = t.href AND l.href = t.url)) WHERE n > 0"""
)
def hreflang_issues(spark, d):
    nodes = cut(nested.node_table(table(spark, d, "page_records"), ("results", "results.url", "hreflang", "hreflang.lang", "hreflang.href")))
    pages = nested.flat_table(nodes, "pages").select("rec_id", "page_pos", "url")
    declared = nested.flat_table(nodes, "hreflang").join(pages, ["rec_id", "page_pos"]).select("url", "lang", "href")
    return links.hreflang_issues(declared).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_RATED = f"WITH {general._RECORDS}, f AS (SELECT rec_id, page_pos, {general._PERF} FROM q WHERE json_type(perf) <> 'NULL')"
_FAST = f"{_RATED}, w AS (SELECT rec_id, page_pos, load_time_s, ttfb_ms, html_kb, dom_nodes, list_filter([CASE WHEN load_time_s > 3 THEN 'Slow load' END, CASE WHEN ttfb_ms > 800 THEN 'High TTFB' END, CASE WHEN html_kb > 150 THEN 'Heavy HTML' END, CASE WHEN dom_nodes > 1500 THEN 'Large DOM' END], lambda x: x IS NOT NULL) AS warnings FROM f)"


@query(f"{_FAST} SELECT count(*) AS pages, round(avg(load_time_s), 2) AS avg_load, round(avg(ttfb_ms), 0) AS avg_ttfb, round(avg(html_kb), 1) AS avg_kb, count_if(load_time_s > 3)::BIGINT AS slow, count_if(len(warnings) > 0)::BIGINT AS with_warnings, count_if(len(warnings) = 0)::BIGINT AS clean FROM w")
def performance_totals(spark, d):
    """Speed figures of pages whose record has them."""
    return reports.performance_totals(_perf(spark, d))


def _perf(spark, d):
    names = ("load_time_s", "ttfb_ms", "html_kb", "dom_nodes")
    nodes = nested.node_table(table(spark, d, "page_records"), ("results", "results.perf", *(f"results.perf.{n}" for n in names)))
    cols = {n: F.col(n) for n in names}
    return nested.flat_table(nodes, "perf").select("rec_id", "page_pos", *names).withColumn("warnings", scoring.speed_warnings(cols)).withColumn("score", scoring.speed_score(cols))


@query(
    f"""{_FAST} SELECT *, CAST(100 - CASE WHEN load_time_s > 3 THEN 20 ELSE 0 END - CASE WHEN ttfb_ms > 800 THEN 15 ELSE 0 END - CASE WHEN html_kb > 150 THEN 10 ELSE 0 END - CASE WHEN dom_nodes > 1500 THEN 10 ELSE 0 END AS INT) AS score
    FROM w ORDER BY load_time_s DESC NULLS LAST, html_kb DESC NULLS LAST, rec_id, page_pos LIMIT 100"""
)
def slowest_pages(spark, d):
    return reports.slowest(_perf(spark, d))


# ---- HTML made from rows, and read back ----

_TRIP = "SELECT page_id, trim(coalesce(title, '')) AS title, coalesce(meta_description, '') AS meta_description, len(list_filter(coalesce(internal_link_urls, []), lambda e: e IS NOT NULL)) AS anchors FROM page_audit"


@query(_TRIP)
def html_round_trip(spark, d):
    """Title, description and number of anchors, parsed from HTML rendered from the rows."""
    html = html_page.render_html(F.col("title"), F.col("meta_description"), F.col("h1"), F.col("canonical"), F.col("body_text"), F.col("internal_link_urls"))
    parsed = spread(_pages(spark, d).select("page_id", html.alias("html"), "url")).select("page_id", "html", html_page.parse_html("html", "url").alias("p"))
    return parsed.select("page_id", "p.title", "p.meta_description", F.regexp_count("html", F.lit("<a href=")).cast("long").alias("anchors"))


@query()
def html_links(spark, d):
    """Links by region, parsed from HTML rendered from the rows."""
    html = html_page.render_html(F.col("title"), F.col("meta_description"), F.col("h1"), F.col("canonical"), F.col("body_text"), F.col("internal_link_urls"))
    rows = spread(_pages(spark, d).select(html.alias("html"), F.trim("url").alias("url"))).select(html_page.parse_html("html", "url").alias("p")).select(F.explode_outer("p.internal_link_urls").alias("e")).filter("e IS NOT NULL")  # else the UDF runs twice, once for an inferred filter
    return rows.groupBy("e.placement").agg(F.count(F.lit(1)).alias("links"))


@query(
    f"""SELECT page_id, length(trim(coalesce(title, ''))) AS title_len, length(coalesce(meta_description, '')) AS meta_len, {sql.pagination('url')} AS is_pagination, lower({sql.part('url', 1)}) = 'https' AS is_https,
    array_to_string({sql.hygiene('url')}, ', ') AS url_issues FROM page_audit WHERE status_code = 200"""
)
def audit_pipeline(spark, d):
    """Audit rows made from fetched pages whose HTML is rendered from the rows."""
    html = html_page.render_html(F.col("title"), F.col("meta_description"), F.col("h1"), F.col("canonical"), F.col("body_text"), F.col("internal_link_urls"))
    none = F.lit(None).cast("string")
    fetched = _pages(spark, d).filter("status_code = 200").select(
        "page_id", "url", "url", "status_code", F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"), html.alias("html"), none.alias("raw_html"), F.array().cast("array<struct<url:string,status:int>>").alias("history"), "response_time", "error"
    ).toDF("page_id", "url", "final_url", "status_code", "headers", "html", "raw_html", "history", "response_time", "error")
    rows = extract.audit_rows(fetched)
    return rows.select("page_id", F.col("title_len").cast("long").alias("title_len"), F.col("meta_len").cast("long").alias("meta_len"), "is_pagination", F.col("security.is_https").alias("is_https"), F.array_join("url_issues", ", ").alias("url_issues"))


def _fetched(pages):
    """What a fetch delivered for each row: its address and answer, hops, content type and HTML rendered from the row."""
    html = html_page.render_html(F.col("title"), F.col("meta_description"), F.col("h1"), F.col("canonical"), F.col("body_text"), F.col("internal_link_urls"))
    answered = F.coalesce("status_code", F.lit(0)) > 0
    ahead = F.when(F.col("status_code").between(300, 399), F.col("redirect_url"))
    hops = F.greatest(F.lit(0), F.coalesce(F.size("redirect_chain"), F.lit(0)) - 1)
    headers = {"Content-Type": F.col("content_type"), "Location": ahead, "X-Robots-Tag": F.when(~F.col("indexable"), "noindex")}
    named = F.map_filter(F.create_map(*(x for k, v in headers.items() for x in (F.lit(k), v))), lambda _k, v: v.isNotNull())
    return pages.select(
        "page_id", F.coalesce(F.nullif("original_url", F.lit("")), "url").alias("url"), F.col("url").alias("final_url"), "status_code", named.alias("headers"), F.when(answered, html).alias("html"),
        F.lit(None).cast("string").alias("raw_html"), F.slice("redirect_chain", F.lit(1), hops).cast("array<struct<url:string,status:int>>").alias("history"), "response_time", "error",
    )


@query()
def audit_pipeline_full(spark, d):
    """Audit rows of all fetched pages, whatever their answer, with redirects, links and issues; audit_pipeline is the part that SQL states."""
    rows = extract.audit_rows(_fetched(_pages(spark, d)))
    return rows.select(
        "page_id", "url", "original_url", "status_code", "content_type", "title", "title_len", "meta_len", "indexable", "canonical_kind", "is_pagination", F.col("security.is_https").alias("is_https"), "url_issues",
        "redirect_url", "redirect_kind", "redirect_status", "redirect_hops", "redirect_chain", "internal_links", "internal_link_urls", "external_links", "issues", "error",
    )


@query("SELECT page_id, CASE WHEN regexp_matches(body_text, '(?is)wp-content|/wp-includes/|/wp-json/') THEN 'wordpress' END AS cms, 0 AS trackers FROM page_audit")
def page_signatures(spark, d):
    """Content system and number of trackers that the text names."""
    body = F.coalesce("body_text", F.lit(""))
    return _pages(spark, d).select("page_id", detect.content_system(body).alias("cms"), F.size(detect.trackers(body)).alias("trackers"))


# ---- near-duplicates ----


def _shingles(spark, d):
    return duplicates.shingle_sets(table(spark, d, "documents"), "doc_id", "text")


_CONTENT = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''\\-]{{1,}}'), lambda t: t NOT IN ({', '.join(sql.q(w) for w in text.STOP_WORDS)}))"
_SETS = f"""w AS MATERIALIZED (SELECT doc_id, {_CONTENT} AS w FROM documents WHERE len({_CONTENT}) >= 20), r AS (SELECT t FROM (SELECT doc_id, unnest(list_distinct(w)) AS t FROM w) GROUP BY t HAVING count(*) = 1),
    k AS (SELECT doc_id, list(t ORDER BY i) AS w FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE t NOT IN (SELECT t FROM r) GROUP BY doc_id),
    s AS MATERIALIZED (SELECT min(doc_id) AS id, x, len(x) AS n FROM (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS x FROM k WHERE len(w) >= 5) GROUP BY x)"""


@query(
    f"""WITH {_SETS}, e AS MATERIALIZED (SELECT id, n, unnest(x) AS g FROM s), p AS (SELECT a.id AS class_a, b.id AS class_b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
    SELECT class_a, class_b, round(c / (na + nb - c), 4) AS similarity FROM p WHERE c / (na + nb - c) >= 0.8"""
)
def near_duplicates(spark, d):
    return duplicates.similar_pairs(_shingles(spark, d))


@query()
def near_duplicate_classes(spark, d):
    return duplicates.document_classes(table(spark, d, "documents"), "doc_id", "text")


# ---- keywords: parts stand for keywords, their sales for interest, prices for result counts ----

_KW = "SELECT p_name AS keyword, min(p_size % 11) AS ac_rank, min(CAST(floor(p_retailprice * 1000) AS BIGINT)) AS result_count FROM part GROUP BY p_name"
_POINTS = "SELECT p_name AS keyword, date_trunc('month', l_shipdate) AS ts, least(100.0, sum(l_quantity) / 10) AS interest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"
_TREND = f"""SELECT keyword, count(*) AS points, round(avg(v), 4) AS mean_interest, CASE WHEN count(*) >= 6 THEN round(greatest(-100, least(100, t - h)), 1) ELSE 0 END AS direction,
    CASE WHEN count(*) < 6 THEN 0 WHEN h > 0 THEN round(greatest(-100, least(100, (t - h) / h * 100)), 1) WHEN t > 0 THEN 100 ELSE 0 END AS velocity FROM (
    SELECT keyword, v, avg(v) FILTER (a <= 3) OVER (PARTITION BY keyword) AS h, avg(v) FILTER (z <= 3) OVER (PARTITION BY keyword) AS t FROM (
    SELECT keyword, coalesce(interest, 0) AS v, row_number() OVER (PARTITION BY keyword ORDER BY ts) AS a, row_number() OVER (PARTITION BY keyword ORDER BY ts DESC) AS z FROM ({_POINTS}))) GROUP BY keyword, h, t"""


def _points(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_name").alias("keyword"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(F.least(F.lit(100.0), F.sum("l_quantity") / 10).alias("interest"))


@query(_TREND)
def trend_features(spark, d):
    return keywords.trend_features(_points(spark, d), ["keyword"])


@query(f"SELECT keyword, date_trunc('month', ts) AS ts, interest, rank FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY interest DESC, ts) AS rank FROM ({_POINTS})) WHERE rank <= 3")
def best_months(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("keyword").orderBy(F.col("interest").desc(), "ts")
    return _points(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


@query(
    f"""WITH k AS ({_KW}), c AS (SELECT keyword, ac_rank, result_count, CASE WHEN coalesce(result_count, 0) > 0 THEN greatest(0, least(100, (log10(result_count) - 3) / 7 * 100)) ELSE 50 END AS comp FROM k)
    SELECT keyword, round(CASE WHEN coalesce(ac_rank, 0) = 0 THEN 25 ELSE greatest(0, 100 - (ac_rank - 1) * 12.0) END * 0.45 + least(100, coalesce(mean_interest, 0) * 1.5) * 0.40 + least(100, (log10(greatest(coalesce(result_count, 0), 1)) - 2) / 6 * 100) * 0.15, 1) AS volume_proxy,
    round(CASE WHEN comp = 0 THEN 50 ELSE comp END, 1) AS competition FROM c LEFT JOIN ({_TREND}) USING (keyword)"""
)
def keyword_scores(spark, d):
    k = table(spark, d, "part").groupBy(F.col("p_name").alias("keyword")).agg(F.min(F.col("p_size") % 11).alias("ac_rank"), F.min(F.floor(F.col("p_retailprice") * 1000)).alias("result_count"))
    comp = scoring.competition(F.col("result_count"))
    serp = k.select("keyword", "result_count", comp.alias("competition"), F.lit(0.0).alias("commercial_intent"))
    scored = keywords.scored_keywords(k.select("keyword", "ac_rank"), keywords.trend_features(_points(spark, d), ["keyword"]), serp)
    return scored.select("keyword", "volume_proxy", "competition")


# ---- events ----


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return streams.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY user_id, s"""
)
def events_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query()
def host_pacing(spark, d):
    """Pace and error streak after every answer of every host, in the order of fetching."""
    log = _pages(spark, d).select(urls.host(F.col("url")).alias("host"), F.col("page_id").alias("seq"), "status_code", "error", F.lit(None).cast("string").alias("waf"))
    return streams.batch_pacing(log).groupBy("host").agg(F.round(F.max("pace"), 4).alias("slowest"), F.max("streak").alias("streak"), F.count("notice").alias("notices"))


# ---- snapshots kept ----


@query("SELECT folder, count(DISTINCT file_name) AS files, count(DISTINCT file_name) FILTER (epoch(loaded_at) >= 1935000000 - 2592000) AS kept FROM saved_crawls GROUP BY folder")
def retention(spark, d):
    once = table(spark, d, "saved_crawls").groupBy("folder", "file_name").agg(F.max("loaded_at").alias("t"))
    return once.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.count_if(sinks.is_kept(F.unix_timestamp("t"), F.lit(1935000000))).alias("kept"))


@query("SELECT '2031-05-01T00:00:00Z' AS ts, 'audit' AS crawl, '' AS seed, url, coalesce(title, '') AS title, coalesce(meta_description, '') AS meta_description FROM page_audit WHERE coalesce(url, '') <> ''")
def title_history(spark, d):
    return sinks.title_history(_pages(spark, d), "audit", 1935360000, "")
