"""Queries of the general problems p1, p2, p4, p5, p6, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions.page_key import page_key_sql
from seamark.operators import heavy_keys, nested, orphans, schema_drift, snapshots
from seamark.session import cut, table


def _pages(spark, d):
    return table(spark, d, "page_audit")


def p1_found(spark, d):
    return schema_drift.field_changes(table(spark, d, "saved_crawls"))


def p1_report(spark, d):
    return schema_drift.change_report(schema_drift.schema_changes(table(spark, d, "saved_crawls")))


def p1_table(spark, d):
    return schema_drift.consistent_table(table(spark, d, "saved_crawls"))


def p2_found(spark, d):
    return heavy_keys.hot_keys(_pages(spark, d))


def p2_targets(spark, d):
    days = {c: F.col(c).cast("string") for c in ("first_day", "last_day")}
    return heavy_keys.target_figures(_pages(spark, d)).withColumns(days)


def p2_sites(spark, d):
    pages = _pages(spark, d)
    return heavy_keys.site_figures(cut(heavy_keys.target_figures(pages)), pages)


def p4_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "page_snapshots"))


def p5_found(spark, d):
    return nested.page_children(table(spark, d, "page_records"))


def _flat(spark, d, name):
    kind, members = nested.TABLES[name]
    return nested.flat_table(nested.node_table(table(spark, d, "page_records"), ("results", kind, *(f"{kind}.{m}" for m in members))), name)


def p5_pages(spark, d):
    return _flat(spark, d, "pages").select("rec_id", "page_pos", "url", "status_code", "title")


def p5_redirect_chain(spark, d):
    return _flat(spark, d, "redirect_chain").select("rec_id", "page_pos", "pos", F.coalesce("url", "value").alias("url"), "status")


def p5_perf(spark, d):
    return _flat(spark, d, "perf").select("rec_id", "page_pos", *nested.TABLES["perf"][1])


def p5_nodes(spark, d):
    """How many nodes of each type there are, how many of them lie in a parent's interval, and under how many parents."""
    tied = nested.with_parents(nested.node_table(table(spark, d, "page_records")))
    per = tied.groupBy("node_type", "rec_id", "parent_pre").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("node_type").agg(F.sum("n").alias("nodes"), F.sum(F.when(F.col("parent_pre").isNotNull(), F.col("n")).otherwise(0)).alias("held"), F.count_if(F.col("parent_pre").isNotNull()).alias("parents"))


def p6_found(spark, d):
    found = orphans.Cascade(_pages(spark, d)).orphans(direct_only=True)
    return found.select("page_id", "ref_field", "target_key", "orphan_kind").distinct()


def p6_report(spark, d):
    return orphans.Cascade(_pages(spark, d)).report()


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_table": p1_table, "p5_found": p5_found, "p5_pages": p5_pages, "p5_redirect_chain": p5_redirect_chain, "p5_perf": p5_perf, "p5_nodes": p5_nodes, "p2_found": p2_found, "p2_targets": p2_targets, "p2_sites": p2_sites, "p4_found": p4_found, "p6_found": p6_found, "p6_report": p6_report}

_ENTRIES = f"SELECT crawl_day, e.placement AS placement, {page_key_sql('e.target')} AS k FROM (SELECT crawl_day, unnest(internal_link_urls) AS e FROM page_audit) WHERE e IS NOT NULL"
_KEYED = f"SELECT *, {page_key_sql('url')} AS url_key FROM page_audit"
_HOST = "regexp_extract({}, '^[^/?]*')"


def _said(j: str) -> str:
    """A list or object written as JSON text counts as what it says."""
    return f"CASE WHEN json_type({j}) = 'VARCHAR' AND regexp_matches(ltrim({j} ->> '$'), '^[\\[{{]') AND json_valid({j} ->> '$') THEN TRY_CAST({j} ->> '$' AS JSON) ELSE {j} END"


def _listed(j: str) -> str:
    s = _said(j)
    return f"CASE WHEN {j} IS NULL OR json_type({s}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({s}) = 'ARRAY' THEN CAST({s} AS JSON[]) ELSE [{s}] END"


def _each(src: str, cols: str, items: str) -> str:
    return f"SELECT {cols}, unnest(l) AS v, unnest(range(0, len(l))) AS pos FROM (SELECT {cols}, {items} AS l FROM {src})"


_RECORDS = f"""r AS MATERIALIZED (SELECT rec_id, TRY_CAST(payload AS JSON) AS j FROM (SELECT rec_id, max(struct_pack(t := loaded_at, p := payload)).p AS payload FROM page_records GROUP BY rec_id) WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
        p AS MATERIALIZED (SELECT rec_id, CAST(pos AS INT) AS page_pos, {_said('v')} AS page FROM ({_each('r', 'rec_id', _listed("json_extract(j, '$.results')"))}) WHERE json_type(v) <> 'NULL'),
        q AS MATERIALIZED (SELECT *, {_said("json_extract(page, '$.perf')")} AS perf FROM p)"""
_TEXT = "CASE WHEN json_type({0}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {0} ->> '$' END"


def _field(j: str, name: str, kind: str = "VARCHAR") -> str:
    return f"TRY_CAST({_TEXT.format(f'json_extract({j}, {chr(39)}$.{name}{chr(39)})')} AS {kind}) AS {name}"


_PERF = ", ".join(_field("perf", n, "DOUBLE") for n in nested.TABLES["perf"][1])
_OBJECT = "CASE WHEN json_type({0}) = 'OBJECT' THEN {0} ELSE CAST('{{}}' AS JSON) END"

ORACLES = {
    "p5_pages": f"WITH {_RECORDS} SELECT rec_id, page_pos, {_field('page', 'url')}, {_field('page', 'status_code', 'INT')}, {_field('page', 'title')} FROM p",
    "p5_redirect_chain": f"""
        WITH {_RECORDS} SELECT rec_id, page_pos, CAST(pos AS INT) AS pos, CASE WHEN json_type(v) = 'OBJECT' THEN {_TEXT.format("json_extract(v, '$.url')")} ELSE {_TEXT.format('v')} END AS url, {_field('v', 'status', 'INT')}
        FROM ({_each('q', 'rec_id, page_pos', _listed("json_extract(page, '$.redirect_chain')"))}) WHERE json_type(v) <> 'NULL'""",
    "p5_perf": f"WITH {_RECORDS} SELECT rec_id, page_pos, {_PERF} FROM q WHERE json_type(perf) <> 'NULL'",
    "p5_found": f"""
        WITH {_RECORDS},
        c AS (
         SELECT rec_id, page_pos, 'redirect_chain' AS child_name, v, pos FROM ({_each('q', 'rec_id, page_pos', _listed("json_extract(page, '$.redirect_chain')"))})
         UNION ALL SELECT rec_id, page_pos, 'hreflang', v, pos FROM ({_each('q', 'rec_id, page_pos', _listed("json_extract(page, '$.hreflang')"))})
         UNION ALL SELECT rec_id, page_pos, 'third_party_hosts', v, pos FROM ({_each('q', 'rec_id, page_pos', _listed("json_extract(perf, '$.third_party_hosts')"))})
         UNION ALL SELECT rec_id, page_pos, 'warnings', v, pos FROM ({_each('q', 'rec_id, page_pos', _listed("json_extract(perf, '$.warnings')"))})),
        o AS (SELECT rec_id, page_pos, {_said("json_extract(page, '$.og_tags')")} AS og FROM q),
        k AS (SELECT rec_id, page_pos, unnest(json_keys(og)) AS k, og FROM o WHERE json_type(og) = 'OBJECT'),
        g AS (SELECT rec_id, page_pos, k FROM k WHERE json_type(json_extract(og, '$."' || k || '"')) <> 'NULL'
         UNION ALL SELECT rec_id, page_pos, v ->> '$.property' FROM ({_each("(SELECT * FROM o WHERE json_type(og) = 'ARRAY')", 'rec_id, page_pos', 'CAST(og AS JSON[])')}) WHERE json_type(v) = 'OBJECT' AND json_type(json_extract(v, '$.content')) <> 'NULL')
        SELECT rec_id, page_pos, 'results' AS child_name, CAST(page_pos AS VARCHAR) AS item_name FROM p
        UNION SELECT rec_id, page_pos, child_name, CAST(pos AS VARCHAR) FROM c WHERE json_type(v) <> 'NULL'
        UNION SELECT rec_id, page_pos, 'og_tags', CASE WHEN starts_with(k, 'og:') THEN substr(k, 4) ELSE k END FROM g WHERE k IS NOT NULL""",
    "p2_found": f"""
        WITH e AS ({_ENTRIES}), n AS (SELECT count(*) AS n FROM e)
        SELECT 'site' AS key_kind, {_HOST.format('k')} AS hot_key FROM e GROUP BY hot_key HAVING count(*) >= {heavy_keys.SITE_SHARE} * (SELECT n FROM n)
        UNION ALL SELECT 'target', k FROM e GROUP BY k HAVING count(*) >= {heavy_keys.TARGET_SHARE} * (SELECT n FROM n)""",
    "p2_targets": f"""
        SELECT k AS target_key, count(*) AS entries, CAST(sum(CASE WHEN placement = 'main' THEN 1 ELSE 0 END) AS BIGINT) AS main_entries,
            CAST(min(crawl_day) AS VARCHAR) AS first_day, CAST(max(crawl_day) AS VARCHAR) AS last_day FROM ({_ENTRIES}) GROUP BY k""",
    "p2_sites": f"""
        WITH l AS (SELECT {_HOST.format('k')} AS site, count(*) AS entries, CAST(sum(CASE WHEN placement = 'main' THEN 1 ELSE 0 END) AS BIGINT) AS main_entries,
                count(DISTINCT k) AS targets FROM ({_ENTRIES}) GROUP BY 1),
            o AS (SELECT {_HOST.format('url_key')} AS site, count(*) AS page_rows, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS word_count FROM ({_KEYED}) GROUP BY 1)
        SELECT site, coalesce(entries, 0) AS entries, coalesce(main_entries, 0) AS main_entries, coalesce(targets, 0) AS targets,
            coalesce(page_rows, 0) AS page_rows, coalesce(word_count, 0) AS word_count FROM l FULL JOIN o USING (site)""",
    "p4_found": rf"""
        WITH k AS (SELECT *, {page_key_sql('url')} AS page_key FROM page_snapshots),
        s AS (SELECT site, snap_no, page_key, delivered_at, coalesce(CAST(status_code AS VARCHAR), '') AS sc,
                trim(regexp_replace(coalesce(title, ''), '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS t,
                {page_key_sql('canonical', _HOST.format('page_key'))} AS c FROM k),
        l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY site, snap_no, page_key ORDER BY delivered_at DESC, sc, t, c) = 1),
        o AS (SELECT site, snap_no, lag(snap_no) OVER (PARTITION BY site ORDER BY snap_no) AS prev FROM (SELECT DISTINCT site, snap_no FROM page_snapshots)),
        n AS (SELECT l.*, o.prev FROM l JOIN o USING (site, snap_no) WHERE o.prev IS NOT NULL),
        b AS (SELECT l.*, o.snap_no AS nxt FROM l JOIN o ON o.site = l.site AND o.prev = l.snap_no)
        SELECT coalesce(n.site, b.site) AS site, coalesce(n.snap_no, b.nxt) AS snap_no, coalesce(n.page_key, b.page_key) AS page_key,
            CASE WHEN b.site IS NULL THEN 'added' WHEN n.site IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM n FULL JOIN b ON n.site = b.site AND n.snap_no = b.nxt AND n.page_key = b.page_key
        WHERE b.site IS NULL OR n.site IS NULL OR n.sc <> b.sc OR n.t <> b.t OR n.c <> b.c""",
    "p6_found": f"""
        WITH p AS (SELECT *, {_HOST.format('url_key')} AS host FROM ({_KEYED})),
        r AS (SELECT page_id, crawl_day, 'internal_link_urls' AS ref_field, {page_key_sql('e.target', 'host')} AS target_key FROM (SELECT page_id, crawl_day, host, unnest(internal_link_urls) AS e FROM p)
            UNION SELECT page_id, crawl_day, 'canonical', {page_key_sql('canonical', 'host')} FROM p
            UNION SELECT page_id, crawl_day, 'redirect_url', {page_key_sql('redirect_url', 'host')} FROM p),
        h AS (SELECT url_key, crawl_day AS day, bool_and(coalesce(status_code IN (404, 410), false)) AS gone FROM p GROUP BY ALL),
        f AS (SELECT url_key, min(day) AS first_day FROM h GROUP BY url_key),
        j AS (SELECT r.*, h.gone, f.first_day FROM (SELECT DISTINCT * FROM r WHERE target_key <> '') r ASOF LEFT JOIN h ON r.target_key = h.url_key AND r.crawl_day >= h.day
            LEFT JOIN f ON r.target_key = f.url_key WHERE {_HOST.format('r.target_key')} IN (SELECT host FROM p))
        SELECT DISTINCT page_id, ref_field, target_key, CASE WHEN first_day IS NULL THEN 'missing' WHEN gone IS NULL THEN 'late' ELSE 'deleted' END AS orphan_kind
        FROM j WHERE first_day IS NULL OR gone IS NULL OR gone""",
    "p6_report": f"""
        WITH RECURSIVE p AS MATERIALIZED (SELECT *, {_HOST.format('url_key')} AS host, coalesce(crawl_day, DATE '0001-01-01') AS day FROM ({_KEYED})),
        a AS (SELECT page_id, day, url_key, host, 'internal_link_urls' AS ref_field, unnest(list_distinct(list_transform(internal_link_urls, lambda e: e.target))) AS address FROM p
            UNION ALL SELECT page_id, day, url_key, host, 'canonical', canonical FROM p UNION ALL SELECT page_id, day, url_key, host, 'redirect_url', redirect_url FROM p),
        r AS MATERIALIZED (SELECT page_id, day, url_key, ref_field, {page_key_sql('address', 'host')} AS target_key FROM a WHERE address <> ''),
        h AS (SELECT url_key, day, bool_and(coalesce(status_code IN (404, 410), false)) AS gone FROM p GROUP BY ALL),
        f AS (SELECT DISTINCT url_key FROM h),
        j AS MATERIALIZED (SELECT r.*, h.day AS target_day, CASE WHEN f.url_key IS NULL THEN 'missing' WHEN h.gone IS NULL THEN 'late' WHEN h.gone THEN 'deleted' END AS kind
            FROM r ASOF LEFT JOIN h ON r.target_key = h.url_key AND r.day >= h.day LEFT JOIN f ON r.target_key = f.url_key
            WHERE target_key <> '' AND {_HOST.format('r.target_key')} IN (SELECT host FROM p)),
        e AS MATERIALIZED (SELECT DISTINCT url_key, day, target_key, target_day FROM j WHERE kind IS NULL AND (target_key, target_day) <> (url_key, day)),
        o(k, d, n) USING KEY (k, d) AS (SELECT DISTINCT url_key, day, 0 FROM j WHERE kind IS NOT NULL
            UNION SELECT DISTINCT e.url_key, e.day, o.n + 1 FROM o JOIN e ON e.target_key = o.k AND e.target_day = o.d WHERE (e.url_key, e.day) NOT IN (SELECT (k, d) FROM recurring.o)),
        t AS (SELECT j.*, coalesce(kind, 'inherited') AS orphan_kind, CASE WHEN kind IS NULL THEN n + 1 ELSE 0 END AS level FROM j LEFT JOIN o ON kind IS NULL AND k = target_key AND d = target_day
            WHERE kind IS NOT NULL OR (n IS NOT NULL AND target_key <> url_key))
        SELECT ref_field, CASE WHEN day > DATE '0001-01-01' THEN strftime(day, '%Y-%m') END AS month, orphan_kind, CAST(level AS INT) AS level, count(*) AS refs, count(DISTINCT target_key) AS targets FROM t GROUP BY 1, 2, 3, 4""",
}
