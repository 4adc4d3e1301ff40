"""Pieces of DuckDB SQL shared by oracles."""

from __future__ import annotations

from seamark.functions import scoring, urls

URI = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def part(x: str, n: int) -> str:
    return f"regexp_extract(coalesce({x}, ''), {q(URI)}, {n})"


def host(x: str) -> str:
    return f"regexp_replace(lower({part(x, 2)}), '^www\\.', '')"


def path(x: str) -> str:
    return part(x, 3)


def bare(x: str) -> str:
    return f"regexp_replace({x}, '(?i)(?:\\s|/|%20)+$', '')"


def sitemap_key(x: str) -> str:
    u = f"regexp_replace(regexp_replace(coalesce({x}, ''), '^\\s+', ''), '\\s+$', '')"
    return f"CASE WHEN {u} = '' THEN '' ELSE lower('https://' || {host(u)} || {bare(path(u))}) END"


def duplicate_key(x: str) -> str:
    p = bare(f"regexp_replace(regexp_replace({path(x)}, '/page/\\d+/?$', '/'), '/comment-page-\\d+/?$', '/')")
    return f"CASE WHEN coalesce({x}, '') = '' THEN {x} ELSE 'https://' || {host(x)} || CASE WHEN {p} = '' THEN '/' ELSE {p} END END"


def compare_key(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '/+$', ''))"


def first_segment(x: str) -> str:
    return f"'/' || regexp_extract(regexp_replace({path(x)}, '^/+', ''), '^[^/]*/?')"


def pagination(x: str) -> str:
    return f"(regexp_matches({path(x)}, '/page/\\d+/?$') OR regexp_matches({part(x, 4)}, '(?:^|[?&;])\\s*_?(?:page|paged|pg)\\s*=\\s*[2-9]\\d*'))"


def hygiene(x: str) -> str:
    p, query = path(x), part(x, 4)
    flags = [
        f"CASE WHEN regexp_matches({p}, '\\p{{Lu}}') THEN 'uppercase' END", f"CASE WHEN contains({p}, '_') THEN 'underscores' END", f"CASE WHEN contains({x}, ' ') OR contains({p}, '%20') THEN 'contains space' END",
        f"CASE WHEN length({x}) > 115 THEN 'over 115 chars (' || length({x}) || ')' END", f"CASE WHEN contains({p}, '//') THEN 'multiple slashes' END", f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7F]') THEN 'non-ASCII characters' END",
        f"CASE WHEN {query} <> '' THEN 'contains parameters' END", f"CASE WHEN regexp_matches({query}, 'utm_|gclid=|fbclid=') THEN 'tracking parameters' END",
    ]
    return f"list_filter([{', '.join(flags)}], lambda f: f IS NOT NULL)"


def redirect_kind(a: str, b: str) -> str:
    same = f"{host(a)} = {host(b)} AND regexp_replace({path(a)}, '/+$', '') = regexp_replace({path(b)}, '/+$', '') AND {part(a, 4)} = {part(b, 4)}"
    loop = f"{part(a, 1)} = {part(b, 1)} AND lower({part(a, 2)}) = lower({part(b, 2)}) AND {path(a)} = {path(b)} AND {part(a, 4)} = {part(b, 4)}"
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL OR ({loop}) THEN NULL WHEN NOT ({same}) THEN 'other'
        WHEN {part(a, 1)} = 'http' AND {part(b, 1)} <> 'http' THEN 'http_to_https' WHEN {part(a, 2)} <> {part(b, 2)} THEN 'www_normalize'
        WHEN {path(b)} = {path(a)} || '/' OR {path(a)} = {path(b)} || '/' THEN 'trailing_slash' ELSE 'other' END"""


def non_html(x: str) -> str:
    return f"regexp_matches(lower({path(x)}), '\\.(?:{'|'.join(urls.NON_HTML)})$')"


def severity(x: str, summary: bool = False) -> str:
    e, w = (scoring.SUMMARY_ERROR, scoring.SUMMARY_WARN) if summary else (scoring.ERROR, scoring.WARN)
    return f"CASE WHEN regexp_matches(lower({x}), {q(e)}) THEN 'error' WHEN regexp_matches(lower({x}), {q(w)}) THEN 'warn' ELSE 'info' END"


def points(x: str) -> str:
    low = f"lower({x})"
    steps = " ".join(f"WHEN regexp_matches({low}, {q(rx)}) THEN {n}" for rx, n in scoring.PENALTIES)
    return f"CASE {steps} WHEN regexp_matches({low}, {q(scoring.ERROR)}) THEN 10 WHEN regexp_matches({low}, {q(scoring.WARN)}) THEN 3 ELSE 0 END"


#: page_audit with the flags that rules use, then with ``issues``.
FLAGS = f"""SELECT *, coalesce(original_url, coalesce(url, '')) AS asked, coalesce(status_code, 0) AS sc, coalesce(title, '') AS ti, coalesce(title_len, length(coalesce(title, ''))) AS tl,
    coalesce(meta_description, '') AS md, coalesce(h1, '') AS hd, coalesce(canonical_kind, '') AS ck, coalesce(word_count, 0) AS wc, coalesce(redirect_url, '') AS ru FROM page_audit"""
GATED = f"SELECT *, (coalesce(indexable, true) AND NOT {pagination('asked')} AND ru = '' AND ck <> 'canonicalised' AND sc BETWEEN 200 AND 299) AS g, sc BETWEEN 200 AND 399 AS fine, {redirect_kind('asked', 'ru2')} AS rk FROM (SELECT *, nullif(ru, '') AS ru2 FROM ({FLAGS}))"
_HOPS = "'(' || greatest(1, coalesce(redirect_hops, 1)) || CASE WHEN greatest(1, coalesce(redirect_hops, 1)) > 1 THEN ' hops)' ELSE ' hop)' END"
_RULES = [
    f"CASE rk WHEN 'http_to_https' THEN 'HTTP→HTTPS redirect ' || {_HOPS} WHEN 'www_normalize' THEN 'www normalization redirect ' || {_HOPS} WHEN 'trailing_slash' THEN 'Trailing slash redirect ' || {_HOPS} WHEN 'other' THEN 'Redirect ' || {_HOPS} END",
    "CASE WHEN sc >= 400 THEN 'HTTP ' || sc || ' error' END",
    "CASE WHEN NOT g THEN NULL WHEN ti = '' THEN 'Missing title' WHEN tl > 60 THEN 'Title too long (' || tl || ')' WHEN tl < 30 THEN 'Title too short (' || tl || ')' END",
    "CASE WHEN NOT g THEN NULL WHEN md = '' THEN 'Missing meta description' WHEN length(md) > 160 THEN 'Meta desc too long (' || length(md) || ')' WHEN length(md) < 70 THEN 'Meta desc too short (' || length(md) || ')' END",
    "CASE WHEN g AND hd = '' THEN 'Missing H1' END",
    "CASE WHEN g AND hd <> '' AND ti <> '' AND lower(trim(hd)) = lower(trim(ti)) THEN 'H1 same as title' END",
    "CASE WHEN g AND ck = 'missing' THEN 'Missing canonical' END",
    "CASE WHEN g AND wc < 200 THEN 'Thin content (' || wc || ' words)' END",
    "CASE WHEN fine AND ck = 'canonicalised' THEN 'Canonicalised (points elsewhere)' END",
    "CASE WHEN fine AND response_time > 3 THEN 'Slow (' || CAST(response_time AS VARCHAR) || 's)' END",
    f"CASE WHEN fine AND lower({part('asked', 1)}) <> 'https' THEN 'Served over HTTP (insecure)' END",
    "CASE WHEN fine AND indexable = false THEN 'noindex' END",
    """CASE WHEN sc <> 0 OR coalesce(error, '') = '' THEN NULL WHEN regexp_matches(lower(error), 'timeout|timed out') THEN 'Timeout'
        WHEN regexp_matches(lower(error), 'certificate_verify_failed|unable to get local issuer|self signed') THEN 'SSL certificate verification failed (incomplete chain or untrusted/self-signed cert) — loads in browsers but blocks crawlers'
        WHEN regexp_matches(lower(error), '\\bssl\\b|certificate') THEN 'SSL error: ' || left(error, 90)
        WHEN regexp_matches(lower(error), 'name or service not known|failed to resolve|nodename nor servname|dns') THEN 'Connection error — DNS lookup failed (domain not resolving)'
        WHEN contains(lower(error), 'refused') THEN 'Connection error — connection refused (server not accepting connections)'
        WHEN contains(lower(error), 'reset') THEN 'Connection error — connection reset (often bot/WAF blocking non-browser clients)'
        WHEN contains(lower(error), 'connection') THEN 'Connection error' ELSE 'Error: ' || left(error, 60) END""",
]
ISSUES = f"SELECT *, list_concat(list_filter([{', '.join(_RULES)}], lambda i: i IS NOT NULL), CASE WHEN fine THEN list_transform({hygiene('asked')}, lambda f: 'URL: ' || f) ELSE [] END) AS issues FROM ({GATED})"
EACH = f"SELECT page_id, url, unnest(issues) AS issue FROM ({ISSUES})"
SCORE = f"CASE WHEN len(list_filter(issues, lambda i: regexp_matches(lower(i), {q(scoring.FATAL)}))) > 0 THEN 0 ELSE greatest(0, 100 - coalesce(list_sum(list_transform(issues, lambda i: {points('i')})), 0)) END"
