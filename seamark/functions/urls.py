"""Addresses: splitting, normal forms for different purposes, hygiene, admissibility, patterns."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The generic URI split: scheme, authority, path, query, fragment are groups 1 to 5.
URI = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

# ---- fixed values ----

#: Parameters that are dropped when addresses of a crawl are compared, besides ``utm_*``.
NOISE_PARAMS = (
    "fbclid gclid mc_cid mc_eid gad_source gbraid wbraid msclkid yclid dclid igshid srsltid ref ref_src ref_url "
    "add-to-cart remove_item removed_item undo_item wc-ajax wc-api wcml_currency orderby product-page min_price max_price "
    "replytocom unapproved moderation-hash share sharesource"
).split()
#: Suffixes of addresses that are no HTML pages.
NON_HTML = (
    "jpg jpeg png gif webp svg ico bmp tiff avif pdf doc docx xls xlsx ppt pptx csv txt rtf zip tar gz 7z rar "
    "mp4 mov webm m4v avi mkv mp3 wav ogg flac css js json xml map woff woff2 ttf otf eot"
).split()
#: Parts of paths that belong to no page.
NON_PAGE_PATHS = (
    "/feed/ /feed.atom /feed.rss /comments/feed/ /wp-json/ /wp-admin/ /wp-login.php /xmlrpc.php /sitemap.xml /sitemap_index.xml /cdn-cgi/"
).split()


def part(url: Column, n: int) -> Column:
    """Group ``n`` of URI: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if absent."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URI, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Authority in lower case, without leading ``www.``."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def path(url: Column) -> Column:
    return part(url, 3)


def path_query(url: Column) -> Column:
    q = part(url, 4)
    return F.concat(path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def _bare_path(p: Column) -> Column:
    """A path without white space, ``%20`` and slashes at its end."""
    return F.regexp_replace(p, r"(?i)(?:\s|/|%20)+\z", "")


def sitemap_key(url: Column) -> Column:
    """Key under which a sitemap and a crawl are compared: https, no ``www.``, no query, bare path, all in lower case; empty for null or empty."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+\z", "")
    return F.when(u == "", F.lit("")).otherwise(F.lower(F.concat(F.lit("https://"), host(u), _bare_path(path(u)))))


def duplicate_key(url: Column) -> Column:
    """Key under which pages of equal content count once: https, no ``www.``, no query, pagination tails dropped, bare path in its own case."""
    p = F.regexp_replace(F.regexp_replace(path(url), r"/page/\d+/?\z", "/"), r"/comment-page-\d+/?\z", "/")
    bare = _bare_path(p)
    out = F.concat(F.lit("https://"), host(url), F.when(bare == "", "/").otherwise(bare))
    return F.when(F.coalesce(url, F.lit("")) == "", url).otherwise(out)


def compare_key(url: Column) -> Column:
    """Key under which two crawls are compared: lower case, no slash at the end."""
    return F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"/+\z", ""))


def bare_host(url: Column) -> Column:
    """Host of an address or a bare domain."""
    h = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+\z", "")), r"https?://", "")
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(h, r"/+\z", ""), r"^www\.", ""), r"^[^/]*", 0)


def slash_twin(url: Column) -> Column:
    """The address with its last slash toggled; null if the last segment looks like a file."""
    p, tail = path(url), F.concat(F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise(""), F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise(""))
    head = F.concat(F.when(part(url, 1) != "", F.concat(part(url, 1), F.lit(":"))).otherwise(""), F.when(part(url, 2) != "", F.concat(F.lit("//"), part(url, 2))).otherwise(""))
    last = F.regexp_extract(F.regexp_replace(p, r"/+\z", ""), r"[^/]*\z", 0)
    other = F.when(p.rlike(r"^.+/\z"), F.regexp_replace(p, r"/+\z", "")).otherwise(F.concat(p, F.lit("/")))
    return F.when(~last.contains("."), F.concat(head, other, tail))


def first_segment(url: Column) -> Column:
    """First directory of a path, with a slash at its end if more follows; ``/`` for the root."""
    p = F.regexp_replace(path(url), r"^/+", "")
    return F.concat(F.lit("/"), F.regexp_extract(p, r"^[^/]*/?", 0))


def display_path(url: Column) -> Column:
    """Address without scheme and host."""
    return F.regexp_replace(url, r"^https?://[^/]+", "")


def hygiene_flags(url: Column) -> Column:
    """Array of what is unusual about an address, in fixed order."""
    p, q = path(url), part(url, 4)
    return F.array_compact(
        F.array(
            F.when(p.rlike(r"\p{Lu}"), F.lit("uppercase")),
            F.when(p.contains("_"), F.lit("underscores")),
            F.when(url.contains(" ") | p.contains("%20"), F.lit("contains space")),
            F.when(F.length(url) > 115, F.concat(F.lit("over 115 chars ("), F.length(url).cast("string"), F.lit(")"))),
            F.when(p.contains("//"), F.lit("multiple slashes")),
            F.when(url.rlike(r"[^\x00-\x7F]"), F.lit("non-ASCII characters")),
            F.when(q != "", F.lit("contains parameters")),
            F.when(q.rlike(r"utm_|gclid=|fbclid="), F.lit("tracking parameters")),
        )
    )


def is_pagination(url: Column) -> Column:
    """Later pages of a list, by path (``/page/N``) or by parameter (page, paged, pg from 2)."""
    return path(url).rlike(r"/page/\d+/?\z") | part(url, 4).rlike(r"(?:^|[?&;])\s*_?(?:page|paged|pg)\s*=\s*[2-9]\d*")


def is_non_html(url: Column) -> Column:
    return F.lower(path(url)).rlike(rf"\.(?:{'|'.join(NON_HTML)})\z")


def redirect_kind(asked: Column, got: Column) -> Column:
    """What a redirect did: null for none or a loop to the same address, http_to_https, www_normalize, trailing_slash or other."""
    same_host = host(asked) == host(got)
    pa, pg = path(asked), path(got)
    same_path = F.regexp_replace(pa, r"/+\z", "") == F.regexp_replace(pg, r"/+\z", "")
    same_query = part(asked, 4) == part(got, 4)
    loop = (part(asked, 1) == part(got, 1)) & (F.lower(part(asked, 2)) == F.lower(part(got, 2))) & (pa == pg) & same_query
    return F.when(asked.isNull() | got.isNull() | loop, F.lit(None).cast("string")).otherwise(
        F.when(~(same_host & same_path & same_query), "other")
        .when((part(asked, 1) == "http") & (part(got, 1) != "http"), "http_to_https")
        .when(part(asked, 2) != part(got, 2), "www_normalize")
        .when((pg == F.concat(pa, F.lit("/"))) | (pa == F.concat(pg, F.lit("/"))), "trailing_slash")
        .otherwise("other")
    )


def redirect_label(kind: Column, hops: Column) -> Column:
    """The issue text of a redirect."""
    times = F.concat(hops.cast("string"), F.when(hops > 1, " hops)").otherwise(" hop)"))
    name = F.when(kind == "http_to_https", "HTTP→HTTPS redirect (").when(kind == "www_normalize", "www normalization redirect (").when(kind == "trailing_slash", "Trailing slash redirect (").otherwise("Redirect (")
    return F.when(kind.isNotNull(), F.concat(name, times))


# ---- admissibility ----


def pattern_regex(pattern: str) -> str | None:
    """robots.txt pattern as an anchored regular expression: ``*`` is any run, a last ``$`` the end, all else literal; null for a blank one."""
    p = (pattern or "").strip()
    if not p:
        return None
    end = p.endswith("$")
    body = ".*".join(re.escape(x) for x in (p[:-1] if end else p).split("*"))
    return "(?s)^" + body + (r"\z" if end else "")


def matches_pattern(url: Column, pattern: str) -> Column:
    """Whether a robots.txt pattern matches the path with query, or the whole address."""
    rx = pattern_regex(pattern)
    return F.lit(False) if rx is None else path_query(url).rlike(rx) | url.rlike(rx)


def pattern_column_regex(pattern: Column) -> Column:
    """pattern_regex of a column of patterns, for joins of addresses with many rules."""
    p = F.trim(pattern)
    body = F.regexp_replace(F.regexp_replace(p, r"\$\z", ""), r"[^A-Za-z0-9_*\s]", r"\\$0")
    return F.when(p != "", F.concat(F.lit("(?s)^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(p.endswith("$"), r"\z").otherwise("")))


def parse_patterns(raw: str | None) -> list[str]:
    """Patterns of a text, one a line; blank lines and those that begin with ``#`` are left out."""
    return [x for line in (raw or "").splitlines() if (x := line.strip()) and not x.startswith("#")]


def is_admissible(url: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a crawl should visit an address: an HTML page, no feed or login, no endless filter parameter, no
    repeated path segment, not excluded, and included if anything is."""
    p, q = F.lower(path(url)), F.lower(part(url, 4))
    words = F.filter(F.split(p, "/"), lambda s: (F.length(s) >= 4) & ~s.rlike(r"^\d+\z"))
    ok = ~F.coalesce(is_non_html(url), F.lit(False)) & ~p.rlike("|".join(re.escape(x) for x in NON_PAGE_PATHS))
    ok &= ~q.rlike(r"(?:^|&)\s*(?:e-page-|e-filter-|infinity\s*(?:=|&|\z))")
    ok &= F.size(words) == F.size(F.array_distinct(words))
    for x in exclude:
        ok &= ~matches_pattern(url, x)
    if include:
        some = F.lit(False)
        for x in include:
            some |= matches_pattern(url, x)
        ok &= some
    return ok


# ---- what needs a parser: Arrow batches ----


def _crawl_form(url: str | None) -> str | None:
    if url is None:
        return None
    p = urlparse(url)
    kept = {k: v for k, v in parse_qs(p.query, keep_blank_values=True).items() if not k.lower().startswith("utm_") and k.lower() not in NOISE_PARAMS}
    return urlunparse((p.scheme.lower(), p.netloc.lower(), p.path or "/", "", urlencode(kept, doseq=True), ""))


def _crawl_forms(url: pd.Series) -> pd.Series:
    def one(u):
        try:
            return _crawl_form(u)
        except ValueError:
            return u

    return url.map(one, na_action="ignore")


def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return None if h is None else urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def crawl_form(url: Column | str) -> Column:
    """Form in which a crawl knows an address: scheme and host in lower case, no fragment, no tracking and action parameters, repeated ones together."""
    return F.pandas_udf(_crawl_forms, StringType())(url)


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute address of a reference found on a page; null if it can't be read."""
    return F.pandas_udf(_resolved, StringType())(base, href)
