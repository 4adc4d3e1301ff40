"""Page keys: one spelling for every way an address can be written.

Built from JVM expressions only, so that keys are computed inside code generation. The higher-order
part (sorting query parameters) runs only for addresses that have a query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that never tell two pages apart, and ports that go without saying.
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=|$)"
PORTS = "80|443"


#: Addresses of the commonest shape: their key is what remains without scheme and last slash.
PLAIN = r"^https?://(?!www\.)[a-z0-9.\-]++(?:/[a-z0-9_.~\-]++)*+/?\z"
#: Addresses without query, fragment, escapes, blanks and repeated slashes, in any letter case, of which a key is cut in one step.
SIMPLE = r"(?i)^https?://[a-z0-9.\-]++(?::(?:80|443))?(?:/[a-z0-9_.~\-\x{C0}-\x{24F}]++)*+/?\z"
UNDRESS = r"(?i)^https?://(?:www\.)?|:(?:80|443)(?=/|\z)|/\z"


def unescape(c: Column) -> Column:
    """Percent escapes as the characters they stand for; a ``%`` that begins no escape, and ``+``, stay as they are."""
    safe = F.regexp_replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), c)


def page_key(address: Column, own_host: Column | None = None) -> Column:
    """Page key of ``address``; with ``own_host``, an address that begins with one slash is read on that host.

    Null, empty and blank addresses have the empty key. Every branch holds each step once, so no step
    is computed twice for a row.
    """
    raw = F.coalesce(address, F.lit(""))
    s = F.regexp_replace(F.regexp_replace(raw, r"(?s)#.*", ""), r"(?U)^\s+|\s+$", "")
    if own_host is not None:
        literal = F.regexp_replace(F.coalesce(own_host, F.lit("")), r"[$\\]", r"\\$0")
        s = F.regexp_replace(s, F.lit(r"^/(?!/)"), F.concat(literal, F.lit("/")))
    s = F.regexp_replace(s, r"(?i)^(?:(?:[a-z][a-z0-9+.\-]*:)?//)?(?:www\.)?", "")
    s = F.regexp_replace(s, rf"^([^/?:]*):(?:{PORTS})(?=[/?]|$)", "$1")
    base = F.regexp_extract(s, r"(?s)^[^?]*", 0)
    base = F.lower(F.when(raw.contains("%"), unescape(base)).otherwise(base))
    base = F.regexp_replace(F.regexp_replace(base, "/+", "/"), r"(?U)[\s/]+$", "")
    base = F.regexp_replace(base, r"(?U)^([^/]*)/\s[\s/]*", "$1/")
    parts = F.split(F.regexp_extract(s, r"(?s)^[^?]*\?(.*)$", 1), "&", -1)
    kept = F.filter(F.transform(parts, lambda x: F.lower(unescape(x))), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.regexp_replace(F.array_join(F.array_sort(kept), "&"), r"(?s)^(?=.)", "?")
    slow = F.concat(base, F.when(raw.contains("?"), query).otherwise(""))
    return F.when(raw.rlike(PLAIN), F.regexp_replace(raw, r"^https?://|/\z", "")).when(raw.rlike(SIMPLE), F.lower(F.regexp_replace(raw, UNDRESS, ""))).otherwise(slow)


def key_host(key: Column) -> Column:
    """Host part of a page key."""
    return F.regexp_extract(key, r"^[^/?]*", 0)


# The same in DuckDB's dialect, for oracles.
_SQL_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def page_key_sql(x: str, own_host: str | None = None) -> str:
    """SQL text of the page key of the expression ``x``; nested lists stand for let-bindings."""
    s = f"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '(?s)#.*', ''), '^{_SQL_WS}+', ''), '{_SQL_WS}+$', '')"
    if own_host:
        s = f"list_transform([{s}], lambda u: CASE WHEN regexp_matches(u, '^/([^/]|$)') THEN {own_host} || u ELSE u END)[1]"
    s = rf"regexp_replace({s}, '(?i)^(?:(?:[a-z][a-z0-9+.\-]*:)?//)?(?:www\.)?', '')"
    s = rf"regexp_replace({s}, '^([^/?:]*):(?:{PORTS})($|[/?])', '\1\2')"
    base = "lower(url_decode(regexp_extract(v, '(?s)^[^?]*')))"
    base = f"regexp_replace({base}, '/+', '/', 'g')"
    base = rf"regexp_replace({base}, '(?:{_SQL_WS}|/)+$', '')"
    base = rf"regexp_replace({base}, '^([^/]*)/{_SQL_WS}(?:{_SQL_WS}|/)*', '\1/')"
    q = r"regexp_extract(v, '(?s)^[^?]*\?(.*)$', 1)"
    kept = f"list_filter(list_transform(string_split({q}, '&'), lambda p: lower(url_decode(p))), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))"
    joined = f"coalesce(array_to_string(list_sort({kept}), '&'), '')"
    return f"list_transform([{s}], lambda v: {base} || CASE WHEN {joined} = '' THEN '' ELSE '?' || {joined} END)[1]"
