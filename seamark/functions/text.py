"""Text: tokens, shingles, issue labels, digests, and forms for export."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: words that say nothing about what a text is like.
STOP_WORDS = (
    "a an the and or but is are was were be been being have has had do does did will would should could can "
    "to of in on at by for with about as into through this that these those i we you they it he she "
    "our your their its his her my not no so if than then too very just over under before after between from up down out off "
    "all any each most some other such only own same us me them who what where when why how"
).split()


def squeeze(c: Column) -> Column:
    """Runs of any white space as one space, outer ones dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | \z", "")


def clean_heading(c: Column) -> Column:
    """A heading with white space collapsed and none before punctuation."""
    return F.regexp_replace(squeeze(c), r"\s+([,.;:!?)\]])", "$1")


def body_hash(c: Column) -> Column:
    """MD5 of the lower-case text with white space collapsed; empty for empty text."""
    t = squeeze(F.lower(F.coalesce(c, F.lit(""))))
    return F.when(t == "", "").otherwise(F.md5(t))


def tokens(c: Column) -> Column:
    """Latin words of at least two characters, lower case; apostrophes and hyphens within belong to them."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z][a-z'\-]{1,}"), F.lit(0))


def content_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(*STOP_WORDS))


def word_count(c: Column) -> Column:
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def shingles(words: Column, n: int = 5) -> Column:
    """Different runs of ``n`` words; empty if there are fewer. ``words`` should be a column of its own, as it is read once a run."""
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))
    )


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


# ---- issue labels: three forms for three reports ----


def issue_key(c: Column) -> Column:
    """Histogram form: what stands before the first bracket."""
    return F.trim(F.substring_index(c, "(", 1))


def issue_compare_key(c: Column) -> Column:
    """Form for comparing crawls: without a bracket at the end and a count at the start."""
    out = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*\z", "")), r"^\d+\s+", ""))
    return F.when(out == "", c).otherwise(out)


#: Labels of issue cards. What an issue begins with (before any bracket) -> label.
ISSUE_LABELS = {
    "Meta desc too long": "Meta description too long",
    "Meta desc too short": "Meta description too short",
    "H1 identical to title tag": "H1 same as title",
    "Missing Open Graph": "Missing Open Graph tags",
    "noindex": "Noindex pages",
    "Slow": "Slow response",
    "No schema": "No schema markup",
    "Redirect": "Redirects",
    "Trailing slash redirect": "Redirects",
    "HTTP→HTTPS redirect": "Redirects",
    "www normalization": "Redirects",
    "www normalization redirect": "Redirects",
}
ISSUE_GROUPS = (
    (r"(?i)^\d* ?imgs (?:missing alt|with empty alt)", "Images missing alt"),
    (r"(?i)^HTTP \d{3}", "HTTP errors (4xx / 5xx)"),
    (r"(?i)^URL:", "URL hygiene"),
    (r"(?i)^AI crawlers blocked", "AI crawlers blocked in robots.txt"),
    (r"(?i)^AI training bots blocked", "AI training bots blocked in robots.txt"),
    (r"(?i)^Search engines blocked", "Search engines blocked in robots.txt"),
)


def issue_label(c: Column) -> Column:
    """Form for issue cards."""
    head = F.trim(F.regexp_replace(c, r"(?s)\s*\(.*", ""))
    out = F.when(F.lit(False), "")
    for k, v in ISSUE_LABELS.items():
        out = out.when(head == k, v)
    for rx, v in ISSUE_GROUPS:
        out = out.when(c.rlike(rx), v)
    return out.otherwise(head)


# ---- forms for export ----


def csv_cell(c: Column) -> Column:
    """A quoted cell, quotes doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(xml_escape(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def safe_file_name(name: str) -> str:
    """A name of letters, digits, dots, dashes and underscores, at most 80 long."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", name)[:80]


def safe_sheet_names(names: list[str]) -> list[str]:
    """Sheet names without characters that spreadsheets forbid, at most 31 long, made unique by a number at the end."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\]", " ", n).strip()[:31] or "Sheet"
        name, k = base, 2
        while name.lower() in {x.lower() for x in out}:
            tail = f" ({k})"
            name, k = base[: 31 - len(tail)] + tail, k + 1
        out.append(name)
    return out


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").when(~c, "No").otherwise("")


def sorted_list(c: Column) -> Column:
    """Elements in order, joined by commas; empty for null."""
    return F.coalesce(F.array_join(F.array_sort(c), ", "), F.lit(""))


def http_date(c: Column) -> Column:
    """Day of an HTTP date such as ``Tue, 03 Jun 2031 10:00:00 GMT``; empty if it can't be read."""
    day = F.regexp_extract(c, r"^\w{3}, (\d{1,2} \w{3} \d{4}) \d{2}:\d{2}:\d{2}", 1)
    return F.coalesce(F.date_format(F.try_to_timestamp(day, F.lit("d MMM yyyy")), "yyyy-MM-dd"), F.lit(""))


def iso_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold().strip(), na_action="ignore")


def fold(c: Column | str) -> Column:
    """Compatibility form (NFKC), case folded, outer white space dropped."""
    return F.pandas_udf(_folded, StringType())(c)
