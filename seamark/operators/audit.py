"""Issues of a page row: rules over its columns, and the views that count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import scoring, text, urls

#: Lengths beyond which titles and descriptions are flagged.
TITLE_LONG, TITLE_SHORT, META_LONG, META_SHORT, THIN, SLOW = 60, 30, 160, 70, 200, 3


def _said(label: str, n: Column, after: str = "") -> Column:
    return F.concat(F.lit(f"{label} ("), n.cast("string"), F.lit(f"{after})"))


def _col(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def page_issues(pages: DataFrame, ignore_noindex: bool = False) -> DataFrame:
    """Adds ``issues``: an array of issue texts in rule order.

    Reads whichever audit columns there are; rules about columns that are absent say nothing.
    Content rules hold only for indexable 2xx pages that are no later page of a list, no redirect and
    not canonicalised; null counts as empty, and a null ``indexable`` as true.
    """
    have = set(pages.columns)
    no = F.lit(None).cast("string")
    url = F.coalesce(F.col("url"), F.lit(""))
    asked = F.coalesce(F.col("original_url"), url) if "original_url" in have else url
    status = _col(pages, "status_code", F.lit(0))
    title, meta, h1 = (_col(pages, c, F.lit("")) for c in ("title", "meta_description", "h1"))
    title_len = _col(pages, "title_len", F.length(title))
    kind = _col(pages, "canonical_kind", F.lit(""))
    redirect = _col(pages, "redirect_url", F.lit(""))
    rules: list[Column] = []
    # what the fetch itself says comes first
    if "challenge" in have:
        rules.append(F.when(F.col("challenge"), 'Bot challenge (Cloudflare) blocked this page — enable "Solve bot challenges" to crawl this site'))
    if "non_html" in have:
        rules.append(F.when((status < 400) & F.col("non_html").isNotNull(), F.concat(F.lit("Non-HTML ("), F.col("non_html"), F.lit(")"))))
    lists: list[Column] = []
    page = F.col("non_html").isNull() if "non_html" in have else F.lit(True)
    gate = (_col(pages, "indexable", F.lit(True)) | F.lit(ignore_noindex)) & ~urls.is_pagination(asked) & (redirect == "") & (kind != "canonicalised") & status.between(200, 299) & page
    content = lambda c: rules.append(F.when(gate, c))
    if "redirect_hops" in have:
        rules.append(urls.redirect_label(urls.redirect_kind(asked, F.when(redirect != "", redirect)), F.greatest(F.lit(1), F.coalesce(F.col("redirect_hops"), F.lit(1)))))
    rules.append(F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" error"))))
    content(F.when(title == "", "Missing title").when(title_len > TITLE_LONG, _said("Title too long", title_len)).when(title_len < TITLE_SHORT, _said("Title too short", title_len)))
    if "meta_description" in have:
        n = F.length(meta)
        content(F.when(meta == "", "Missing meta description").when(n > META_LONG, _said("Meta desc too long", n)).when(n < META_SHORT, _said("Meta desc too short", n)))
    if "h1" in have:
        many = F.size("h1_list") if "h1_list" in have else F.lit(0)
        content(F.when(h1 == "", "Missing H1").when(many > 1, _said("Multiple H1s", many)))
        content(F.when((h1 != "") & (title != "") & (F.lower(F.trim(h1)) == F.lower(F.trim(title))), "H1 same as title"))
    if "canonical_kind" in have:
        content(F.when(kind == "missing", "Missing canonical"))
    if "word_count" in have:
        words = F.coalesce(F.col("word_count"), F.lit(0))
        content(F.when(words < THIN, _said("Thin content", words, " words")))
    if "images_no_alt" in have:
        content(F.when(F.col("images_no_alt") > 0, F.concat(F.col("images_no_alt").cast("string"), F.lit(" imgs missing alt"))))
    if "images_empty_alt_content" in have:
        content(F.when(F.col("images_empty_alt_content") > 0, F.concat(F.col("images_empty_alt_content").cast("string"), F.lit(" imgs with empty alt on content imagery"))))
    if "schema_types" in have:
        content(F.when(F.size("schema_types") == 0, "No schema"))
    if "has_viewport" in have:
        content(F.when(~F.col("has_viewport"), "Missing viewport"))
    if "og_tags" in have:
        image, name = (F.coalesce(F.try_element_at("og_tags", F.lit(k)), F.lit("")) for k in ("image", "title"))
        content(F.when((name == "") & (image == ""), "Missing Open Graph tags").when(image == "", "Missing og:image"))
    if "twitter_tags" in have:
        content(F.when(F.size(F.map_keys("twitter_tags")) == 0, "Missing Twitter Card"))
    if "analytics" in have:
        platform = F.col("js_platform") if "js_platform" in have else no
        content(F.when(F.size("analytics") == 0, F.coalesce(F.concat(F.lit("Analytics unknown — "), platform, F.lit(" site needs Render JS")), F.lit("No analytics detected"))))
    fine = status.between(200, 399) & page  # rows that were answered with an error, or with no page, end here
    rules.append(F.when(fine & (kind == "canonicalised"), "Canonicalised (points elsewhere)"))
    if "response_time" in have:
        rules.append(F.when(fine & (F.col("response_time") > SLOW), F.concat(F.lit("Slow ("), F.col("response_time").cast("string"), F.lit("s)"))))
    if "mixed_content" in have:
        rules.append(F.when(fine & (F.size("mixed_content") > 0), _said("Mixed content", F.size("mixed_content"), " resources")))
    rules.append(F.when(fine & (urls.scheme(asked) != "https"), "Served over HTTP (insecure)"))
    if "indexable" in have:
        rules.append(F.when(fine & (F.col("indexable") == F.lit(False)), "noindex"))
    if "js_diff" in have:
        level = F.col("js_diff.severity")
        rules.append(F.when(level.isin("critical", "high"), F.concat(F.lit("JS-only content ("), level, F.lit(": "), F.array_join("js_diff.fields", ", "), F.lit(")"))))
    if "malformed_hrefs" in have:
        shown = lambda h: F.when(F.length(h) <= 80, h).otherwise(F.concat(F.left(h, F.lit(77)), F.lit("…")))
        lists.append(F.array_distinct(F.transform("malformed_hrefs", lambda h: F.concat(F.lit('Malformed link href (text, not a URL): "'), shown(h), F.lit('"')))))
    if "error" in have:
        rules.append(F.when(status == 0, error_issue(F.col("error"))))
    lists.append(F.when(fine, F.transform(urls.hygiene_flags(asked), lambda x: F.concat(F.lit("URL: "), x))))
    return pages.withColumn("issues", F.concat(F.array_compact(F.array(*rules)), *(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def error_issue(error: Column) -> Column:
    """Issue text of a fetch that got no answer, from its error message."""
    low = F.lower(error)
    return (
        F.when(low.contains("timeout") | low.contains("timed out"), "Timeout")
        .when(low.rlike("certificate_verify_failed|unable to get local issuer|self signed"), "SSL certificate verification failed (incomplete chain or untrusted/self-signed cert) — loads in browsers but blocks crawlers")
        .when(low.rlike(r"\bssl\b|certificate"), F.concat(F.lit("SSL error: "), F.left(error, F.lit(90))))
        .when(low.rlike("name or service not known|failed to resolve|nodename nor servname|dns"), "Connection error — DNS lookup failed (domain not resolving)")
        .when(low.contains("refused"), "Connection error — connection refused (server not accepting connections)")
        .when(low.contains("reset"), "Connection error — connection reset (often bot/WAF blocking non-browser clients)")
        .when(low.contains("connection"), "Connection error")
        .when(error != "", F.concat(F.lit("Error: "), F.left(error, F.lit(60))))
    )


# ---- views over issues; all take pages with ``issues`` ----


def each_issue(pages: DataFrame, *keep: str) -> DataFrame:
    """One row an issue. The outer form keeps Spark from inferring a filter on the array, which would compute the rules twice."""
    return pages.select(*keep, F.explode_outer("issues").alias("issue")).filter(F.col("issue").isNotNull())


def issue_histogram(pages: DataFrame) -> DataFrame:
    """``issue, n``: how often each issue occurs, by its text before a bracket."""
    return each_issue(pages).groupBy(text.issue_key(F.col("issue")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def issue_examples(pages: DataFrame, seq: str, most: int = 10) -> DataFrame:
    """``issue, n, urls``: full issue texts with their count and the first ``most`` addresses by ``seq``.

    The bound on the rank is pushed below the shuffle (WindowGroupLimit): a task sends ``most`` rows an issue at most.
    """
    rows = each_issue(pages, seq, "url")
    n = rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    top = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("issue").orderBy(seq))).filter(F.col("_rn") <= most)
    lists = top.groupBy("issue").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "url"))), lambda x: x["url"]).alias("urls"))
    return n.join(lists, "issue")


def severity_counts(pages: DataFrame) -> DataFrame:
    """``severity, pages``: pages with at least one issue of each severity; a page may count in all."""
    has = lambda s: F.count_if(F.exists("issues", lambda i: scoring.severity(i) == s)).alias(s)
    row = pages.agg(has("error"), has("warn"), has("info"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("pages")) for s in ("error", "warn", "info")))).alias("x")).select("x.*")


def issue_cards(pages: DataFrame, page_id: str, summary: bool = True) -> DataFrame:
    """``severity, label, pages``: issue cards, a page counted once a card (under the card's most severe form)."""
    rank = {"error": 0, "warn": 1, "info": 2}
    sev = scoring.severity(F.col("issue"), summary)
    rows = each_issue(pages, page_id).select(page_id, text.issue_label(F.col("issue")).alias("label"), sev.alias("severity"))
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    once = rows.groupBy(page_id, "label").agg(F.min(order).alias("o"))
    named = F.when(F.col("o") == rank["error"], "error").when(F.col("o") == rank["warn"], "warn").otherwise("info")
    return once.groupBy(named.alias("severity"), "label").agg(F.count(F.lit(1)).alias("pages"))


def scored(pages: DataFrame) -> DataFrame:
    return pages.withColumn("score", scoring.page_score(F.col("issues")))


def site_score(pages: DataFrame) -> DataFrame:
    """``site, pages, score``: mean page score of each host, rounded half up."""
    by = scored(pages).groupBy(urls.host(F.col("url")).alias("site"))
    return by.agg(F.count(F.lit(1)).alias("pages"), F.sum("score").alias("_s")).select("site", "pages", scoring.half_up(F.col("_s") / F.col("pages")).cast("long").alias("score"))


def in_category(category: str) -> Column:
    """Filter of a category: a severity (``__err``, ``__warn``, ``__info``), ``HTTP``, ``Redirect``, ``noindex``, ``Canonicalised``, or text within the issues."""
    some = lambda f: F.exists("issues", f)
    low = F.lower(F.array_join("issues", " "))
    fixed = {
        "all": lambda: F.lit(True),
        "__err": lambda: some(lambda i: scoring.severity(i) == "error"),
        "__warn": lambda: some(lambda i: scoring.severity(i) == "warn"),
        "__info": lambda: some(lambda i: scoring.severity(i) == "info"),
        "HTTP": lambda: F.col("status_code").between(400, 599),
        "Redirect": lambda: F.coalesce(F.col("redirect_url"), F.lit("")) != "",
        "noindex": lambda: some(lambda i: (F.lower(i) == "noindex") | F.lower(i).startswith("page set to noindex")),
        "Canonicalised": lambda: some(lambda i: F.lower(i).startswith("canonicalised")),
        "imgs missing alt": lambda: low.contains("imgs missing alt") | low.contains("imgs with empty alt"),
    }
    return fixed[category]() if category in fixed else low.contains(category.lower())


def reportable() -> Column:
    """Pages that title and description lists show: no later page of a list, indexable, no redirect, 2xx or unknown."""
    status = F.coalesce(F.col("status_code"), F.lit(0))
    return ~urls.is_pagination(F.col("url")) & F.coalesce(F.col("indexable"), F.lit(True)) & (F.coalesce(F.col("redirect_url"), F.lit("")) == "") & ((status == 0) | status.between(200, 299))
