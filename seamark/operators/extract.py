"""From fetched pages to audit rows, and the views over what pages hold: images, schema types, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions import detect, html_page, scoring, text, urls
from seamark.operators.audit import page_issues
from seamark.session import spread

#: What a fetch delivers; ``raw_html`` is the page before its scripts ran, where they were run.
FETCHED = "url string, final_url string, status_code int, headers map<string,string>, html string, raw_html string, history array<struct<url:string,status:int>>, response_time double, error string"
SECURITY = {"hsts": "strict-transport-security", "csp": "content-security-policy", "x_content_type_options": "x-content-type-options", "x_frame_options": "x-frame-options", "referrer_policy": "referrer-policy"}


def security_flags(headers: Column, url: Column) -> Column:
    """Struct of which security headers an answer has (names in lower case), and whether the address is https."""
    has = [F.coalesce(F.map_contains_key(headers, F.lit(h)), F.lit(False)).alias(n) for n, h in SECURITY.items()]
    return F.struct(*has, (urls.scheme(url) == "https").alias("is_https"))


def canonical_kind(canonical: Column, asked: Column, final: Column) -> Column:
    """missing; self, if it is the requested or the final address apart from a last slash; else canonicalised."""
    bare = lambda c: F.regexp_replace(c, r"/+\z", "")
    return F.when(F.coalesce(canonical, F.lit("")) == "", "missing").when((bare(canonical) == bare(asked)) | (bare(canonical) == bare(final)), "self").otherwise("canonicalised")


def audit_rows(fetched: DataFrame, compare_raw: bool = False) -> DataFrame:
    """Audit rows of fetched pages (FETCHED): what the HTML holds, redirects, indexability, security, signatures, issues.

    HTML is parsed once a page (twice with ``compare_raw``, to tell what only shows after scripts ran).
    Answers of status 400 and over, and those that are not HTML, keep their row without content. A redirect that was
    not followed (status 3xx with a ``Location``) keeps its own address; its chain ends at the location with status 0.
    """
    f = fetched.withColumn("headers", F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _v: F.lower(k)))
    final, asked = F.coalesce("final_url", "url"), F.col("url")
    kind = F.lower(F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit("")))
    is_page = (F.coalesce("status_code", F.lit(0)) < 400) & ((kind == "") | kind.contains("html"))
    parsed = spread(f).withColumn("p", html_page.parse_html(F.when(is_page, F.col("html")), final))
    ahead = F.when(F.col("status_code").between(300, 399), F.nullif(F.try_element_at("headers", F.lit("location")), F.lit("")))
    hop = lambda u, s: F.array(F.struct(u.alias("url"), s.cast("int").alias("status")))
    trail = F.when(ahead.isNotNull() & (F.coalesce(F.size("history"), F.lit(0)) <= 0), hop(final, F.col("status_code"))).otherwise(F.col("history"))
    hops = F.greatest(F.lit(0), F.coalesce(F.size(trail), F.lit(0)))
    last = F.coalesce(ahead, final)
    moved = urls.redirect_kind(asked, F.when(hops > 0, last))
    html = F.coalesce("html", F.lit(""))
    noindex = F.coalesce(F.try_element_at("headers", F.lit("x-robots-tag")), F.lit("")).rlike("(?i)noindex") | F.col("p.robots").contains("noindex")
    cols = {
        "original_url": F.when(moved.isNotNull() & ahead.isNull(), asked), "redirect_url": F.when(moved.isNotNull(), last), "redirect_kind": moved, "redirect_status": F.when(moved.isNotNull(), F.get(trail, F.lit(0))["status"]), "redirect_hops": hops,
        "redirect_chain": F.when(hops > 0, F.concat(trail, hop(last, F.when(ahead.isNotNull(), 0).otherwise(F.col("status_code"))))), "content_type": F.left(kind, F.lit(50)),
        "last_modified": F.try_element_at("headers", F.lit("last-modified")), "x_robots_tag": F.try_element_at("headers", F.lit("x-robots-tag")),
        "security": security_flags(F.col("headers"), final), "indexable": ~noindex, "is_pagination": urls.is_pagination(asked), "url_issues": urls.hygiene_flags(asked), "canonical_kind": F.when(is_page, canonical_kind(F.col("p.canonical"), asked, final)),
        "body_hash": text.body_hash(F.col("p.body_text")), "analytics": detect.trackers(html), "cms": detect.content_system(html, F.col("headers")), "js_platform": F.when(F.col("raw_html").isNull(), detect.script_platform(html)),
        "waf_block": detect.firewall(F.col("status_code"), F.col("html")),
        "challenge": detect.is_challenge(F.col("status_code"), F.try_element_at("headers", F.lit("server")), F.try_element_at("headers", F.lit("cf-mitigated")), F.col("html")),
        "non_html": F.when((kind != "") & ~kind.contains("text/html") & ~kind.contains("application/xhtml"), F.trim(F.substring_index(kind, ";", 1))),
    }
    measures = {n: F.col(f"p.perf.{n}") for n in ("html_kb", "dom_nodes", "imgs_no_dims", "base64_images", "third_party_scripts", "render_blocking_scripts", "render_blocking_css")}
    measures |= {n: F.col(n) for n in ("load_time_s", "ttfb_ms") if n in fetched.columns}
    cols["speed_warnings"] = F.when(is_page, scoring.speed_issues(measures))
    keep = [c for c in fetched.columns if c not in ("html", "raw_html", "history", "headers", "final_url", "url", *cols)]
    body = [F.col(f"p.{n}").alias(n) for n in parsed.schema["p"].dataType.names if n not in ("robots",)]
    rows = parsed
    if compare_raw:
        rows = rows.withColumn("q", html_page.parse_html(F.when(is_page, F.col("raw_html")), final))
        names = ("title", "meta_description", "schema_types", "h1", "word_count", "internal_links", "external_links", "images_total", "images_no_alt")
        side = lambda s: {n: F.col(f"{s}.{n}") for n in names}
        cols["js_diff"] = F.when(F.col("raw_html").isNotNull(), detect.js_diff(side("p"), side("q")))
    out = rows.select(final.alias("url"), *keep, *body, *(c.alias(n) for n, c in cols.items()))
    return page_issues(out)


# ---- views over images, types and headings ----


def page_images(rows: DataFrame, seq: str) -> DataFrame:
    """``seq, page_url, pos, src, alt, classification`` of every image kept, widgets left out."""
    each = rows.select(F.col(seq).alias("seq"), F.col("url").alias("page_url"), F.posexplode_outer("images").alias("pos", "i")).select("seq", "page_url", "pos", "i.src", "i.alt", "i.classification")
    return each.filter((F.coalesce("src", F.lit("")) != "") & ~detect.is_widget_image(F.col("src")))


def images_by_source(images: DataFrame) -> DataFrame:
    """``src, uses, classification``: how often each image is used, with the class of its first use; worst classes first."""
    by = images.groupBy("src").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("seq", "pos", "classification")).alias("m")).select("src", "uses", F.col("m.classification").alias("classification"))
    rank = F.when(F.col("classification") == "missing", 0).when(F.col("classification") == "empty in link", 1).when(F.col("classification") == "empty", 2).otherwise(3)
    return by.orderBy(rank, F.col("uses").desc(), "src")


def images_missing_alt(images: DataFrame) -> DataFrame:
    """``src, uses, pages``: images (fragment dropped) that need a text."""
    bad = images.filter(F.col("classification").isin("missing", "empty in link", "empty (likely content)")).select(F.regexp_replace("src", "#.*", "").alias("src"), "page_url")
    per = bad.groupBy("src", "page_url").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("src").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("pages")).orderBy(F.col("uses").desc(), "src")


def image_totals(by_source: DataFrame) -> DataFrame:
    return by_source.groupBy("classification").agg(F.count(F.lit(1)).alias("images"), F.sum("uses").alias("uses"))


def schema_types(rows: DataFrame) -> DataFrame:
    """``type, pages``: on how many pages each schema type is; the empty type stands for pages without any."""
    kinds = F.coalesce(F.array_distinct("schema_types"), F.array().cast("array<string>"))
    return rows.select(F.explode(F.when(F.size(kinds) == 0, F.array(F.lit(""))).otherwise(kinds)).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("pages"))


def with_types(rows: DataFrame, types: list[str], words: str = "") -> DataFrame:
    """Pages with any of the schema types whose address holds the words."""
    hit = F.arrays_overlap("schema_types", F.array(*map(F.lit, types))) if types else F.lit(True)
    return rows.filter(hit & F.lower("url").contains(words.lower()))


def heading_columns(rows: DataFrame) -> DataFrame:
    """``url, h1_1, h1_2, ...``: as many columns as the page with the most h1 headings needs."""
    most = rows.agg(F.coalesce(F.max(F.size("h1_list")), F.lit(0))).first()[0]
    return rows.select("url", *(F.get("h1_list", F.lit(i)).alias(f"h1_{i + 1}") for i in range(max(1, most))))


def url_traps(probes: DataFrame, parents: DataFrame) -> DataFrame:
    """``kind, url, status, failed, serves`` of probes (``kind, url, status, title, parent``) for addresses that cannot exist: a 200
    is a failure; ``serves`` names the page whose title it repeats. ``parents`` has ``url, title``."""
    p = parents.select(F.col("url").alias("parent"), F.trim("title").alias("_t"))
    same = (F.coalesce("title", F.lit("")) != "") & (F.trim("title") == F.col("_t"))
    return probes.join(p, "parent", "left").select("kind", "url", "status", (F.coalesce("status", F.lit(0)) == 200).alias("failed"), F.when((F.col("status") == 200) & same, F.col("parent")).alias("serves"))


def with_profile(rows: DataFrame) -> DataFrame:
    """Adds label, exclusions and settings of each row's ``cms``; the table of profiles is fixed and small."""
    return rows.join(F.broadcast(detect.profiles(rows.sparkSession)), "cms", "left")


def robots_findings_first(rows: DataFrame, findings: list[str], seq: str) -> DataFrame:
    """Puts site-wide findings before the issues of the first row that has no error."""
    if not findings:
        return rows
    first = rows.filter(F.coalesce("error", F.lit("")) == "").agg(F.min(seq)).first()[0]
    return rows.withColumn("issues", F.when(F.col(seq) == F.lit(first), F.concat(F.array(*map(F.lit, findings)), "issues")).otherwise(F.col("issues")))


def page_detail(rows: DataFrame, links: DataFrame, url: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One page's row, the links to it (exact address first, then with its last slash toggled) and the links on it."""
    bare = url.rstrip("/")
    exact = links.filter(F.col("target") == url)
    to = links.filter(F.col("target").isin(bare, bare + "/")) if exact.isEmpty() else exact
    return rows.filter(F.col("url") == url), to, links.filter(F.col("source") == url)
