"""Functions on hand-made values: addresses, patterns, text, scores, signatures, robots rules."""

import pytest
from pyspark.sql import functions as F

from seamark.functions import detect, robots, scoring, text, urls


def one(spark, c, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'array<string>'}" for i, v in enumerate(values)))
    return df.select(c(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first()[0]


def many(spark, c, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", c(F.col("v")).alias("r")).orderBy("i").collect()]


def test_sitemap_key(spark):
    got = many(spark, urls.sitemap_key, ["http://www.A.test/B/%20/ ", "https://a.test/b?x=1#f", "", None, "https://a.test", "//a.test/"])
    assert got == ["https://a.test/b", "https://a.test/b", "", "", "https://a.test", "https://a.test"]


def test_duplicate_key(spark):
    got = many(spark, urls.duplicate_key, ["http://www.a.test/Shop/page/3/", "http://a.test/x/comment-page-2", "http://a.test/?q=1", "http://a.test/X%20", None])
    assert got == ["https://a.test/Shop", "https://a.test/x", "https://a.test/", "https://a.test/X", None]


def test_crawl_form(spark):
    got = many(spark, urls.crawl_form, ["HTTP://A.test?utm_source=1&b=2&a=&b=3#f", "http://a.test/x?add-to-cart=1", "http://a.test/p?q=a+b", None, "http://[bad"])
    assert got == ["http://a.test/?b=2&b=3&a=", "http://a.test/x", "http://a.test/p?q=a+b", None, "http://[bad"]


def test_other_forms(spark):
    assert many(spark, urls.slash_twin, ["http://a.test/x/", "http://a.test/x?q=1", "http://a.test/f.html", "http://a.test/"]) == ["http://a.test/x", "http://a.test/x/?q=1", None, "http://a.test//"]
    assert many(spark, urls.compare_key, ["http://A.test/X/?q=1", "http://a.test//", None]) == ["http://a.test/x/?q=1", "http://a.test", ""]
    assert many(spark, urls.bare_host, ["https://www.a.test/x", "A.test/", "www.a.test", None]) == ["a.test", "a.test", "a.test", ""]
    assert many(spark, urls.first_segment, ["http://a.test/x/y", "http://a.test/x", "http://a.test/", "http://a.test"]) == ["/x/", "/x", "/", "/"]
    assert many(spark, urls.display_path, ["https://a.test/x?y"]) == ["/x?y"]


def test_hygiene(spark):
    got = many(spark, urls.hygiene_flags, ["http://a.test/A_b//c%20?utm_x=1", "http://a.test/" + "x" * 101, "http://a.test/" + "x" * 102, "http://a.test/é"])
    assert got == [["uppercase", "underscores", "contains space", "multiple slashes", "contains parameters", "tracking parameters"], [], ["over 115 chars (116)"], ["non-ASCII characters"]]


def test_pagination(spark):
    u = ["/page/2/", "?page=1", "?page=2", "?_page=3", "?pg=10", "?a=1&paged=20", "/page/x"]
    assert many(spark, urls.is_pagination, [f"http://a.test{x}" for x in u]) == [True, False, True, True, False, True, False]


@pytest.mark.parametrize(
    ("a", "b", "kind"),
    [
        ("http://a.test/x", "http://a.test/x", None), ("http://a.test/x", "https://a.test/x", "http_to_https"), ("https://a.test/x", "https://www.a.test/x", "www_normalize"), ("https://a.test/x", "https://a.test/x/", "trailing_slash"),
        ("https://a.test/x", "https://a.test/y", "other"), ("https://a.test/x?a=1", "https://a.test/x", "other"), ("https://a.test/x", None, None), ("https://a.test/x", "https://b.test/x", "other"),
    ],
)
def test_redirect_kind(spark, a, b, kind):
    assert one(spark, urls.redirect_kind, a, b) == kind


def test_admissible(spark):
    u = ["http://a.test/x.pdf", "http://a.test/wp-json/y", "http://a.test/?e-page-7=2", "http://a.test/?infinity=1", "http://a.test/team/x/team", "http://a.test/2026/01/01/01/", "http://a.test/abc/abc", "http://a.test/ok"]
    assert many(spark, urls.is_admissible, u) == [False, False, False, False, False, True, True, True]
    got = many(spark, lambda c: urls.is_admissible(c, include=["/blog/*"], exclude=["*secret*"]), ["http://a.test/blog/x", "http://a.test/blog/secret", "http://a.test/shop"])
    assert got == [True, False, False]
    assert urls.parse_patterns(" /a \n\n# no\n/b$") == ["/a", "/b$"]


@pytest.mark.parametrize(
    ("pattern", "url", "hit"),
    [("/a", "http://x.test/abc", True), ("/a$", "http://x.test/a", True), ("/a$", "http://x.test/ab", False), ("*?x*", "http://x.test/p?x=1", True), ("/p?x", "http://x.test/pqx", False), ("/*.pdf$", "http://x.test/d/f.pdf", True), ("http://x.test/q", "http://x.test/q", True), ("", "http://x.test/", False)],
)
def test_patterns(spark, pattern, url, hit):
    assert one(spark, lambda u: urls.matches_pattern(u, pattern), url) is hit
    rx = urls.pattern_column_regex(F.col("c1"))
    got = spark.createDataFrame([(url, pattern)], "c0 string, c1 string").select(F.coalesce(F.regexp_like(urls.path_query(F.col("c0")), rx) | F.regexp_like("c0", rx), F.lit(False))).first()[0]
    assert got is hit


def test_text(spark):
    assert many(spark, text.clean_heading, ["  A  b , c !", None]) == ["A b, c!", None]
    assert many(spark, text.tokens, ["It's re-used, A x naïve", None]) == [["it's", "re-used", "na", "ve"], []]
    assert many(spark, text.content_tokens, ["The cat is on the mat"]) == [["cat", "mat"]]
    w = one(spark, text.shingles, ["a", "b", "c", "d", "e", "f"])
    assert w == ["a b c d e", "b c d e f"] and one(spark, text.shingles, ["a", "b"]) == []
    assert many(spark, text.body_hash, ["A  b", "a b\n", "", None])[0] == many(spark, text.body_hash, ["a b"])[0] and many(spark, text.body_hash, ["", None]) == ["", ""]
    assert many(spark, text.issue_key, ["Title too long (70)", "3 imgs missing alt"]) == ["Title too long", "3 imgs missing alt"]
    assert many(spark, text.issue_compare_key, ["Title too long (70)", "3 imgs missing alt", "(x)"]) == ["Title too long", "imgs missing alt", "(x)"]
    assert many(spark, text.issue_label, ["3 imgs missing alt", "HTTP 404 error", "URL: spaces", "www normalization redirect (1 hop)", "noindex", "Odd (1)"]) == ["Images missing alt", "HTTP errors (4xx / 5xx)", "URL hygiene", "Redirects", "Noindex pages", "Odd"]
    assert many(spark, text.http_date, ["Tue, 03 Jun 2031 10:00:00 GMT", "soon", None]) == ["2031-06-03", "", ""]
    assert many(spark, text.fold, ["Straße ", "ＡＢ", None]) == ["strasse", "ab", None]
    assert many(spark, text.csv_cell, ['a"b', None]) == ['"a""b"', '""']
    assert text.safe_sheet_names(["a/b", "A b", "x" * 40]) == ["a b", "A b (2)", "x" * 31]
    assert text.safe_file_name("é x/y.json") == "__x_y.json"


def test_scores(spark):
    s = lambda *i: one(spark, scoring.page_score, list(i))
    assert s("noindex") == 100 and s("Missing title") == 80 and s("HTTP 404 error", "noindex") == 0 and s("Title too long (70)", "URL: uppercase") == 94
    assert s("Missing title", "Missing viewport", "Missing meta description", "Missing canonical", "Missing H1", "Thin content (3 words)", "Mixed content (1 resources)", "3 imgs missing alt", "Served over HTTP (insecure)") == 0
    assert many(spark, scoring.severity, ["AI crawlers blocked in robots.txt — x", "Slow (4s)", "noindex"]) == ["error", "warn", "info"]
    assert many(spark, lambda c: scoring.severity(c, True), ["AI crawlers blocked in robots.txt — x"]) == ["info"]
    assert one(spark, scoring.competition, 10**3) == 0.0 and one(spark, scoring.competition, 10**10) == 100.0 and one(spark, scoring.competition, 0) == 50.0
    assert one(spark, scoring.volume_proxy, 1, 0.0, 1) == round(45 - 100 / 3 * 0.15, 1)
    assert one(spark, scoring.opportunity, 10.0, 0.0, 20.0, 50.0) == 32.0
    assert one(spark, lambda v: scoring.vital_rating("cls", v), 0.1) == "good" and one(spark, lambda v: scoring.vital_rating("lcp_ms", v), 4001.0) == "poor"
    at = lambda **m: spark.range(1).select(scoring.speed_score({k: F.lit(v) for k, v in m.items()})).first()[0]
    assert at(load_time_s=3.0, ttfb_ms=800) == 100 and at(load_time_s=3.1, ttfb_ms=801, html_kb=151, dom_nodes=1501, imgs_no_dims=6, base64_images=4, third_party_scripts=6, render_blocking_scripts=4, render_blocking_css=3) == 12


def test_signatures(spark):
    assert many(spark, detect.content_system, ['<link href="/wp-content/x">', '<link href="/wp-content/x"><!-- Yoast SEO -->', '<meta name="generator" content="Joomla! 4">', "plain", None]) == ["wordpress", "wordpress_yoast", "joomla", None, None]
    assert many(spark, detect.script_platform, ['<div id="__next">', "x"]) == ["Next.js", None]
    assert many(spark, detect.trackers, ["googletagmanager.com/gtm.js clarity.ms/tag", ""]) == [["Google Tag Manager", "Microsoft Clarity"], []]
    assert many(spark, detect.is_widget_image, ["https://a.gstatic.com/x.png", "https://notgstatic.com/x.png", "https://a.test/g.gif", None]) == [True, False, True, False]
    assert many(spark, detect.looks_decorative, ["/i/Layer-1.svg", "/i/hero-team.jpg", "/i/hero-bg-300x200.jpg", "", "/i/logo-white.png"]) == [True, False, True, True, False]
    df = spark.createDataFrame([(403, "Attention Required! | Cloudflare"), (200, "wordfence"), (503, "Generated by Wordfence")], "s int, b string")
    assert [r[0] for r in df.select(detect.firewall(F.col("s"), F.col("b"))).collect()] == ["cloudflare", None, "wordfence"]


def test_js_diff(spark):
    names = "title meta_description h1".split()
    js = {n: F.lit("a") for n in names} | {"schema_types": F.array(F.lit("B"), F.lit("A"), F.lit("A"))} | {n: F.lit(100) for n in ("word_count", "internal_links", "external_links", "images_total", "images_no_alt")}
    raw = dict(js) | {"schema_types": F.array(F.lit("A"), F.lit("B"))}
    d = lambda **k: spark.range(1).select(detect.js_diff(js, raw | k).alias("d")).first()[0]
    assert d().severity == "none" and d(word_count=F.lit(75)).severity == "none" and d(word_count=F.lit(74)).fields == ["word_count"]
    assert d(title=F.lit("x"), images_no_alt=F.lit(1)).severity == "critical" and d(internal_links=F.lit(1)).severity == "medium"


ROBOTS = """User-agent: GPTBot
User-agent: CCBot
Disallow: /

User-agent: *
Disallow: /a # c
Allow: /a/b
Disallow:
Disallow: /x*y$
Sitemap: https://a.test/s.xml
Content-Signal: search=yes, ai-train=no"""


def test_robots(spark):
    g = robots.parse_groups(ROBOTS)
    assert g["gptbot"] == g["ccbot"] == [("disallow", "/")] and g["*"] == [("disallow", "/a"), ("allow", "/a/b"), ("disallow", ""), ("disallow", "/x*y$")]
    assert robots.sitemap_lines(ROBOTS) == ["https://a.test/s.xml"]
    found = robots.audit(ROBOTS)
    assert found[0] == "AI crawlers blocked in robots.txt — GPTBot" and found[1].startswith("AI training bots blocked in robots.txt — CCBot (+ Content-Signal ai-train=no)") and len(found) == 2
    assert robots.audit("User-agent: *\nDisallow: /")[-1].startswith("Search engines blocked in robots.txt — Googlebot")
    assert "+6 more" in robots.audit("User-agent: *\nDisallow: /*")[0] and robots.audit(None) == [] and robots.audit("User-agent: *\nDisallow: /\nAllow: /") == []
    texts = spark.createDataFrame([("a.test", ROBOTS), ("b.test", None)], "host string, text string")
    rules = robots.rules_table(texts)
    rows = spark.createDataFrame([("a.test", "http://a.test/a"), ("a.test", "http://a.test/a/b"), ("a.test", "http://a.test/xzzy"), ("a.test", "http://a.test/xzzyq"), ("b.test", "http://b.test/a")], "host string, url string")
    got = {r.url: r.allowed for r in robots.decide(rows, rules.filter("bot = '*'"), ["host"]).collect()}
    assert list(got.values()).count(False) == 2 and got["http://a.test/a"] is False and got["http://a.test/xzzy"] is False
    bots = spark.createDataFrame([("GPTBot",), ("Googlebot",)], "bot string")
    assert {tuple(r) for r in robots.blocked_bots(rules, bots).collect()} == {("a.test", "GPTBot")}
