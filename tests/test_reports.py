"""Audit rules, reports, links, near-duplicates, comparisons, sitemaps, keywords, sources, sinks and streams on hand-made rows."""

import datetime as dt
import gzip
import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seamark.operators import audit, compare, duplicates, keywords, links, reports, sitemap
from seamark.session import checkpoint_dir
from seamark.sources import readers, sinks
from seamark.streaming import crawl

ROW = (
    "page_id long, url string, original_url string, status_code int, title string, title_len int, meta_description string, h1 string, canonical string, canonical_kind string, word_count int, body_text string, "
    "response_time double, indexable boolean, depth int, error string, redirect_url string, redirect_hops int, content_type string, crawl_id long, internal_link_urls array<struct<target:string,anchor:string,placement:string>>"
)
GOOD = {"url": "https://a.test/x", "original_url": None, "status_code": 200, "title": "t" * 40, "title_len": 40, "meta_description": "m" * 100, "h1": "h", "canonical": None, "canonical_kind": "self", "word_count": 300, "body_text": "b",
        "response_time": 0.5, "indexable": True, "depth": 1, "error": None, "redirect_url": None, "redirect_hops": 0, "content_type": "text/html", "crawl_id": 1, "internal_link_urls": None}


def rows(spark, *changes):
    return spark.createDataFrame([tuple(({"page_id": i} | GOOD | c).values()) for i, c in enumerate(changes, 1)], ROW)


def issues(spark, **change):
    return audit.page_issues(rows(spark, change)).first().issues


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []), ({"title": "", "title_len": 0}, ["Missing title"]), ({"title_len": 29}, ["Title too short (29)"]), ({"title_len": 30}, []), ({"title_len": 60}, []), ({"title_len": 61}, ["Title too long (61)"]),
        ({"meta_description": None}, ["Missing meta description"]), ({"meta_description": "m" * 69}, ["Meta desc too short (69)"]), ({"meta_description": "m" * 70}, []), ({"meta_description": "m" * 161}, ["Meta desc too long (161)"]),
        ({"word_count": 199}, ["Thin content (199 words)"]), ({"word_count": 200}, []), ({"h1": None}, ["Missing H1"]), ({"h1": " " + "T" * 40}, ["H1 same as title"]), ({"canonical_kind": "missing"}, ["Missing canonical"]),
        ({"canonical_kind": "canonicalised", "title": None}, ["Canonicalised (points elsewhere)"]), ({"indexable": False, "title": None}, ["noindex"]), ({"indexable": None}, []), ({"status_code": 404, "title": None}, ["HTTP 404 error"]),
        ({"response_time": 3.0}, []), ({"response_time": 3.5}, ["Slow (3.5s)"]), ({"url": "http://a.test/x"}, ["Served over HTTP (insecure)"]), ({"url": "https://a.test/page/2/", "title": None}, []),
        ({"url": "https://a.test/A", "original_url": "https://a.test/a", "redirect_url": "https://a.test/A", "redirect_hops": 2, "title": None}, ["Redirect (2 hops)"]), ({"status_code": 0, "error": "Read timed out"}, ["Timeout"]), ({"status_code": 0, "error": None}, []),
        ({"url": "https://a.test/x_y"}, ["URL: underscores"]),
    ],
)
def test_rules(spark, change, want):
    assert issues(spark, **change) == want


def test_noindex_can_be_ignored(spark):
    assert audit.page_issues(rows(spark, {"indexable": False, "title": None}), ignore_noindex=True).first().issues == ["Missing title", "noindex"]


def test_invariants_on_data(spark, data):
    p = audit.page_issues(spark.read.parquet(f"{data}/page_audit.parquet"))
    e = p.select("title_len", "title", "meta_description", "h1", "word_count", F.explode("issues").alias("i"))
    assert e.filter("i like 'Title too long%' and title_len <= 60").count() == 0
    assert e.filter("i like 'Title too short%' and (title_len >= 30 or title = '')").count() == 0
    assert e.filter("i like 'Meta desc too long%' and length(meta_description) <= 160").count() == 0
    assert e.filter("i = 'Missing H1' and h1 <> ''").count() == 0
    assert e.filter("i like 'Thin content%' and word_count >= 200").count() == 0
    assert audit.scored(p).filter("score < 0 or score > 100").count() == 0


def test_views_of_nothing(spark):
    p = audit.page_issues(rows(spark, {}).limit(0))
    assert audit.issue_histogram(p).count() == audit.issue_cards(p, "page_id").count() == audit.site_score(p).count() == reports.path_tree(p).count() == 0
    assert [r.pages for r in audit.severity_counts(p).collect()] == [0, 0, 0]
    assert reports.summary(p).first().pages == 0 and compare.totals(p).first().avg_response_time == 0.0


def test_upsert_and_sorting(spark):
    old, new = rows(spark, {"url": "a", "depth": 3}, {"url": "b"}), rows(spark, {"url": "a", "depth": 0, "title": "new"}, {"url": "c"})
    got = {r.url: (r.depth, r.title) for r in reports.upsert(old, new).collect()}
    assert got["a"] == (3, "new") and set(got) == {"a", "b", "c"}
    df = spark.createDataFrame([("10",), ("9",), ("",), (None,)], "c string")
    assert [r.c for r in reports.grid_sort(df, "c").collect()][:2] == ["9", "10"] and [r.c for r in reports.grid_sort(df, "c", True).collect()][:2] == ["10", "9"]
    words = spark.createDataFrame([("b",), ("A",), ("10",), ("",)], "c string")
    assert [r.c for r in reports.grid_sort(words, "c").collect()] == ["10", "A", "b", ""]
    assert reports.search(old, "B", "url").count() == 1


def test_stop_reason(spark):
    link = [("t", "a", "main")]
    r = lambda *c: reports.stop_reason(rows(spark, *c)).first().reason
    assert r({"error": "x"}) == "start page has an error" and r({}) == "no internal links" and r({"internal_link_urls": link}) == "no link could be crawled" and r({}, {}) is None


def test_link_views(spark):
    e = links.edges(rows(spark, {"url": "s", "internal_link_urls": [("t/", "Read more", "nav"), ("t/", "Read more", "nav"), None, ("u", "", "main")]}, {"url": "t", "status_code": 404}, {"url": "w", "status_code": 500}))
    assert {(r.target, r.links, r.sources) for r in links.inlinks(e).collect()} == {("t/", 1, 1), ("u", 1, 1)}
    got = {(r.url, r.source) for r in links.broken_with_inlinks(rows(spark, {"url": "t", "status_code": 404}, {"url": "w", "status_code": 500}), e).collect()}
    assert got == {("t", "s"), ("w", None)}
    cloud = links.anchor_cloud(e).collect()
    assert [(r.anchor, r.links, r.generic, r.weight) for r in cloud] == [("read more", 2, True, 1.0)]
    ext = spark.createDataFrame([("http://x.test/1", "nofollow", "_blank"), ("http://www.x.test/2", "ugc", ""), ("http://y.test", None, "_blank"), ("", "", "")], "url string, rel string, target string")
    assert {tuple(r) for r in links.external_risk(ext).collect()} == {("ok", 1, 1), ("high", 1, 1), ("follow", 1, 1)}


def test_hreflang(spark):
    d = spark.createDataFrame([("a", "en", "a"), ("a", "de", "b"), ("a", "x-default", "a"), ("a", "x-default", "c"), ("a", "english", "z"), ("b", "de", "b"), ("b", "fr", "uncrawled"), ("c", None, "a")], "url string, lang string, href string")
    assert {tuple(r) for r in links.hreflang_issues(d).collect()} == {("a", "invalid_code", "english"), ("a", "dup_x_default", "2"), ("a", "no_return_tag", "b")}


def test_breadth_first(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "y"), (None, "z")], "source string, target string")
    s = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in links.breadth_first(e, s).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {tuple(r) for r in links.breadth_first(e, s, 1).collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_link_depth_has_no_end(spark, tmp_path):
    import __spark_entry__ as entry

    rng, n = random.Random(3), 24
    to = {i: [i + 1, *(rng.randrange(i + 1) for _ in range(2))] for i in range(n)}
    url = lambda i: f"http://a.test/{i or ''}"
    df = spark.createDataFrame([(i, 1, url(i), [(url(t), "a", "main") for t in to[i]]) for i in range(n)], "page_id long, crawl_id long, url string, internal_link_urls array<struct<target:string,anchor:string,placement:string>>")
    df.write.parquet(str(tmp_path / "page_audit.parquet"))
    assert sorted(r.depth for r in entry.queries()["link_depth"](spark, str(tmp_path)).collect()) == list(range(n + 1))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("bak", "del", "fin", "gor", "hup")]
    base = [[rng.choice(words) for _ in range(90)] for _ in range(6)]
    docs = []
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, " ".join(t)))
    docs += [(100, docs[0][1]), (101, docs[0][1].upper()), (102, "too short"), (103, None), (104, "")]
    df = spark.createDataFrame(docs, "id long, text string")
    sets = duplicates.shingle_sets(df, "id", "text").cache()
    have = {r.id: set(r.shingles) for r in sets.collect()}
    reps = {r.class_id: set(r.shingles) for r in duplicates.classes(sets).collect()}
    want = {(a, b) for a in reps for b in reps if a < b and len(reps[a] & reps[b]) / len(reps[a] | reps[b]) >= 0.8}
    pairs = duplicates.similar_pairs(sets).cache()
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == want and len(want) > 5
    m = {r.id: r for r in duplicates.membership(sets, pairs).collect()}
    assert m[100].class_id == m[101].class_id == m[0].class_id and m[0].copies >= 3 and not {102, 103, 104} & set(have)
    assert sum(r.links for r in {r.class_id: r for r in m.values()}.values()) == 2 * len(want)


def _bytes_held(spark):
    """Bytes of shuffle files and intermediate tables."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    shuffles = sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllFiles()))
    return shuffles + sum(p.stat().st_size for p in Path(checkpoint_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())


def test_near_duplicates_of_long_texts_in_little_room(spark, tmp_path):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so") for b in ("bak", "del", "fin", "gor", "hup") for c in ("an", "en", "un")]
    base = [[rng.choice(words) for _ in range(n)] for n in (60, 300, 900)]
    docs = []
    for i in range(900):  # cut at either end to about the least similarity, and changed here and there
        t = list(base[i % 3]) if i % 5 == 0 else [rng.choice(words) for _ in range(rng.randint(40, 700))]
        t = t[rng.randint(0, len(t) // 8) : len(t) - rng.randint(0, len(t) // 8)]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, " ".join(t)))
    spark.createDataFrame(docs, "id long, text string").write.parquet(str(tmp_path / "docs"))
    before = _bytes_held(spark)
    sets = duplicates.shingle_sets(spark.read.parquet(str(tmp_path / "docs")), "id", "text")
    pairs = duplicates.similar_pairs(sets)
    held = _bytes_held(spark) - before
    reps = {r.class_id: set(r.shingles) for r in duplicates.classes(sets).collect()}
    want = {(a, b): len(reps[a] & reps[b]) / len(reps[a] | reps[b]) for a in reps for b in reps if a < b and len(reps[a] & reps[b]) / len(reps[a] | reps[b]) >= 0.8}
    assert {(r.class_a, r.class_b): r.similarity for r in pairs.collect()} == pytest.approx(want, abs=1e-4) and len(want) > 500
    assert held < 4 * sum(p.stat().st_size for p in (tmp_path / "docs").iterdir())


def test_document_classes_have_every_document(spark):
    short = "red fox jumps over seven lazy dogs today"
    docs = [(1, short), (2, short.upper()), (3, short + " unheard"), (4, "tiny text"), (5, " Tiny  TEXT "), (6, None), (7, ""), (8, "Привет мир"), (9, "привет мир"), (10, "Другой текст")]
    got = {r.id: (r.class_id, r.copies, r.links) for r in duplicates.document_classes(spark.createDataFrame(docs, "id long, text string"), "id", "text").collect()}
    assert got == {1: (1, 3, 0), 2: (1, 3, 0), 3: (1, 3, 0), 4: (4, 2, 0), 5: (4, 2, 0), 6: (6, 2, 0), 7: (6, 2, 0), 8: (8, 2, 0), 9: (8, 2, 0), 10: (10, 1, 0)}


def test_compare_is_symmetric(spark):
    a = rows(spark, {"url": "http://A.test/x/"}, {"url": "http://a.test/y", "title": None}, {"url": "http://a.test/z"})
    b = rows(spark, {"url": "http://a.test/X", "title": "other"}, {"url": "http://a.test/y", "title": ""}, {"url": "http://a.test/new"})
    kinds = lambda x, y: {r.key: r.kind for r in compare.page_diff(x, y, "page_id").collect()}
    assert kinds(a, b) == {"http://a.test/x": "changed", "http://a.test/y": "unchanged", "http://a.test/z": "removed", "http://a.test/new": "added"}
    back = kinds(b, a)
    assert back["http://a.test/z"] == "added" and back["http://a.test/new"] == "removed" and set(kinds(a, a).values()) == {"unchanged"}


def test_sitemap_reports(spark):
    c = rows(spark, {"url": "https://a.test/ok"}, {"url": "https://a.test/gone", "status_code": 404}, {"url": "https://a.test/r", "redirect_url": "https://a.test/R2"}, {"url": "https://a.test/self", "redirect_url": "http://www.a.test/self/"},
             {"url": "https://a.test/no", "indexable": False}, {"url": "https://a.test/alias", "canonical": "https://a.test/real"}, {"url": "https://a.test/unlisted"})
    s = spark.createDataFrame([(f"http://a.test/{x}",) for x in ("ok", "gone", "r", "self", "no", "real", "none", "page/3/")], "url string")
    t = spark.createDataFrame([("https://a.test/ok",)], "target string")
    got = {(r.report, r.listed.rsplit("test/", 1)[1]) for r in sitemap.sitemap_reports(c, s, t, "page_id").collect()}
    assert {x for x in got if x[0] != "no_inlinks"} == {("non_200", "gone"), ("redirects", "r"), ("non_indexable", "no"), ("sitemap_only", "none"), ("pagination", "page/3/")}
    assert ("no_inlinks", "real") in got and ("no_inlinks", "ok") not in got
    assert [r.url for r in sitemap.missing_from_sitemap(c, s, "page_id").collect()] == ["https://a.test/unlisted"]


def test_sitemap_files(spark):
    p = rows(spark, *({"url": f"https://a.test/{i}&x"} for i in range(25)), {"url": "https://a.test/1&x"}, {"status_code": 404})
    ch = sitemap.chunked(sitemap.sitemap_entries(p, "page_id"), 10).orderBy("seq").collect()
    assert [r.chunk for r in ch] == [1] * 10 + [2] * 10 + [3] * 5
    xml = sinks.sitemap_files(p, "page_id").first()
    assert xml.urls == 25 and "<loc>https://a.test/0&amp;x</loc>" in xml.xml
    parsed = readers.parse_sitemap("s.xml", xml.xml.encode())
    assert parsed[-1][2] == "25" and parsed[0][2] == "https://a.test/0&x"


def test_sitemap_walk(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<sitemapindex {ns}><sitemap><loc>b.xml.gz</loc></sitemap><sitemap><loc>a.xml</loc></sitemap><sitemap><loc>none.xml</loc></sitemap></sitemapindex>"
    leaf = f"<urlset {ns}><url><loc> http://a.test/1 </loc><lastmod>2031-01-01</lastmod></url><url/></urlset>"
    files = spark.createDataFrame([("a.xml", index.encode()), ("b.xml.gz", gzip.compress(leaf.encode())), ("bad.xml", b"<x")], "url string, content binary")
    got = readers.walk_sitemaps(files, spark.createDataFrame([("a.xml",), ("bad.xml",)], "url string")).collect()
    assert {(r.kind, r.url, r.depth) for r in got if r.kind == "url"} == {("url", "http://a.test/1", 1)}
    assert {(r.source_sitemap, r.error.split(":")[0]) for r in got if r.kind == "error"} == {("bad.xml", "xml_parse"), ("none.xml", "missing")}
    assert readers.sitemap_seeds("Sitemap: http://a.test/s.xml", "http://a.test/") == ["http://a.test/s.xml"] and len(readers.sitemap_seeds(None, "http://a.test/")) == 9


def test_saved_crawls(spark, tmp_path):
    for folder, name, doc in (("one", "1.json", {"name": "a", "saved_at": 5, "results": [{"url": "u", "og_tags": {"t": "x"}, "internal_link_urls": [["t", "a", "nav"]]}]}), ("two", "1.json", {"name": "b", "saved_at": 6}), ("two", "2.json", {"name": "c", "saved_at": 7, "results": []}), ("two", "3.json", None)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("{broken" if doc is None else json.dumps(doc, indent=1))
    df = readers.saved_crawls(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert {(r.file_name, r.name) for r in df.collect()} == {("1.json", "a"), ("2.json", "c")}
    assert [(r.url, r.og_tags, r.depth) for r in readers.crawl_rows(df).collect()] == [("u", {"t": "x"}, None)]
    with pytest.raises(ValueError, match="without a path"):
        readers.saved_crawls(spark, [str(tmp_path)], "../x.json")
    assert readers.rows_of_request(spark, [{"url": "u", "new": 1}]).first().url == "u"


def test_sinks(spark, tmp_path):
    p = audit.page_issues(rows(spark, {"title": 'say "hi"'}))
    sinks.write_csv(sinks.all_pages(p), str(tmp_path / "csv"))
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))
    assert '"say ""hi"""' in text and text.startswith('"url"')
    day = 1_935_000_000
    sinks.save_snapshot(p, str(tmp_path / "snaps"), "a/b c", day)
    assert spark.read.parquet(str(tmp_path / "snaps")).first().saved_at == day
    assert sinks.expired_days(spark, str(tmp_path / "snaps"), day + 29 * 86_400) == []
    old = sinks.expired_days(spark, str(tmp_path / "snaps"), day + 32 * 86_400)
    assert len(old) == 1
    sinks.drop_paths(spark, old)
    assert not list((tmp_path / "snaps").glob("saved_day*"))
    for _ in range(2):
        sinks.append_title_history(p, str(tmp_path / "history"), "c", day, "s")
    assert spark.read.json(str(tmp_path / "history")).count() == 2
    assert sinks.write_workbook({"All Pages": p.select("url"), "all pages": p.select("title")}, str(tmp_path / "book"))
    assert sinks.union_reports({"x": p.select("url"), "y": p.select("url")}).count() == 2


def test_page_speed(spark):
    doc = {"lighthouseResult": {"categories": {"performance": {"score": 0.87}}, "audits": {"largest-contentful-paint": {"numericValue": 2500.5, "score": 0.5, "title": "L"}, "x": {"score": 0.95, "title": "X"}, "y": {"score": None}}}}
    df = spark.createDataFrame([("u", json.dumps(doc)), ("v", "{"), ("w", None)], "url string, payload string")
    got = {r.url: r for r in readers.page_speed(df).collect()}
    assert got["u"].score == 87 and got["u"].largest_contentful_paint == 2500.5 and got["v"].score is None and got["w"].score is None
    assert [(r.audit, r.score) for r in readers.failing_audits(df).collect()] == [("largest-contentful-paint", 0.5)]


def test_keywords(spark):
    pay = spark.createDataFrame([("seed", '["seed", ["Seed one", "seed", "SEED ONE "]]'), ("seed one", '["q", ["deep"]]'), ("seed a", '["q", ["apple"]]'), ("x", "nonsense")], "query string, payload string")
    got = {(r.keyword, r.depth, r.ac_rank) for r in keywords.expand("seed", keywords.suggestions(pay)).collect()}
    assert {(k.strip().lower(), d) for k, d, _ in got} == {("seed", 0), ("seed one", 1), ("apple", 1), ("deep", 2)}
    pts = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 10, 10, 20, 20, 20])] + [("b", i, 5.0) for i in range(5)] + [("c", i, 0.0 if i < 3 else None) for i in range(6)], "keyword string, ts int, interest double")
    t = {r.keyword: (r.direction, r.velocity) for r in keywords.trend_features(pts, ["keyword"]).collect()}
    assert t == {"a": (10.0, 100.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}
    serp = spark.createDataFrame([("buy cheap shoes", 'About 1,000,000 results <div id="tads"></div><a href="/aclk?x">')], "keyword string, html string")
    s = keywords.result_signals(serp).first()
    assert (s.result_count, s.ad_count, s.ad_density) == (1_000_000, 2, 50.0) and s.competition == 42.9
    assert s.commercial_intent == round(50 * 0.4 + 25 + (100 - 300 / 7) * 0.1, 1)
    k = keywords.scored_keywords(spark.createDataFrame([("a", 1), ("z", None)], "keyword string, ac_rank int"), keywords.trend_features(pts, ["keyword"]), keywords.result_signals(serp))
    st = {r.keyword: (r.trends_status, r.serp_status) for r in k.collect()}
    assert st == {"a": ("ok", "skipped"), "z": ("skipped", "skipped")}
    assert {r.metric: r.value for r in keywords.keyword_summary(k, "a").collect()}["trends_ok"] == "1"


def test_pacing():
    p, r = crawl.next_pace(1.0, 429, None, None)
    assert (p, r) == (10.0, 30.0) and crawl.next_pace(10.0, 503, None, None) == (20.0, 30.0) and crawl.next_pace(30.0, 503, None, None)[0] == 40.0
    assert crawl.next_pace(1.0, 503, "wordfence", None) == (20.0, 300.0) and crawl.next_pace(1.0, 403, None, None) == (10.0, 60.0) and crawl.next_pace(1.0, 0, None, None) == (1.5, 0.0)
    assert crawl.next_pace(1.1, 200, None, None) == (1.0, 0.0) and crawl.next_pace(1.0, 200, None, None) == (1.0, 0.0) and crawl.next_pace(15.0, 200, None, "x")[0] == 20.0
    s, due = 0, []
    for bad in [True] * 7 + [False]:
        s, n = crawl.next_streak(s, bad)
        due.append(n)
    assert due == [None, None, 3, None, None, 6, None, None] and s == 6


def log(n=60):
    rng = random.Random(1)
    return [(i, rng.choice("ab"), f"u{i}", rng.choice([200, 200, 429, 403, 0, 404]), 0.1, None, None, dt.datetime(2031, 1, 1) + dt.timedelta(minutes=i), [("t", "a", "nav")]) for i in range(n)]


def folded():
    state, want = {}, {}
    for seq, host, _, status, *_ in log():
        pace, streak = state.get(host, (1.0, 0))
        pace, _ = crawl.next_pace(pace, status, None, None)
        streak, _ = crawl.next_streak(streak, status >= 400 or status == 0)
        state[host] = (pace, streak)
        want[seq] = (pace, streak)
    return want


def test_batch_pacing(spark):
    got = crawl.batch_pacing(spark.createDataFrame(log(), crawl.PAGE_EVENT)).collect()
    assert {r.seq: (r.pace, r.streak) for r in got} == folded()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        lines = [json.dumps({"seq": r[0], "host": r[1], "url": r[2], "status_code": r[3], "response_time": r[4], "ts": r[7].isoformat(), "internal_link_urls": [{"target": "t"}]}) for r in log()[k * 20 : k * 20 + 20]]
        (src / f"{k}.json").write_text("\n".join(lines))
        os.utime(src / f"{k}.json", (1_900_000_000 + k, 1_900_000_000 + k))
    ev = crawl.read_events(spark, str(src))
    for name, df, mode in (("totals", crawl.running_totals(ev), "complete"), ("targets", crawl.running_inlinks(ev), "complete"), ("pace", crawl.stream_pacing(ev), "append")):
        crawl.start(df, name, mode, str(tmp_path / f"c_{name}")).awaitTermination(120)
    assert spark.table("totals").first().crawled == 60 and spark.table("targets").first().links == 60
    assert {r.seq: (r.pace, r.streak) for r in spark.table("pace").collect()} == folded()


def test_audit_rows(spark):
    from seamark.operators import extract

    html = '<html><head><title>Hello</title><link rel="canonical" href="/x"><meta name=viewport content=w></head><body><img src="/a.jpg"><img src="/a.jpg" alt="x"><h1>One</h1><h1>Two</h1>text</body></html>'
    fetched = spark.createDataFrame(
        [
            (1, "http://a.test/x", "https://a.test/x", 200, {"Content-Type": "text/html", "X-Robots-Tag": "NOINDEX", "Strict-Transport-Security": "1"}, html, html.replace("Hello", ""), [("http://a.test/x", 301)], 0.2, None),
            (2, "https://a.test/y", "https://a.test/y", 404, {}, html, None, [], 0.2, "HTTP 404"),
            (3, "https://a.test/z", None, 200, None, html, None, None, 4.5, None),
            (4, "https://a.test/f.pdf", None, 200, {"content-type": "application/pdf"}, None, None, None, 0.1, None),
        ],
        "seq int, " + extract.FETCHED,
    )
    rows = extract.audit_rows(fetched, compare_raw=True)
    got = {r.seq: r for r in rows.collect()}
    a = got[1]
    assert (a.url, a.original_url, a.redirect_kind, a.redirect_status, a.redirect_hops) == ("https://a.test/x", "http://a.test/x", "http_to_https", 301, 1)
    assert not a.indexable and a.security.hsts and a.security.is_https and a.canonical_kind == "self" and a.js_diff.severity == "critical"
    assert "HTTP→HTTPS redirect (1 hop)" in a.issues and "noindex" in a.issues
    assert got[2].issues == ["HTTP 404 error"] and got[2].title == ""
    assert {"Title too short (5)", "Multiple H1s (2)", "1 imgs missing alt", "No schema", "Missing Open Graph tags", "Missing Twitter Card", "No analytics detected", "Slow (4.5s)"} <= set(got[3].issues) or got[3].canonical_kind == "canonicalised"
    assert got[4].title == ""
    images = extract.page_images(rows, "seq")
    assert [(r.src, r.uses, r.classification) for r in extract.images_by_source(images).collect()][0] == ("https://a.test/a.jpg", 4, "missing")
    assert extract.images_missing_alt(images).first().pages == 2
    assert {(r.type, r.pages) for r in extract.schema_types(rows).collect()} == {("", 4)}
    assert extract.heading_columns(rows).columns == ["url", "h1_1", "h1_2"]
    assert extract.robots_findings_first(rows, ["AI crawlers blocked in robots.txt — x"], "seq").orderBy("seq").first().issues[0].startswith("AI crawlers")
    profiles = extract.with_profile(spark.createDataFrame([("ghost",), (None,)], "cms string"))
    assert {(r.cms, r.label) for r in profiles.collect()} == {("ghost", "Ghost"), (None, None)}
    probes = spark.createDataFrame([("root", "r", 404, None, None), ("nested", "n", 200, "T ", "p")], "kind string, url string, status int, title string, parent string")
    assert {(r.kind, r.failed, r.serves) for r in extract.url_traps(probes, spark.createDataFrame([("p", "T")], "url string, title string")).collect()} == {("root", False, None), ("nested", True, "p")}
    e = spark.createDataFrame([("s", "https://a.test/x/"), ("https://a.test/x", "q")], "source string, target string")
    row, to, out = extract.page_detail(rows, e, "https://a.test/x")
    assert (row.count(), to.count(), out.count()) == (1, 1, 1)


def test_unfollowed_redirects_keep_their_address(spark):
    from seamark.operators import extract

    asked, fetched = "http://a.test/x", "seq int, " + extract.FETCHED
    df = spark.createDataFrame([(1, asked, asked, 301, {"Location": "http://a.test/z"}, "", None, [(asked, 301), ("http://a.test/y", 302)], 0.1, None), (2, asked, None, 302, {"location": "https://a.test/x"}, "", None, None, 0.1, None)], fetched)
    got = {r.seq: r for r in extract.audit_rows(df).collect()}
    assert (got[1].url, got[1].redirect_url, got[1].redirect_kind, got[1].redirect_status, got[1].redirect_hops) == (asked, "http://a.test/z", "other", 301, 2)
    assert [tuple(h) for h in got[1].redirect_chain] == [(asked, 301), ("http://a.test/y", 302), ("http://a.test/z", 0)] and "Redirect (2 hops)" in got[1].issues
    assert (got[2].redirect_kind, got[2].redirect_hops, [tuple(h) for h in got[2].redirect_chain]) == ("http_to_https", 1, [(asked, 302), ("https://a.test/x", 0)])


def test_audit_pipeline_has_every_row(spark, data):
    import __spark_entry__ as entry

    table = {r.page_id: r for r in spark.read.parquet(f"{data}/page_audit.parquet").collect()}
    got = {r.page_id: r for r in entry.queries()["audit_pipeline_full"](spark, data).collect()}
    assert got.keys() == table.keys() and {r.status_code for r in got.values()} > {200, 0}
    for i, r in got.items():
        t = table[i]
        assert r.url == t.url and r.status_code == t.status_code and (t.redirect_chain is None or not r.redirect_chain or [tuple(h) for h in r.redirect_chain] == [tuple(h) for h in t.redirect_chain])
        assert (f"HTTP {t.status_code} error" in r.issues) == ((t.status_code or 0) >= 400)
    moved = [i for i, t in table.items() if 300 <= (t.status_code or 0) < 400 and t.redirect_url]
    assert moved and all(got[i].redirect_url == table[i].redirect_url for i in moved)


def test_issue_rules_of_fetched_pages(spark):
    from seamark.operators import extract

    html = '<html><head><title>T</title></head><body><a href="12 Main Street, Springfield">x</a><a href="12 Main Street, Springfield">y</a>' + "".join(f'<img src="/{i}.jpg">' for i in range(7)) + "</body></html>"
    rows = [
        ("http://a.test/", 200, {"Content-Type": "text/html"}, html),
        ("http://a.test/f", 200, {"Content-Type": "Application/PDF; x=1"}, None),
        ("http://a.test/c", 403, {"CF-Mitigated": "challenge", "Content-Type": "text/html"}, "<title>Just a moment...</title>"),
        ("http://a.test/e", 404, None, None),
    ]
    fetched = spark.createDataFrame([(u, s, h, b) for u, s, h, b in rows], "url string, status_code int, headers map<string,string>, html string")
    for name, kind in (c.strip().split(" ", 1) for c in extract.FETCHED.split(", ") if " " in c.strip()):
        if name not in fetched.columns:
            fetched = fetched.withColumn(name, F.lit(None).cast(kind))
    rows = {r.url: r for r in extract.audit_rows(fetched).collect()}
    assert rows["http://a.test/"].speed_warnings == ["7 images missing width/height (layout shift risk)"]
    got = {u: list(r.issues) for u, r in rows.items()}
    assert got["http://a.test/"].count('Malformed link href (text, not a URL): "12 Main Street, Springfield"') == 1
    assert "7 imgs missing alt" in got["http://a.test/"]
    assert got["http://a.test/f"] == ["Non-HTML (application/pdf)"]
    assert got["http://a.test/c"][0].startswith("Bot challenge") and "HTTP 403 error" in got["http://a.test/c"]
    assert got["http://a.test/e"] == ["HTTP 404 error"]
