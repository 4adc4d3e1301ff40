"""The general problems on small tables with nulls, empty and long values, ties, copies and clashing columns, and against plain Python on the test data."""

import datetime as dt
import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seamark.operators import heavy_keys, nested, orphans, schema_drift, snapshots
from seamark.plans.ordered import in_order, ordered_scan
from seamark.plans.skew import hot_split_join, lookup_join, tree_aggregate

PAGE = "page_id long, crawl_id long, crawl_day date, url string, status_code int, canonical string, redirect_url string, word_count int, internal_link_urls array<struct<target:string,anchor:string,placement:string>>, n int, key string, _chunk int"


def pages(spark, rows):
    out = []
    for r in rows:
        r = {"page_id": None, "crawl_id": 1, "crawl_day": dt.date(2031, 1, 1), "url": None, "status_code": 200, "canonical": None, "redirect_url": None, "word_count": 1, "internal_link_urls": None, "n": 1, "key": "x", "_chunk": 3} | r
        r["internal_link_urls"] = None if r["internal_link_urls"] is None else [None if t is None else (t[0], "a", "main") for t in r["internal_link_urls"]]
        out.append(tuple(r.values()))
    return spark.createDataFrame(out, PAGE)


# ---- plans ----


def test_tree_aggregate_equals_group_by(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + [f"k{i}" for i in range(50)] + [None]), rng.randrange(100)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(37)
    got = tree_aggregate(df, ["k"], sums={"s": F.col("v"), "n": F.lit(1).cast("long")}, mins={"lo": F.col("v")}, maxs={"hi": F.col("v")}, fan_in=3)
    want = df.groupBy("k").agg(F.sum("v"), F.count("*"), F.min("v"), F.max("v"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert tree_aggregate(df.limit(0), ["k"], sums={"s": F.col("v")}).count() == 0


def test_tree_has_rounds(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(40)
    plan = tree_aggregate(df, ["k"], sums={"s": F.col("v")}, fan_in=4)._jdf.queryExecution().toString()
    assert plan.count("_chunk") >= 3


def test_hot_split_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [("a", 1), ("b", 2), ("z", 9)], "k string, v int")
    res = spark.createDataFrame([("hot", 300, "H"), ("a", 1, "A"), ("b", 1, None)], "k string, n long, x string")
    for rows in (10, 10_000):
        got = hot_split_join(big, res, ["k"], "n", hot_rows=rows)
        assert got.select("k", "v", "n", "x").groupBy("k", "x").count().orderBy("k").collect() == [("a", "A", 1), ("b", None, 1), ("hot", "H", 300)]


@pytest.mark.parametrize("rows", [0, 100])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join(spark, rows, how):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, v int")
    small = spark.createDataFrame([("a", 1), ("c", 2)], "k string, w int")
    got, want = lookup_join(big, small, ["k"], how, rows=rows), big.join(small, ["k"], how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_ordered_scan_crosses_partitions(spark):
    rows = [("g", i, i % 7) for i in range(500)] + [("h", i, 1) for i in range(20)]
    df = in_order(spark.createDataFrame(rows, "g string, i int, v int"), "g", "i")
    got = ordered_scan(df, "g", lambda s, r: ((s or 0) + r[2], [(r[0], r[1], (s or 0) + r[2])]), "g string, i int, total int").collect()
    run, want = defaultdict(int), {}
    for g, i, v in sorted(rows):
        run[g] += v
        want[g, i] = run[g]
    assert {(r.g, r.i): r.total for r in got} == want


# ---- p1 ----


#: What the names in the test data mean; the operator has to find it out.
CONCEPT_OF = {
    name: concept
    for concept, names in {
        "who": ("saved_by", "savedBy", "user_ip", "ip", "client_addr"), "pages": ("pages", "urls", "n_pages", "page_count", "pagesTotal"), "name": ("name", "title", "crawl_name"),
        "when": ("saved_at", "savedAt", "ts"), "seed": ("seed", "start_url", "seedUrl"), "version": ("tool_version", "version"), "retention": ("retention_days", "keep_days"),
    }.items()
    for name in names
}


def brute_changes(files):
    """Files in order, field by field; independent of trees and scans."""
    kind = lambda v: None if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
    out, prev, last = set(), None, {}
    for name, o in files:
        if prev is None:
            prev, last = o, {k: kind(v) for k, v in o.items()}
            continue
        came = {}
        for a in sorted(set(prev) - set(o)):
            for b in sorted(set(o) - set(prev)):
                c = CONCEPT_OF.get(a)
                ta = last[a] if prev[a] is None else kind(prev[a])
                if b not in came and c and c == CONCEPT_OF.get(b) and (ta is None or o[b] is None or ta == kind(o[b])):
                    came[b] = a
                    break
        out |= {(name, "renamed", a, b) for b, a in came.items()}
        out |= {(name, "removed", a, "") for a in set(prev) - set(o) - set(came.values())}
        out |= {(name, "added", "", b) for b in set(o) - set(prev) - set(came)}
        now = {}
        for k, v in o.items():
            before = last.get(came.get(k, k)) if k in came or k in prev else None
            if k in prev and v is not None and before and kind(v) != before:
                out.add((name, "retyped", k, k))
            now[k] = kind(v) or before
        prev, last = o, now
    return out


def crawls(spark, rows):
    return spark.createDataFrame([(f, n, d, 1) for f, n, d in rows], "folder string, file_name string, doc string, tree int")


def changes(df):
    return {(r.folder, r.file_name, r.change_kind, r.old_field, r.new_field) for r in schema_drift.schema_changes(df).filter("NOT nested").collect()}


def test_drift_small(spark):
    j = json.dumps
    rows = [
        ("f", "100_a.json", j({"saved_by": "1.2.3.4", "pages": 3, "x": None})),
        ("f", "100_a.json", j({"saved_by": "1.2.3.4", "pages": 3, "x": None})),  # a copy
        ("f", "101_b.json", '{"pages": 3'),  # invalid: counts for nothing
        ("f", "99_first.json", j({"pages": 1})),
        ("f", "102_c.json", j({"user_ip": "1.2.3.4", "pages": None, "x": "s", "meta": {"a": 1}})),
        ("f", "103_d.json", j({"user_ip": "1.2.3.4", "pages": "3", "x": 1, "meta": {"b": 1}})),
        ("f", "104_e.json", j({"pages": [3], "n_pages": 4, "NaN": 1})),
        ("g", "1_x.json", j({"a": 1})),
        ("g", "2_x.json", "NaN"),
        ("g", "3_x.json", ""),
        ("g", "4_x.json", None),
        (None, None, j({"a": 1})),
    ]
    got = changes(crawls(spark, rows))
    assert got == {
        ("f", "100_a.json", "added", "", "saved_by"), ("f", "100_a.json", "added", "", "x"),
        ("f", "102_c.json", "renamed", "saved_by", "user_ip"), ("f", "102_c.json", "added", "", "meta"),
        ("f", "103_d.json", "retyped", "pages", "pages"), ("f", "103_d.json", "retyped", "x", "x"),
        ("f", "104_e.json", "removed", "user_ip", ""), ("f", "104_e.json", "removed", "x", ""), ("f", "104_e.json", "removed", "meta", ""), ("f", "104_e.json", "added", "", "n_pages"),
        ("f", "104_e.json", "added", "", "NaN"), ("f", "104_e.json", "retyped", "pages", "pages"),
    }
    assert changes(crawls(spark, rows).limit(0)) == set()
    nested_ones = schema_drift.schema_changes(crawls(spark, rows)).filter("nested").collect()
    assert {(r.change_kind, r.old_field, r.new_field) for r in nested_ones} == {("removed", "meta.a", ""), ("added", "", "meta.b"), ("added", "", "pages.[]")}


def test_drift_one_hot_folder_against_brute_force(spark):
    rng, rows, files = random.Random(7), [], []
    names = {"who": ["saved_by", "user_ip", "ip"], "pages": ["pages", "n_pages"], "x": ["tags"], "y": ["notes"]}
    doc = {"saved_by": "10.0.0.1", "pages": 5}
    for i in range(400):
        for concept, alt in names.items():
            have = [k for k in doc if k in alt]
            roll = rng.random()
            if roll < 0.1:
                for k in have:
                    v = doc.pop(k)
                    if roll < 0.06:
                        doc[rng.choice(alt)] = v
            elif roll < 0.2 and not have:
                doc[rng.choice(alt)] = {"who": "10.0.0.2", "pages": 7}.get(concept, "t")
            elif roll < 0.3 and have:
                doc[have[0]] = rng.choice([None, 3, "3", [3], {"k": 3}])
        name = f"{1000 + i}_z.json"
        rows.append(("hot", name, json.dumps(doc)))
        files.append((name, dict(doc)))
    rng.shuffle(rows)
    assert changes(crawls(spark, rows)) == {("hot", *c) for c in brute_changes(files)}


def test_drift_on_data(spark, data):
    df = spark.read.parquet(f"{data}/saved_crawls.parquet")
    folders = defaultdict(dict)
    for r in df.select("folder", "file_name", "doc").distinct().collect():
        try:
            o = json.loads(r.doc)
        except ValueError:
            continue
        if isinstance(o, dict):
            folders[r.folder][int(re.match(r"\d+", r.file_name).group()), r.file_name] = o
    want = {(f, *c) for f, files in folders.items() for c in brute_changes([(n, o) for (_, n), o in sorted(files.items())])}
    assert changes(df) == want


def test_assignment_is_minimal():
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(40):
        n, m = rng.randint(1, 4), rng.randint(4, 6)
        cost = [[rng.choice([1.0, 2.0, 5.0, 1e9]) for _ in range(m)] for _ in range(n)]
        got = schema_drift.assign(cost)
        assert len(set(got)) == n
        assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_moves():
    t = schema_drift.schema_tree
    a, b = t({"p": {"k": 1, "q": "x"}, "r": {}}), t({"p": {"q": "x"}, "r": {"k": 1}})
    s = schema_drift.SEP
    assert schema_drift.tree_edit(a, b) == (schema_drift.MOVE, [("moved", f"p{s}k", f"r{s}k")])
    assert schema_drift.tree_edit(a, a) == (0.0, [])
    wrapped = schema_drift.tree_edit(t({"seed": "https://a.test/"}), t({"seed": {"url": "https://a.test/", "depth": 0}}))[1]
    assert sorted(wrapped) == [("added", "", f"seed{s}depth"), ("moved", "seed", f"seed{s}url"), ("retyped", "seed", "seed")]


def test_schema_of_a_list_is_the_union_of_its_elements():
    t = schema_drift.schema_tree
    assert t([None, {"a": 1}, {"b": "x"}, 3])["c"]["[]"] == {"t": "number|object", "k": "count", "c": {"a": t(1), "b": t("x")}}
    assert schema_drift.tree_edit(t({"l": [{"a": 1}, {"a": 1}]}), t({"l": [{"a": 1}, {"a": 1, "b": 2}]}))[1] == [("added", "", schema_drift.SEP.join(("l", "[]", "b")))]


def test_fields_that_cross_the_top_level(spark):
    rows = [("f", "1", '{"meta": {"seed": "x"}, "name": "n"}'), ("f", "2", '{"meta": {}, "seed": "x", "name": "n"}'), ("f", "3", '{"meta": {"seed": "x"}, "name": "n"}')]
    got = {(r.file_name, r.change_kind, r.old_field, r.new_field) for r in schema_drift.field_changes(crawls(spark, rows)).collect()}
    assert got == {("2", "added", "", "seed"), ("3", "removed", "seed", "")}
    every = {(r.file_name, r.change_kind, r.old_field, r.new_field) for r in schema_drift.schema_changes(crawls(spark, rows)).collect()}
    assert every == {("2", "moved", "meta.seed", "seed"), ("3", "moved", "seed", "meta.seed")}


def test_very_deep_documents_are_invalid(spark):
    deep = lambda n: '{"a": ' * n + "1" + "}" * n
    rows = [("f", "1", '{"a": 1}'), ("f", "2", deep(300)), ("f", "3", deep(5000)), ("f", "4", "{}")]
    assert changes(crawls(spark, rows)) == {("f", "2", "retyped", "a", "a"), ("f", "4", "removed", "a", "")}


def test_consistent_table(spark):
    j = json.dumps
    rows = [
        ("A", "1", j({"ip": "10.0.0.1", "pages": 3, "seed": "https://a.test/", "t": ["x", 1], "js": True, "copies": 7})),
        ("A", "2", j({"user_ip": "10.0.0.2", "pages": "1,003", "seed": {"url": "https://a.test/", "depth": 2}, "t": "x", "js": "no"})),
        ("A", "2", '{"broken copy"'),
        ("B", "1", j({"ip": "10.0.0.3", "user_ip": "10.0.0.4", "pages": 7, "js": "perhaps"})),
        ("B", "2", '{"pages"'),
        ("B", "3", j({"ip": None, "pages": 2**70, "deep": {"a": {"b": [{"c": 1}]}}})),
    ]
    got = {(r.folder, r.file_name): r for r in schema_drift.consistent_table(crawls(spark, rows)).collect()}
    assert len(got) == 5 and got["A", "2"].copies == 2 and got["A", "2"].valid and not got["B", "2"].valid
    assert [got[k].ip for k in [("A", "1"), ("A", "2"), ("B", "1")]] == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]
    assert got["B", "1"].user_ip == "10.0.0.4"  # a file that holds both loses neither
    assert [got[k].pages for k in [("A", "1"), ("A", "2"), ("B", "3")]] == [3.0, 1003.0, float(2**70)]
    assert got["A", "1"].seed == got["A", "2"].seed == "https://a.test/" and got["A", "2"].seed__depth == 2
    assert got["A", "1"].t__list == ["x", "1"] and got["A", "2"].t == "x"
    assert [got[k].js for k in [("A", "1"), ("A", "2"), ("B", "1")]] == [True, False, None] and got["B", "1"].js__text == "perhaps"
    assert got["A", "1"].copies_ == 7 and json.loads(got["B", "3"].deep__a__b__list[0]) == {"c": 1}
    assert schema_drift.consistent_table(crawls(spark, rows).limit(0)).columns == ["folder", "file_name", "copies", "valid"]


def test_change_report_counts_exactly(spark):
    rows = [(f"f{i}", f"{j}", "added", "", "x", False) for i in range(3000) for j in range(1 + (i < 10))]
    got = schema_drift.change_report(spark.createDataFrame(rows, schema_drift.CHANGE_SCHEMA)).collect()
    assert [(r.files, r.folders) for r in got] == [(3010, 3000)]


# ---- p2 ----


def test_hot_keys_edges(spark):
    rows = [{"page_id": i, "url": "http://a.test/", "internal_link_urls": [("http://a.test/x",), (None,), None, ("HTTPS://WWW.a.test/x/",)]} for i in range(10)]
    df = pages(spark, [*rows, {"page_id": 99, "url": None, "internal_link_urls": []}])
    got = {tuple(r) for r in heavy_keys.hot_keys(df).collect()}
    assert got == {("site", "a.test"), ("site", ""), ("target", "a.test/x"), ("target", "")}
    t = {r.target_key: r.entries for r in heavy_keys.target_figures(df).collect()}
    assert t == {"a.test/x": 20, "": 10}
    assert heavy_keys.hot_keys(df.limit(0)).count() == 0


# ---- p4 ----

SNAP = "site string, snap_no int, delivered_at timestamp, url string, status_code int, title string, canonical string, idx int, state string"


def snap(spark, rows):
    at = dt.datetime(2031, 1, 1)
    return spark.createDataFrame([(s, n, None if d is None else at + dt.timedelta(hours=d), u, c, t, k, 1, "x") for s, n, d, u, c, t, k in rows], SNAP)


def test_snapshot_changes(spark):
    a, b, c = "http://s.test/a", "http://s.test/b", "http://s.test/c"
    rows = [
        ("s", 1, 1, a, 200, "A", None), ("s", 1, 1, b, 200, "B", ""), ("s", 1, 1, b, 200, "B", ""),
        ("s", 3, 1, "HTTPS://www.s.test/a/", 200, " A ", "/x"), ("s", 3, 2, a, 200, " A\t ", None), ("s", 3, None, a, 500, "old", None), ("s", 3, 1, c, None, None, None),
        ("s", 4, 1, a, 404, "A", None), ("s", 4, 1, b, 200, "B", None),
        ("t", 7, 1, a, 200, "A", None), (None, 1, 1, a, 200, "A", None), ("s", None, 1, a, 200, "A", None),
    ]
    got = {(r.site, r.snap_no, r.page_key, r.change_kind) for r in snapshots.snapshot_changes(snap(spark, rows)).collect()}
    assert got == {("s", 3, "s.test/b", "removed"), ("s", 3, "s.test/c", "added"), ("s", 4, "s.test/a", "changed"), ("s", 4, "s.test/b", "added"), ("s", 4, "s.test/c", "removed")}
    assert snapshots.snapshot_changes(snap(spark, rows).limit(0)).count() == 0


def test_snapshot_ties_do_not_depend_on_order(spark):
    rows = [("s", 1, 1, "http://s.test/a", c, str(c), None) for c in (200, 301, 404)] + [("s", 2, 1, "http://s.test/a", 200, "200", None)]
    both = [sorted(map(tuple, snapshots.snapshot_changes(snap(spark, r)).collect())) for r in (rows, rows[::-1])]
    assert both[0] == both[1]


# ---- p5 ----


def rec(spark, rows):
    at = dt.datetime(2031, 1, 1)
    return spark.createDataFrame([(i, at + dt.timedelta(hours=h), p, "z", 1) for i, h, p in rows], "rec_id long, loaded_at timestamp, payload string, node_type string, pre int")


def children(df):
    return {tuple(r) for r in nested.page_children(df).collect()}


def test_nested_shapes(spark):
    big = 2**60 + 1
    one = {"results": {"url": "u", "redirect_chain": {"url": "x"}, "og_tags": [{"property": "og:type", "content": "a"}, {"property": "og:x"}, None], "perf": json.dumps({"warnings": "w", "third_party_hosts": ["h", None, "i"]})}}
    two = {"results": json.dumps([None, {"url": "v", "hreflang": json.dumps([{"lang": "a"}, None, {"lang": "b"}]), "og_tags": {"og:image:alt": "", "title": "t"}, "redirect_chain": ["r", {"url": "q"}], "perf": 5}])}
    rows = [(big, 0, json.dumps(one)), (big, 0, json.dumps(one)), (2, 1, json.dumps(two)), (2, 0, "{}"), (3, 0, '{"results": [{"a"'), (4, 0, None), (5, 0, ""), (6, 0, "[1]"), (7, 0, '{"results": null}'), (8, 0, "[" * 100_000), (None, 0, '{"results": [1]}')]
    assert children(rec(spark, rows)) == {
        (big, 0, "results", "0"), (big, 0, "redirect_chain", "0"), (big, 0, "og_tags", "type"), (big, 0, "warnings", "0"), (big, 0, "third_party_hosts", "0"), (big, 0, "third_party_hosts", "2"),
        (2, 1, "results", "1"), (2, 1, "hreflang", "0"), (2, 1, "hreflang", "2"), (2, 1, "og_tags", "image:alt"), (2, 1, "og_tags", "title"), (2, 1, "redirect_chain", "0"), (2, 1, "redirect_chain", "1"),
        (None, 0, "results", "0"),
    }
    assert children(rec(spark, rows).limit(0)) == set()


NESTED = {
    "name": "n", "extra": {"a": [{"b": 1}, None, {"b": [2, [3]]}], "e": {}},
    "results": [{"url": "u", "status_code": 200, "perf": {"score": 3, "deep": {"x": True}, "warnings": ["w"]}, "redirect_chain": ["x", {"url": "y", "status": 301, "headers": {"h": "1"}}], "og_tags": {"a": "b"}}, {"hreflang": [3], "title": None}],
}


def test_intervals_nest():
    rows = nested.label_nodes("1", json.dumps(NESTED))
    marks = sorted(x for r in rows for x in r[1:3])
    assert marks == list(range(2 * len(rows)))
    for r in rows:
        around = [p for p in rows if p[1] < r[1] and r[2] < p[2]]
        assert sorted(p[3] for p in around) == list(range(r[3]))  # one ancestor a level
    kinds = {(r[4], r[5], r[6]) for r in rows}
    assert {("results.perf", "perf", None), ("results.perf.score", "score", "3"), ("results.perf.deep.x", "x", "true"), ("redirect_chain.headers.h", "h", "1"), ("record.extra.a", "2", None), ("record.extra.a.b", "0", "2"), ("record.extra.a.b[]", "0", "3"), ("record.extra.e", "e", None)} <= kinds
    assert nested.label_nodes("1", json.dumps(NESTED), ("hreflang",)) == [r for r in rows if r[4] == "hreflang"]


def test_parents_by_containment(spark):
    nodes = nested.node_table(rec(spark, [(1, 0, json.dumps(NESTED)), (2, 0, json.dumps(NESTED)), (3, 0, '{"a": ' * 900 + "1" + "}" * 900)])).cache()
    rows = nodes.collect()
    by = {r.rec_id: [x for x in rows if x.rec_id == r.rec_id] for r in rows}
    want = {(r.rec_id, r.pre): max((p.pre for p in by[r.rec_id] if p.pre < r.pre and r.post < p.post), default=None) for r in rows}
    assert {(r.rec_id, r.pre): r.parent_pre for r in nested.with_parents(nodes).collect()} == want
    tables = nested.type_tables(nodes.filter("rec_id < 3"))
    assert [(r.rec_id, r.item_name, r.value) for r in tables["results.perf.score"].orderBy("rec_id").collect()] == [(1, "score", "3"), (2, "score", "3")]
    assert nested.with_parents(nodes.limit(0)).count() == 0 and nested.type_tables(nodes.limit(0)) == {}


def test_flat_tables(spark):
    t = nested.flat_tables(nested.node_table(rec(spark, [(1, 0, json.dumps(NESTED))])))
    assert t["records"].select("rec_id", "name", "saved_at").collect() == [(1, "n", None)]
    assert t["pages"].select("page_pos", "url", "status_code").orderBy("page_pos").collect() == [(0, "u", 200), (1, None, None)]
    assert t["perf"].select("page_pos", "score", "load_time_s").collect() == [(0, 3.0, None)]
    assert t["redirect_chain"].select("page_pos", "pos", "url", "status", "value").orderBy("pos").collect() == [(0, 0, None, None, "x"), (0, 1, "y", 301, None)]
    assert t["og_tags"].select("page_pos", "property", "value").collect() == [(0, "a", "b")]
    assert t["hreflang"].select("page_pos", "pos", "href", "value").collect() == [(1, 0, None, "3")]
    page = t["pages"].filter("page_pos = 0").first()
    for name in ("perf", "redirect_chain", "og_tags", "warnings"):
        assert all(page.pre < r.pre and r.post < page.post and (r.page_pre, r.page_post) == (page.pre, page.post) for r in t[name].collect())
    assert t["third_party_hosts"].count() == 0


# ---- p6 ----


def test_orphans(spark):
    d = lambda n: dt.date(2031, 1, n)
    u = lambda p: f"http://s.test/{p}"
    rows = [
        {"page_id": 1, "crawl_day": d(2), "url": u("a"), "canonical": u("gone"), "redirect_url": u("late"), "internal_link_urls": [(u("missing"),), (u("MISSING/"),), ("http://else.test/x",), (None,), None, (u("a"),)]},
        {"page_id": 2, "crawl_day": d(1), "url": u("gone"), "status_code": 200},
        {"page_id": 3, "crawl_day": d(2), "url": u("gone"), "status_code": 410},
        {"page_id": 4, "crawl_day": d(3), "url": u("gone"), "status_code": 200},
        {"page_id": 5, "crawl_day": d(3), "url": u("late")},
        {"page_id": 6, "crawl_day": d(2), "url": u("b"), "canonical": "/a", "redirect_url": ""},
        {"page_id": 7, "crawl_day": d(2), "url": u("c"), "redirect_url": u("b")},
        {"page_id": 8, "crawl_day": None, "url": u("d"), "canonical": u("a"), "status_code": None},
        {"page_id": 9, "crawl_day": d(2), "url": None, "canonical": " "},
    ]
    got = {(r.page_id, r.ref_field, r.target_key, r.orphan_kind, r.level) for r in orphans.orphan_cascade(pages(spark, rows)).collect()}
    assert got == {
        (1, "canonical", "s.test/gone", "deleted", 0), (1, "redirect_url", "s.test/late", "late", 0), (1, "internal_link_urls", "s.test/missing", "missing", 0),
        (8, "canonical", "s.test/a", "late", 0), (6, "canonical", "s.test/a", "inherited", 1), (7, "redirect_url", "s.test/b", "inherited", 2),
    }
    direct = {(r.page_id, r.ref_field) for r in orphans.Cascade(pages(spark, rows)).orphans(direct_only=True).collect()}
    assert direct == {(p, f) for p, f, _, _, level in got if level == 0}
    assert orphans.orphan_cascade(pages(spark, rows).limit(0)).count() == 0
    assert orphans.Cascade(pages(spark, rows).limit(0)).report().count() == 0


def test_orphan_cycle_ends(spark):
    u = lambda p: f"http://s.test/{p}"
    rows = [{"page_id": 1, "url": u("a"), "canonical": u("b"), "redirect_url": u("none")}, {"page_id": 2, "url": u("b"), "canonical": u("a")}]
    got = {(r.page_id, r.ref_field, r.level) for r in orphans.orphan_cascade(pages(spark, rows)).collect()}
    assert got == {(1, "redirect_url", 0), (1, "canonical", 2), (2, "canonical", 1)}


def test_orphan_report(spark):
    rows = [{"page_id": i, "url": f"http://s.test/{i}", "canonical": "http://s.test/none"} for i in range(3)]
    got = orphans.Cascade(pages(spark, rows)).report().collect()
    assert [(r.ref_field, r.month, r.orphan_kind, r.refs, r.targets) for r in got] == [("canonical", "2031-01", "missing", 3, 1)]


def test_orphan_cascade_over_all_fields_and_crawls(spark):
    d, u = (lambda n: dt.date(2031, 1, n)), (lambda p: f"http://s.test/{p}")
    rows = [
        {"page_id": 1, "url": u("a"), "crawl_day": d(1), "canonical": u("b"), "redirect_url": u("none"), "internal_link_urls": [(u("a"),)]},
        {"page_id": 2, "url": u("b"), "crawl_day": d(1), "canonical": u("a"), "internal_link_urls": [(u("A/"),), (u("fine"),)]},
        {"page_id": 3, "url": u("c"), "crawl_day": d(1), "internal_link_urls": [(u("b"),)]},
        {"page_id": 4, "url": u("e"), "crawl_day": d(2), "crawl_id": 2, "canonical": u("c")},
        {"page_id": 5, "url": u("fine"), "crawl_day": d(1)},
        {"page_id": 6, "url": u("b"), "crawl_day": d(3), "crawl_id": 3},
        {"page_id": 7, "url": u("f"), "crawl_day": d(3), "crawl_id": 3, "canonical": u("b")},
        {"page_id": 8, "url": u("g"), "crawl_day": None, "internal_link_urls": [(u("h"),)]},
        {"page_id": 9, "url": u("h"), "crawl_day": None, "internal_link_urls": [(u("none"),)]},
    ]
    got = {(r.page_id, r.ref_field, r.target_key, r.orphan_kind, r.level) for r in orphans.orphan_cascade(pages(spark, rows)).collect()}
    assert got == {
        (1, "redirect_url", "s.test/none", "missing", 0), (1, "canonical", "s.test/b", "inherited", 2), (2, "canonical", "s.test/a", "inherited", 1), (2, "internal_link_urls", "s.test/a", "inherited", 1),
        (3, "internal_link_urls", "s.test/b", "inherited", 2), (4, "canonical", "s.test/c", "inherited", 3), (8, "internal_link_urls", "s.test/h", "inherited", 1), (9, "internal_link_urls", "s.test/none", "missing", 0),
    }
    assert orphans.orphan_cascade(pages(spark, rows).limit(0)).count() == 0


def test_every_reference_to_an_orphan_is_reported(spark):
    u = lambda p: f"http://s.test/{p}"
    rows = [
        {"page_id": 1, "url": u(1), "canonical": u("none")},
        {"page_id": 2, "url": u(2), "canonical": u(1)},
        {"page_id": 3, "url": u(3), "canonical": u(1), "redirect_url": u(2)},
        {"page_id": 4, "url": u(4), "canonical": u("none"), "redirect_url": u(1)},
    ]
    got = {(r.page_id, r.ref_field, r.orphan_kind, r.level) for r in orphans.orphan_cascade(pages(spark, rows)).collect()}
    assert got == {(1, "canonical", "missing", 0), (2, "canonical", "inherited", 1), (3, "canonical", "inherited", 1), (3, "redirect_url", "inherited", 2), (4, "canonical", "missing", 0), (4, "redirect_url", "inherited", 1)}


def test_orphan_cascade_against_plain_loop(spark):
    rng = random.Random(8)
    url = lambda: f"http://s.test/{rng.randrange(60)}"
    some = lambda: url() if rng.random() < 0.15 else None
    rows = [{"page_id": i, "url": url(), "crawl_day": dt.date(2031, 1, rng.randint(1, 4)), "canonical": some(), "redirect_url": some(), "internal_link_urls": [(url(),)] if rng.random() < 0.3 else []} for i in range(80)]
    days = defaultdict(set)
    for r in rows:
        days[r["url"]].add(r["crawl_day"])
    refs = [(r, f, t) for r in rows for f, t in [("canonical", r["canonical"]), ("redirect_url", r["redirect_url"]), *(("internal_link_urls", t) for (t,) in r["internal_link_urls"])] if t]
    record = lambda r, t: (t, max((x for x in days[t] if x <= r["crawl_day"]), default=None))
    level, n = {(r["url"], r["crawl_day"]): 0 for r, _, t in refs if record(r, t)[1] is None}, 0
    while True:
        new = {(r["url"], r["crawl_day"]) for r, _, t in refs if level.get(record(r, t)) == n} - level.keys()
        if not new:
            break
        n += 1
        level |= dict.fromkeys(new, n)
    want = {(r["page_id"], f, 0 if record(r, t)[1] is None else level[record(r, t)] + 1) for r, f, t in refs if record(r, t)[1] is None or (record(r, t) in level and t != r["url"])}
    assert {(r.page_id, r.ref_field, r.level) for r in orphans.orphan_cascade(pages(spark, rows)).collect()} == want and n > 1
