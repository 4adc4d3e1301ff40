"""Schemas that drift between files: edit scripts, their compilation, one consistent table (problem 1)."""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.plans.ordered import in_order, ordered_scan
from seamark.session import cut, spread

#: Costs of an edit of one node. A rename or a move must cost less than a removal and an addition to be chosen.
ADD, DELETE, RENAME, RETYPE, MOVE = 1.0, 1.0, 0.6, 0.5, 0.8
NEVER = 1e9
#: What a rename at top level is preferred by in the assignment: there, a field that goes and one that comes with the same information are one field.
TOP = 1e4
#: Between the steps of a path inside scripts; no field name holds it.
SEP = "\x1f"
#: Most distinct field names whose values are profiled, and most columns of the consistent table.
MAX_NAMES = 10_000
#: Deepest nesting that is read, as in Spark's own JSON reader; deeper documents count as invalid.
MAX_DEPTH = 1_000
#: Hash buckets of a field's values; least cosine of two value profiles; least values of a profile; most files that hold both names, as a share of how many would by chance.
BUCKETS, ALIKE, LEAST_VALUES, TOGETHER = 1024, 0.5, 2, 0.5
#: Kinds of value that tell what a field is about, whatever it is called.
TELLING = ("ip", "url", "time", "version")

_KINDS = (
    ("ip", re.compile(r"(?:\d{1,3}\.){3}\d{1,3}|[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}", re.I)),
    ("url", re.compile(r"(?:https?:)?//\S+", re.I)),
    ("time", re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*")),
    ("version", re.compile(r"v?\d+\.\d+(?:\.\d+)*")),
)
CHANGE_SCHEMA = "folder string, file_name string, change_kind string, old_field string, new_field string, nested boolean"

#: Cosine-alike pairs of top-level names, either way round and of a profiled name with itself, with the JSON types for which they are ("*": all types taken together).
Alike = dict[tuple[str, str], set[str]]


# ---- schema trees: {"t": JSON type, "k": kind of a leaf, "c": {member: tree}} ----


def _leaf_kind(v) -> str:
    if isinstance(v, str):
        return next((k for k, p in _KINDS if p.fullmatch(v.strip())), "text")
    return "time" if 1e9 <= v < 1e11 else "count"


def union(a: dict, b: dict) -> dict:
    """Schema of what is either ``a`` or ``b``: all types and all members of both. A null adds nothing."""
    if a["t"] == "null" or b["t"] == "null":
        return b if a["t"] == "null" else a
    out: dict = {"t": "|".join(sorted({*a["t"].split("|"), *b["t"].split("|")}))}
    kinds = {x["k"] for x in (a, b) if "k" in x}
    if kinds:
        out["k"] = kinds.pop() if len(kinds) == 1 else "mixed"
    members: dict = {}
    for part in (a, b):
        for name, sub in part.get("c", {}).items():
            members[name] = union(members[name], sub) if name in members else sub
    if members:
        out["c"] = members
    return out


def schema_tree(v, depth: int = 0) -> dict:
    """Schema of a JSON value. A list has one child ``[]``, the union over all of its elements."""
    if depth > MAX_DEPTH:
        raise ValueError("nested too deeply")
    if v is None:
        return {"t": "null"}
    if isinstance(v, bool):
        return {"t": "boolean"}
    if isinstance(v, (int, float)):
        return {"t": "number", "k": _leaf_kind(v)}
    if isinstance(v, str):
        return {"t": "string", "k": _leaf_kind(v)}
    members: dict = {}
    if isinstance(v, dict):
        for name, x in v.items():
            members[name] = schema_tree(x, depth + 1)
        return {"t": "object", "c": members}
    for x in v:
        if x is not None:
            own = schema_tree(x, depth + 1)
            members["[]"] = union(members["[]"], own) if members else own
    return {"t": "array", "c": members}


def _reject(name: str):
    raise ValueError(name)


def parse_document(doc: str | None) -> dict | None:
    """The JSON object a document holds; None for any other document."""
    try:
        v = json.loads(doc, parse_constant=_reject) if doc else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def parse_schema(doc: str | None) -> str | None:
    """Schema tree, as JSON, of a document that is a JSON object; null for any other."""
    v = parse_document(doc)
    try:
        return None if v is None else json.dumps(schema_tree(v))
    except (ValueError, RecursionError):
        return None


def nodes_of(tree: dict) -> int:
    n, todo = 0, [tree]
    while todo:
        t = todo.pop()
        n += 1
        todo += t.get("c", {}).values()
    return n


def value_features(v, at: str = "") -> Iterator[str]:
    """What a value looks like: kinds that tell enough, else the words of a text and the magnitude of a number, with the path they stand at.

    Booleans and nulls look like nothing. Digits in words lose their value.
    """
    if v is None or isinstance(v, bool):
        return
    if isinstance(v, dict):
        for name, x in v.items():
            yield f"{at}.{name}"
            yield from value_features(x, f"{at}.{name}")
    elif isinstance(v, list):
        for x in v:
            yield from value_features(x, f"{at}[]")
    elif _leaf_kind(v) in TELLING:
        yield f"{at}={_leaf_kind(v)}"
    elif isinstance(v, str):
        words = re.findall(r"\w+", re.sub(r"\d+", "0", v.lower()))
        for w in words:
            if w != "0" or set(words) == {"0"}:
                yield f"{at}={w}"
    else:
        yield f"{at}#{len(f'{abs(v):.0f}') if abs(v) > 1e300 else int(abs(v)).bit_length()}"


def _words(name: str) -> set[str]:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    return {w.rstrip("s") for w in re.split(r"[^a-z0-9]+", parts) if w and w not in ("n", "num", "total", "count", "the", "of")}


def telling(tree: dict, at: str = "") -> set[tuple[str, str]]:
    """Paths and kinds of the leaves below a node whose kind tells what they are about."""
    out = {(at, tree["k"])} if tree.get("k") in TELLING else set()
    for name, sub in tree.get("c", {}).items():
        out |= telling(sub, at + SEP + name)
    return out


def same_information(old: str, a: dict, new: str, b: dict, alike: Alike | None = None) -> bool:
    """Whether two differently named members carry the same information: by the words in their names together with
    the kind of value, by kinds of value that tell enough, or by the values all files hold under either name (``alike``)."""
    ka, kb = a.get("k"), b.get("k")
    ta = telling(a)
    if ta and ta == telling(b):
        return True
    wa, wb = _words(old), _words(new)
    if wa & wb and (wa <= wb or wb <= wa):
        # nulls, objects and lists have no kind: what all files hold under the names may speak against it
        apart = alike is not None and (old, old) in alike and (new, new) in alike and (old, new) not in alike
        if not apart if "null" in (a["t"], b["t"]) or ka is None else ka == kb:
            return True
    shared = alike.get((old, new)) if alike else None
    if not shared:
        return False
    known = {t for t in (a["t"], b["t"]) if t != "null"}
    return known <= shared if known else True


def rename_cost(old: str, a: dict, new: str, b: dict, alike: Alike | None = None) -> float:
    """Cost of renaming member ``old`` to ``new``; NEVER unless JSON types agree and the information is the same.

    A member whose type was never known agrees with any.
    """
    if "null" not in (a["t"], b["t"]) and a["t"] != b["t"] or not same_information(old, a, new, b, alike):
        return NEVER
    return RENAME + 0.01 * (a["t"] == "null" or b["t"] == "null")


def assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost assignment (Hungarian method) of rows to columns of a matrix with no more rows than columns: the column of each row."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while p[j0]:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < low[j]:
                        low[j], way[j] = cur, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def _components(saving: dict[tuple[int, int], float]) -> Iterator[tuple[list[int], list[int]]]:
    """Rows and columns that may be matched with each other, directly or over others."""
    by_row: dict[int, list[int]] = {}
    by_col: dict[int, list[int]] = {}
    for i, j in saving:
        by_row.setdefault(i, []).append(j)
        by_col.setdefault(j, []).append(i)
    seen: set[int] = set()
    for start in by_row:
        if start in seen:
            continue
        rows, cols, todo = {start}, set(), [start]
        while todo:
            for j in by_row[todo.pop()]:
                if j not in cols:
                    cols.add(j)
                    new = set(by_col[j]) - rows
                    rows |= new
                    todo += new
        seen |= rows
        yield sorted(rows), sorted(cols)


Edit = tuple[str, str, str]


def tree_edit(a: dict, b: dict, alike: Alike | None = None, path: str = "") -> tuple[float, list[Edit]]:
    """Minimum cost and script that turn schema tree ``a`` into ``b``: edits ``(kind, old path, new path)`` with kind
    added, removed, renamed, moved or retyped.

    Trees are unordered and the distance is constrained: members of the same name and parent are always
    matched. Everything else that goes or comes, wherever in the trees, is matched by one minimum-cost
    assignment over renames (same parent), moves (another parent, with or without a new name), removals and additions;
    renames at top level come first. A node that is null says nothing about its type or members.
    """
    gone: list[tuple[str, str, dict]] = []
    come: list[tuple[str, str, dict]] = []
    total, script = 0.0, []

    def align(x: dict, y: dict, at: str) -> None:
        nonlocal total
        if "null" in (x["t"], y["t"]):
            return
        if x["t"] != y["t"] and at:
            total += RETYPE
            script.append(("retyped", at, at))
            # a value that its own new object holds, or the other way round, is a move
            if "object" in (x["t"], y["t"]) and ("k" in x or "k" in y):
                leaf, holder, way = (x, y, "in") if "k" in x else (y, x, "out")
                inner = [n for n, s in holder.get("c", {}).items() if s["t"] == leaf["t"] and s.get("k") == leaf["k"]]
                if len(inner) == 1 or leaf["k"] == "count" and inner:
                    total += MOVE - (ADD if way == "in" else DELETE)
                    one = inner[0]
                    script.append(("moved", at, f"{at}{SEP}{one}") if way == "in" else ("moved", f"{at}{SEP}{one}", at))
                    rest = {**holder, "c": {n: s for n, s in holder["c"].items() if n != one}}
                    x, y = (x, rest) if way == "in" else (rest, y)
        cx, cy, below = x.get("c", {}), y.get("c", {}), at + SEP if at else ""
        for name in cx:
            if name in cy:
                align(cx[name], cy[name], below + name)
        gone.extend((below, n, cx[n]) for n in sorted(cx.keys() - cy.keys()))
        come.extend((below, n, cy[n]) for n in sorted(cy.keys() - cx.keys()))

    align(a, b, path)
    # what a match of a pair saves against removing one and adding the other
    saving: dict[tuple[int, int], float] = {}
    cost: dict[tuple[int, int], float] = {}
    for i, (up, x, tx) in enumerate(gone):
        for j, (vp, y, ty) in enumerate(come):
            if up == vp:
                c = rename_cost(x, tx, y, ty, alike if not up else None)
            elif x == y or same_information(x, tx, y, ty):
                c = MOVE + RENAME * (x != y) if tx["t"] == ty["t"] else NEVER
            else:
                continue
            if c >= NEVER:
                continue
            c += tree_edit(tx, ty, None, "?")[0] if "c" in tx or "c" in ty else 0.0
            won = DELETE * nodes_of(tx) + ADD * nodes_of(ty) - c
            if won > 0:
                cost[i, j], saving[i, j] = c, won + TOP * (up == vp == "")
    match: dict[int, int] = {}
    for rows, cols in _components(saving):
        # a row may also take one of as many empty columns as there are rows: it is removed
        matrix = [[-saving[i, j] if (i, j) in saving else NEVER for j in cols] + [0.0] * len(rows) for i in rows]
        for i, k in zip(rows, assign(matrix), strict=True):
            if k < len(cols):
                match[i] = cols[k]
    for i, (up, x, tx) in enumerate(gone):
        if i not in match:
            total += DELETE * nodes_of(tx)
            script.append(("removed", up + x, ""))
            continue
        vp, y, ty = come[match[i]]
        total += cost[i, match[i]]
        script.append(("renamed" if up == vp else "moved", up + x, vp + y))
        script += [s for s in tree_edit(tx, ty, None, vp + y)[1] if s[1] != vp + y]
    taken = set(match.values())
    for j, (vp, y, ty) in enumerate(come):
        if j not in taken:
            total += ADD * nodes_of(ty)
            script.append(("added", "", vp + y))
    return total, script


# ---- one folder's files in order: a scan with carried state ----


def _known(old: dict | None, new: dict) -> dict:
    """``new`` with the nodes that are null as last known."""
    if new["t"] == "null":
        return old or new
    if "c" not in new or old is None or "c" not in old:
        return new
    return {**new, "c": {n: _known(old["c"].get(n), s) for n, s in new["c"].items()}}


def step(state: dict | None, tree: dict, alike: Alike | None = None) -> tuple[dict, list[Edit]]:
    """Next state of a folder, the schema of its last file with what was known of fields that are null now, and the changes of this file."""
    if state is None:
        return tree, []
    script = tree_edit(state, tree, alike)[1]
    before = dict(state["c"])
    for kind, old, new in script:
        if kind == "renamed" and SEP not in new:
            before[new] = state["c"][old]
    return {"t": "object", "c": {n: _known(before.get(n), s) for n, s in tree["c"].items()}}, script


def ordered_schemas(crawls: DataFrame) -> DataFrame:
    """``folder, file_name, tree, feats`` of every file with a valid JSON object, range-partitioned and sorted by folder and time, cut from lineage.

    Copies of a file are combined first. No folder is bound to one partition, whatever its share of
    the files. ``feats`` is what the values of each top-level field look like, as hashed features by field.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
        for b in batches:
            trees, feats = [], []
            for d in b["doc"]:
                tree = parse_schema(d)
                trees.append(tree)
                feats.append(None if tree is None else json.dumps({n: sorted({zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in value_features(x)}) for n, x in parse_document(d).items()}))
            yield pd.DataFrame({"folder": b["folder"], "file_name": b["file_name"], "tree": trees, "feats": feats})

    files = (
        spread(crawls.select(F.coalesce("folder", F.lit("")).alias("folder"), F.coalesce("file_name", F.lit("")).alias("file_name"), "doc"))
        .mapInPandas(parse, "folder string, file_name string, tree string, feats string")
        .filter(F.col("tree").isNotNull())
        .groupBy("folder", "file_name").agg(F.min(F.struct("tree", "feats")).alias("m")).select("folder", "file_name", "m.tree", "m.feats")
    )
    return in_order(files.withColumn("second", F.expr("try_cast(regexp_extract(file_name, '^[0-9]+', 0) as decimal(38,0))")), "folder", "second", "file_name")


def alike_names(ordered: DataFrame) -> Alike:
    """Pairs of top-level names under which all files together hold alike values, though a file hardly holds both.

    A name's profile counts its values' features by JSON type; two are alike if their cosine is at least ALIKE. Names that
    occur together about as often as by chance are two fields, however alike their values. The driver
    holds a profile a name, of at most MAX_NAMES names, whatever the number of files.
    """

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for tree, feats in zip(b["tree"], b["feats"], strict=True):
                types = json.loads(tree)["c"]
                for name, ids in json.loads(feats).items():
                    t = types[name]["t"]
                    n[name, t, -1] += 1
                    n.update((name, t, i) for i in ids)
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["name", "t", "bucket", "n"])

    counts = cut(ordered.select("tree", "feats").mapInPandas(profile, "name string, t string, bucket int, n long").groupBy("name", "t", "bucket").agg(F.sum("n").alias("n")))
    if counts.select("name").distinct().limit(MAX_NAMES + 1).count() > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names")
    rows = counts.collect()
    names = sorted({r["name"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    found: Alike = {}
    for t in sorted({r["t"] for r in rows} - {"null"} | {"*"}):
        mine = [r for r in rows if t in ("*", r["t"])]
        size = np.zeros(len(names))
        x = np.zeros((len(names), BUCKETS), dtype=np.float32)
        for r in mine:
            if r["bucket"] >= 0:
                x[at[r["name"]], r["bucket"]] += r["n"]
            elif r["t"] != "null":
                size[at[r["name"]]] += r["n"]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        enough = np.flatnonzero(size >= LEAST_VALUES)
        for lo in range(0, len(enough), 512):
            some = enough[lo : lo + 512]
            for i, j in np.argwhere(x[some] @ x[enough].T >= ALIKE):
                found.setdefault((names[some[i]], names[enough[j]]), set()).add(t)
    partners: dict[str, set[str]] = {}
    for p, q in found:
        if p < q:
            partners.setdefault(p, set()).add(q)

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for tree in b["tree"]:
                have = json.loads(tree)["c"].keys()
                for p in have & partners.keys():
                    n.update((p, q) for q in partners[p] & have)
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["p", "q", "n"])

    files: Counter = Counter()
    for r in rows:
        if r["bucket"] < 0:
            files[r["name"]] += r["n"]
    if partners:
        total = ordered.count()
        for r in ordered.select("tree").mapInPandas(together, "p string, q string, n long").groupBy("p", "q").agg(F.sum("n").alias("n")).collect():
            if r["n"] * total > TOGETHER * files[r["p"]] * files[r["q"]]:
                found.pop((r["p"], r["q"]), None)
                found.pop((r["q"], r["p"]), None)
    return found


def _shown(path: str) -> str:
    return path.replace(SEP, ".")


def _scan(ordered: DataFrame, alike: Alike, emit: Callable[[Edit], tuple], schema: str) -> DataFrame:
    def file_step(state: dict | None, row: tuple) -> tuple[dict, list[tuple]]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
        folder, name, tree = row
        old, tree = state, json.loads(tree)
        state, script = step(state, tree, alike)
        return state, [(folder, name, *emit(s, old, tree)) for s in script]

    return ordered_scan(ordered.select("folder", "file_name", "tree"), "folder", file_step, schema)


def schema_changes(crawls: DataFrame, ordered: DataFrame | None = None, alike: Alike | None = None) -> DataFrame:
    """CHANGE_SCHEMA: every change of a file against the valid file saved just before it in its folder.

    Files are ordered by the second their name begins with, then by name; names without one come
    first. Each step's changes are the minimum-cost edit script between the two schema trees; nested
    members have dotted paths and ``nested`` set. A folder's files may lie in many partitions: the state
    that is carried along (the last schema of one folder) is as small as a schema. Invalid
    documents and documents that are no object count for nothing; an empty table gives no rows.
    """
    ordered = ordered_schemas(crawls) if ordered is None else ordered
    alike = alike_names(ordered) if alike is None else alike
    emit = lambda s, *_: (s[0], _shown(s[1]), _shown(s[2]), SEP in s[1] or SEP in s[2])
    return _scan(ordered, alike, emit, CHANGE_SCHEMA)


def field_changes(crawls: DataFrame) -> DataFrame:
    """``folder, file_name, change_kind, old_field, new_field``: the edit scripts read at top level only.

    A move out of or into a nested object adds or removes the top-level field that it makes or ends.
    """

    def emit(s: Edit, old: dict, new: dict) -> tuple:
        kind, x, y = s
        if kind == "moved" and SEP not in y and y not in old["c"]:
            kind, x = "added", ""
        elif kind == "moved" and SEP not in x and x not in new["c"]:
            kind, y = "removed", ""
        return kind, x, y, SEP in x or SEP in y

    ordered = ordered_schemas(crawls)
    return _scan(ordered, alike_names(ordered), emit, CHANGE_SCHEMA).filter("NOT nested").drop("nested").distinct()


def change_report(changes: DataFrame) -> DataFrame:
    """``change_kind, nested, old_field, new_field, files, folders``: how many files and different folders have each change."""
    change = ["change_kind", "nested", "old_field", "new_field"]
    per = changes.groupBy(*change, "folder").agg(F.count(F.lit(1)).alias("files"))
    return per.groupBy(*change).agg(F.sum("files").alias("files"), F.count(F.lit(1)).alias("folders"))


# ---- one consistent table ----


def field_joins(ordered: DataFrame, alike: Alike) -> dict[str, str]:
    """Path of a field or member -> the path it is read under, of all paths that edit scripts join by renames and moves: the one most scripts keep to.

    Different joins are counted before they are gathered: at most MAX_NAMES.
    """
    joins = _scan(ordered, alike, lambda s, *_: (*s, False), CHANGE_SCHEMA).filter("change_kind IN ('renamed', 'moved') AND NOT contains(concat(old_field, new_field), '[]')").groupBy("old_field", "new_field").agg(F.count(F.lit(1)).alias("n")).limit(MAX_NAMES + 1).collect()
    if len(joins) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} pairs of field names")
    have = Counter()
    if joins:
        paths = {p for r in joins for p in (r["old_field"], r["new_field"])}

        def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n: Counter = Counter()
            for b in batches:
                for tree in b["tree"]:
                    tree = json.loads(tree)
                    n.update(p for p in paths if _holds(tree, p))
            yield pd.DataFrame(list(n.items()), columns=["path", "n"])

        for r in ordered.select("tree").mapInPandas(held, "path string, n long").groupBy("path").agg(F.sum("n").alias("n")).collect():
            have[r["path"]] = r["n"]
    root: dict[str, str] = {}

    def top(p: str) -> str:
        while root.setdefault(p, p) != p:
            p = root[p]
        return p

    for r in sorted(joins, key=lambda r: (r["old_field"], r["new_field"])):
        a, b = top(r["old_field"]), top(r["new_field"])
        # the shallower path names the field, then the one more files hold
        keep, give = sorted((a, b), key=lambda p: (p.count(SEP), -have[p], p))
        root[give] = keep
    return {p: top(p) for p in root if top(p) != p}


def _holds(tree: dict, path: str) -> bool:
    for name in path.split(SEP):
        tree = tree.get("c", {}).get(name)
        if tree is None:
            return False
    return True


def read_under(path: str, joins: dict[str, str]) -> str:
    """The path's place in the consistent table: joins are applied to every step, from the top down."""
    at = ""
    for name in path.split(SEP):
        at = at + SEP + name if at else name
        at = joins.get(at, at)
    return at


_NUMBER = re.compile(r"[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?")


def _class(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer" if -(2**63) <= v < 2**63 else "number"
    if isinstance(v, float):
        return "number"
    if isinstance(v, str):
        if _NUMBER.fullmatch(v.strip()):
            return "number text"
        if v.strip().lower() in ("yes", "no", "true", "false"):
            return "boolean text"
        return "time text" if _leaf_kind(v) == "time" else "text"
    return "list" if isinstance(v, list) else "object"


def leaves(v: dict, path: str = "") -> Iterator[tuple[str, str, str]]:
    """``(path, class, value as text)`` of every value of a document that is neither null nor an object with members; lists are values."""
    for name, x in v.items():
        at = path + SEP + name if path else name
        if isinstance(x, dict) and x:
            yield from leaves(x, at)
        elif x is not None:
            yield at, _class(x), x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def project(doc: dict, joins: dict[str, str]) -> list[tuple[str, str, str]]:
    """``(column path, class, value)``: the edit scripts compiled into this document's projection.

    If a document holds several fields that are read under one path, the one of that name, else the first by
    name, is; the others keep their own path, so no value is lost. Lists have paths of their own.
    """
    own = [(read_under(p, joins), p, c, v) for p, c, v in leaves(doc)]
    taken: set[tuple[str, bool]] = set()
    out = []
    for at, p, c, v in sorted(own, key=lambda x: (x[0], x[0] != x[1], x[1])):
        if (at, c == "list") in taken:
            at = p
        taken.add((at, c == "list"))
        out.append((at + (SEP + "list" if c == "list" else ""), c, v))
    return out


#: Classes whose values a column of a type can hold, most telling type first.
_HELD = {"boolean": ("boolean", "boolean text"), "bigint": ("integer", "number text"), "double": ("integer", "number", "number text"), "array<string>": ("list",)}


def _column_type(n: dict[str, int]) -> str:
    """Type of a column by how many values of each class it has: the one most values can be read as. Text is read as a number, time or truth value only beside native ones."""
    if "list" in n:
        return "array<string>"
    native = {"number": n.get("integer", 0) + n.get("number", 0), "boolean": n.get("boolean", 0)}
    read = {"number": n.get("number text", 0) + n.get("time text", 0), "boolean": n.get("boolean text", 0)}
    best, most = max(((k, v + read[k]) for k, v in native.items() if v), key=lambda x: x[1], default=("", 0))
    if most <= sum(n.values()) - most:
        return "string"
    return "boolean" if best == "boolean" else "double" if n.get("number") else "bigint"


def consistent_table(crawls: DataFrame) -> DataFrame:
    """One row a file, one typed column a canonical path: ``folder, file_name, copies, valid`` and the columns.

    Renames, moves and nested renames of the edit scripts are compiled into a projection that is applied to
    every file. A column has the type most of its values have; text that reads as a number, a time in a column of times (seconds) or a yes or
    no is converted; what can't be is kept as text in a column of the same name with ``__text``. Lists are columns of
    their own (``__list``), their elements as text. Names of members are joined by ``__``. ``valid`` tells whether any copy of the file is a JSON object. An empty table
    has the first four columns.
    """
    ordered = ordered_schemas(crawls)
    joins = field_joins(ordered, alike_names(ordered))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
        for b in batches:
            docs = [parse_document(d) if parse_schema(d) else None for d in b["doc"]]
            cells = [None if d is None else json.dumps(project(d, joins), ensure_ascii=False) for d in docs]
            yield pd.DataFrame({"folder": b["folder"], "file_name": b["file_name"], "cells": cells})

    read = spread(crawls.select("folder", "file_name", "doc")).mapInPandas(parse, "folder string, file_name string, cells string")
    files = read.groupBy("folder", "file_name").agg(F.min("cells").alias("cells"), F.count(F.lit(1)).alias("copies"))
    triples = F.from_json("cells", "array<array<string>>")
    cell = F.transform(triples, lambda t: F.struct(t[0].alias("path"), F.struct(t[1].alias("c"), t[2].alias("v")).alias("x")))
    files = cut(files.select("folder", "file_name", "copies", F.map_from_entries(cell).alias("m")))
    seen = files.select(F.explode("m").alias("path", "x")).groupBy("path", "x.c").agg(F.count(F.lit(1)).alias("n")).limit(8 * MAX_NAMES + 1).collect()
    classes: dict[str, dict[str, int]] = {}
    for r in seen:
        classes.setdefault(r["path"], {})[r["c"]] = r["n"]
    if len(classes) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} columns")
    used = {"folder", "file_name", "copies", "valid"}

    def named(name: str) -> str:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        return name

    cols = []
    for path, n in sorted(classes.items()):
        name, kind = named(path.replace(SEP, "__")), _column_type(n)
        x = F.try_element_at("m", F.lit(path))
        if kind == "string":
            cols.append(x["v"].alias(name))
            continue
        held = list(_HELD[kind])
        if kind == "array<string>":
            value = F.from_json(x["v"], kind)
        elif kind == "boolean":
            value = F.lower(F.trim(x["v"])).isin("yes", "true")
        else:
            value = F.regexp_replace(F.trim(x["v"]), ",", "").try_cast(kind)
            if "time text" in n:
                held.append("time text")
                value = F.when(x["c"] == "time text", F.unix_seconds(x["v"].try_cast("timestamp")).cast(kind)).otherwise(value)
        value = F.when(x["c"].isin(held), value)
        cols.append(value.alias(name))
        if set(n) - {c for c in held if c != "time text" and c != "number text"}:
            cols.append(F.when(value.isNull(), x["v"]).alias(named(name + "__text")))
    return files.select("folder", "file_name", "copies", F.col("m").isNotNull().alias("valid"), *cols)
