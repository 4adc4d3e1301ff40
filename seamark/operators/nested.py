"""Deeply nested records as related flat tables, tied by interval labels (problem 5)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Members that are lists of children, by the type of the node that has them: what they hold are nodes of that name.
LISTS = {"record": ("results",), "results": ("redirect_chain", "hreflang"), "results.perf": ("third_party_hosts", "warnings")}
#: Members that hold an object, even as JSON text.
OBJECTS = {"results": ("perf",)}
#: The children of a page that p5_found names.
CHILD_NAMES = ("results", "redirect_chain", "hreflang", "og_tags", "third_party_hosts", "warnings")
#: Most different types of nodes of which tables are made.
MAX_TYPES = 1_000
NODE_SCHEMA = "rec_id string, pre int, post int, depth int, node_type string, item_name string, value string"


def _said(v):
    """A list or object written as JSON text counts as what it says."""
    if isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(v)
        except (ValueError, RecursionError):
            return v
    return v


def _listed(v) -> list:
    """A single value in place of a list is a list of one; null is no list."""
    v = _said(v)
    return [] if v is None else v if isinstance(v, list) else [v]


def _properties(v) -> list[tuple[str, object]]:
    """Open-graph tags as (property, value), from an object or a list of property/content objects."""
    v = _said(v)
    if isinstance(v, dict):
        pairs = list(v.items())
    else:
        pairs = [(x.get("property"), x.get("content")) for x in map(_said, _listed(v)) if isinstance(x, dict)]
    return [(k.removeprefix("og:"), x) for k, x in pairs if isinstance(k, str) and x is not None]


def _reject(name: str):
    raise ValueError(name)


def _members(kind: str, v) -> Iterator[tuple[str, str, object]]:
    """``(node type, item name, value)`` of what is directly below a node, nulls left out.

    A list has no node of its own: its elements are named by their position, under the type of the member that holds it.
    """
    if isinstance(v, list):
        for i, x in enumerate(v):
            if x is not None:
                yield f"{kind}[]", str(i), x
        return
    if not isinstance(v, dict):
        return
    for name, x in v.items():
        if name in LISTS.get(kind, ()):
            for i, e in enumerate(_listed(x)):
                e = _said(e) if name == "results" else e
                if e is not None:
                    yield name, str(i), e
        elif kind == "results" and name == "og_tags":
            for p, content in _properties(x):
                yield "og_tags", p, content
        elif name in OBJECTS.get(kind, ()):
            x = _said(x)
            if x is not None:
                yield f"{kind}.{name}", name, x
        elif isinstance(x, list):
            for i, e in enumerate(x):
                if e is not None:
                    yield f"{kind}.{name}", str(i), e
        elif x is not None:
            yield f"{kind}.{name}", name, x


def label_nodes(rec_id: str | None, payload: str | None, only: tuple[str, ...] | None = None) -> list[tuple]:
    """Depth-first traversal of one payload: a tuple of NODE_SCHEMA for every node, of any type and at any depth, or for those of the types ``only``.

    ``pre`` counts nodes as they are entered, ``post`` as they are left, on one clock: a node lies
    within another exactly if its interval does. Nodes that are values have their text in ``value``; objects have
    null. Null members and elements get no node, but elements keep their position.
    Null, empty and invalid payloads, and payloads that are no object, give no nodes.
    """
    try:
        doc = json.loads(payload, parse_constant=_reject) if payload else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(doc, dict):
        return []
    out: list[list] = []
    clock = 0

    def enter(kind: str, name: str, depth: int, v) -> list:
        nonlocal clock
        inner = isinstance(v, (dict, list))
        row = [rec_id, clock, -1, depth, kind, name, None if inner else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)]
        clock += 1
        if only is None or kind in only:
            out.append(row)
        return row

    # an explicit stack: nesting may be deeper than Python's own
    open_nodes = [(enter("record", "", 0, doc), _members("record", doc))]
    while open_nodes:
        row, below = open_nodes[-1]
        child = next(below, None)
        if child is None:
            row[2] = clock
            clock += 1
            open_nodes.pop()
        else:
            kind, name, v = child
            open_nodes.append((enter(kind, name, len(open_nodes), v), _members(kind, v)))
    return [tuple(r) for r in out]


def node_table(records: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """All nodes of all records (NODE_SCHEMA), or those of the types ``only``; one record per ``rec_id``: of repeated rows the one loaded last.

    Copies are combined before the shuffle. Records are parsed in Arrow batches, each on its own;
    rows without a rec_id count as one record without an id.
    """
    latest = records.groupBy("rec_id").agg(F.max(F.struct("loaded_at", "payload")).alias("m")).select(F.col("rec_id").cast("string").alias("rec_id"), F.col("m.payload").alias("payload"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for rec, payload in zip(b["rec_id"], b["payload"], strict=True):
                rows += label_nodes(rec, payload, only)
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return latest.mapInPandas(parse, NODE_SCHEMA).withColumn("rec_id", F.col("rec_id").cast("long"))


def within(nodes: DataFrame, owner: str, name: str) -> DataFrame:
    """Adds ``name_pre, name_post, name_item`` of the node of type ``owner`` whose interval holds each node (a node holds itself); null outside any.

    Nodes of one type do not hold each other, so the one entered last before a node is the only one that can hold it; it does if
    it is left no earlier than the node. Windows hold one record each.
    """
    w = Window.partitionBy("rec_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("node_type") == owner, F.struct("pre", "post", "item_name")), ignorenulls=True).over(w)
    held = nodes.withColumn("_o", last)
    inside = F.col("_o.post") >= F.col("post")
    return held.select(*nodes.columns, *(F.when(inside, F.col(f"_o.{c}")).alias(f"{name}_{a}") for c, a in (("pre", "pre"), ("post", "post"), ("item_name", "item"))))


def tie_to_pages(nodes: DataFrame) -> DataFrame:
    """Adds ``page_pos``, ``page_pre`` and ``page_post`` of the page that holds the node. Nodes outside any page are left out."""
    return within(nodes, "results", "page").filter("page_pre IS NOT NULL").withColumn("page_item", F.col("page_item").cast("int")).withColumnRenamed("page_item", "page_pos")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_pre``: the label of the node that directly holds each node, whatever its type and depth; null for records.

    The parent is the last node entered one level up, by interval containment. Each node is lined up once with its own level and once, as
    a possible parent, with the level below; windows hold one level of one record.
    """
    own = nodes.withColumn("level", F.col("depth")).withColumn("_up", F.lit(None).cast("struct<pre:int,post:int>"))
    as_parent = nodes.select(*(F.lit(None).cast(t).alias(c) if c not in ("rec_id", "pre") else F.col(c) for c, t in nodes.dtypes), (F.col("depth") + 1).alias("level"), F.struct("pre", "post").alias("_up"))
    w = Window.partitionBy("rec_id", "level").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    lined = own.unionByName(as_parent).repartition("rec_id").withColumn("_p", F.last("_up", ignorenulls=True).over(w))
    return lined.filter("node_type IS NOT NULL").select(*nodes.columns, F.when(F.col("_p.post") >= F.col("post"), F.col("_p.pre")).alias("parent_pre"))


def page_children(records: DataFrame) -> DataFrame:
    """``rec_id, page_pos, child_name, item_name``: every page and child, tied to its page and record."""
    return tie_to_pages(node_table(records, CHILD_NAMES)).select("rec_id", "page_pos", F.col("node_type").alias("child_name"), "item_name").distinct()


def type_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table a node type: ``rec_id, pre, post, parent_pre, item_name, value``. ``nodes`` is node_table's result, best cut from its lineage."""
    types = [r[0] for r in nodes.select("node_type").distinct().limit(MAX_TYPES + 1).collect()]
    if len(types) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types of nodes")
    tied = with_parents(nodes)
    return {t: tied.filter(F.col("node_type") == t).select("rec_id", "pre", "post", "parent_pre", "item_name", "value") for t in sorted(types)}


#: Columns of the flat tables: table -> node type, and the members it has as columns, with their types.
TABLES = {
    "records": ("record", {"name": "string", "saved_at": "string"}),
    "pages": ("results", {"url": "string", "status_code": "int", "title": "string"}),
    "perf": ("results.perf", {n: "double" for n in ("load_time_s", "ttfb_ms", "fetch_ms", "html_kb", "dom_nodes", "scripts", "score")}),
    "redirect_chain": ("redirect_chain", {"url": "string", "status": "int"}),
    "hreflang": ("hreflang", {"lang": "string", "href": "string"}),
    "og_tags": ("og_tags", {}),
    "third_party_hosts": ("third_party_hosts", {}),
    "warnings": ("warnings", {}),
}


def flat_table(nodes: DataFrame, name: str) -> DataFrame:
    """One of TABLES: a row a node of its type, with its own labels, those of its page, and its members as columns.

    Members are tied to the node by interval containment. ``value`` is the text of a node that is no object. Members that no table has as
    columns are in type_tables.
    """
    kind, members = TABLES[name]
    types = [kind, *(f"{kind}.{m}" for m in members)]
    if name in ("records", "pages"):
        own = within(nodes, kind, "own")
        keys = ["rec_id", "own_pre", "own_post", "own_item"]
    else:
        own = within(tie_to_pages(nodes), kind, "own")
        keys = ["rec_id", "page_pos", "page_pre", "page_post", "own_pre", "own_post", "own_item"]
    part = own.filter(F.col("node_type").isin(types) & F.col("own_pre").isNotNull())
    pick = lambda t: F.max(F.when(F.col("node_type") == t, F.col("value")))
    rows = part.groupBy(*keys).agg(pick(kind).alias("_value"), *(pick(f"{kind}.{m}").alias(f"_{m}") for m in members))
    at = [F.col("own_pre").alias("pre"), F.col("own_post").alias("post")]
    cols = [F.col(f"_{m}").try_cast(t).alias(m) for m, t in members.items()]
    if name == "records":
        return rows.select("rec_id", *at, *cols)
    if name == "pages":
        return rows.select("rec_id", F.col("own_item").cast("int").alias("page_pos"), *at, *cols)
    item = F.col("own_item").alias("property") if name == "og_tags" else F.col("own_item").cast("int").alias("pos")
    return rows.select("rec_id", "page_pos", "page_pre", "page_post", *at, *([] if name == "perf" else [item]), *cols, F.col("_value").alias("value"))


def flat_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """All of TABLES. ``nodes`` is node_table's result, best cut from its lineage."""
    return {name: flat_table(nodes, name) for name in TABLES}
