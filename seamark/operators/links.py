"""The link graph: edges, in-degree, anchors, external links, hreflang, breadth-first depth."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import urls
from seamark.session import cut

#: Fixed value: anchor texts that say nothing about their target.
GENERIC = (
    "click here|read more|learn more|more|here|this|this page|find out more|find out|more info|more information|details|view|view more|see more|see details|link|website|this link|click|tap here|tap|open|go|go here|continue|"
    "continue reading|full story"
).split("|")


def edges(pages: DataFrame) -> DataFrame:
    """``page_id, crawl_id, source, target, anchor, placement``: one row an internal link, in page order the first anchor of a target."""
    return pages.select("page_id", "crawl_id", F.col("url").alias("source"), F.explode("internal_link_urls").alias("e")).filter("e IS NOT NULL").select(
        "page_id", "crawl_id", "source", "e.target", "e.anchor", "e.placement"
    )


def inlinks(links: DataFrame) -> DataFrame:
    """``crawl_id, target, links, sources``: distinct (source, anchor, placement) and distinct sources of each target of a crawl.

    Distinctness is settled before targets are grouped, so a target that everything links to is counted from partial sums.
    """
    once = links.groupBy("crawl_id", "target", "source", "anchor", "placement").agg(F.lit(1).alias("n"))
    per = once.groupBy("crawl_id", "target", "source").agg(F.sum("n").alias("n"))
    return per.groupBy("crawl_id", "target").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("sources"))


def outlinks(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce(F.size("internal_link_urls"), F.lit(0)).alias("links"), F.size(F.array_distinct("internal_link_urls.placement")).alias("placements"))


def loose_key(url: Column) -> Column:
    """Key of an address without its last slash, under which a page and its inlinks meet."""
    return F.regexp_replace(url, r"/+\z", "")


def broken_with_inlinks(pages: DataFrame, links: DataFrame, at_least: int = 400) -> DataFrame:
    """``crawl_id, page_id, url, status_code, source, anchor``: error pages with every link to them in their crawl; a page without links keeps one row."""
    bad = pages.filter(F.col("status_code") >= at_least).select("crawl_id", "page_id", "url", "status_code", loose_key(F.col("url")).alias("k"))
    to = links.select("crawl_id", loose_key(F.col("target")).alias("k"), "source", "anchor")
    return bad.join(to, ["crawl_id", "k"], "left").drop("k")


def anchor_cloud(links: DataFrame, most: int = 80, longest: int = 60) -> DataFrame:
    """``anchor, links, targets, generic, weight``: the ``most`` frequent anchors, case folded; weight runs from 0 to 1 among them."""
    a = F.trim(F.coalesce(F.col("anchor"), F.lit("")))
    key = F.lower(F.when(F.length(a) > longest, F.concat(F.left(a, F.lit(longest)), F.lit("…"))).otherwise(a))
    rows = links.filter(a != "").select(key.alias("anchor"), "target")
    pairs = rows.groupBy("anchor", "target").agg(F.count(F.lit(1)).alias("n"))
    top = pairs.groupBy("anchor").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("targets")).orderBy(F.col("links").desc(), "anchor").limit(most)
    w = Window.partitionBy(F.lit(1))
    low, high = F.min("links").over(w), F.max("links").over(w)
    return top.select("anchor", "links", "targets", F.col("anchor").isin(GENERIC).alias("generic"), F.round(F.when(high == low, 1.0).otherwise((F.col("links") - low) / (high - low)), 6).alias("weight"))


def generic_share(links: DataFrame) -> DataFrame:
    """One row: ``links, generic, share`` of links with an anchor."""
    a = F.lower(F.trim(F.coalesce(F.col("anchor"), F.lit(""))))
    return links.filter(a != "").agg(F.count(F.lit(1)).alias("links"), F.count_if(a.isin(GENERIC)).alias("generic")).withColumn("share", F.round(F.col("generic") / F.greatest(F.lit(1), F.col("links")), 6))


def link_risk(rel: Column, target: Column) -> Column:
    """high: followed and in the same window; follow: followed, new window; samewindow: not followed, same window; ok."""
    nofollow = F.coalesce(rel, F.lit("")).rlike(r"\bnofollow\b")
    fresh = F.coalesce(target, F.lit("")) == "_blank"
    return F.when(~nofollow & ~fresh, "high").when(~nofollow, "follow").when(~fresh, "samewindow").otherwise("ok")


def external_risk(external: DataFrame) -> DataFrame:
    """``risk, links, hosts`` of external links (``url, rel, target``)."""
    rows = external.filter(F.coalesce(F.col("url"), F.lit("")) != "").select(link_risk(F.col("rel"), F.col("target")).alias("risk"), urls.host(F.col("url")).alias("host"))
    per = rows.groupBy("risk", "host").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("risk").agg(F.sum("n").alias("links"), F.count_if(F.col("host") != "").alias("hosts"))


def hreflang_issues(declared: DataFrame) -> DataFrame:
    """``url, kind, detail`` from declarations (``url, lang, href``): invalid codes, several x-defaults, alternates that declare others but not this page."""
    d = declared.filter(F.coalesce(F.col("lang"), F.lit("")) != "")
    invalid = d.filter(~F.col("lang").rlike(r"^(x-default|[a-z]{2,3}(-[A-Z]{2})?)\z")).select("url", F.lit("invalid_code").alias("kind"), F.col("lang").alias("detail"))
    double = d.filter("lang = 'x-default'").groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("url", F.lit("dup_x_default").alias("kind"), F.col("n").cast("string").alias("detail"))
    to = d.filter("lang <> 'x-default' AND href IS NOT NULL").select("url", F.col("href")).distinct()
    declares = d.select(F.col("url").alias("href")).distinct()
    back = d.filter("href IS NOT NULL").select(F.col("url").alias("href"), F.col("href").alias("url")).distinct()
    oneway = to.join(declares, "href", "left_semi").join(back, ["href", "url"], "left_anti").select("url", F.lit("no_return_tag").alias("kind"), F.col("href").alias("detail"))
    return invalid.unionByName(double).unionByName(oneway)


def breadth_first(links: DataFrame, seeds: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """``node, depth``: shortest number of links from a seed, level by level, to ``max_depth`` or, if it is None, until no
    node is new; both inputs have ``source, target`` and ``node``.

    Each level joins the frontier with the edges and drops what was seen; levels are cut from their
    lineage in the shared checkpoint folder.
    """
    graph = cut(links.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct())
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = graph.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = cut(seen)  # keeps the plan short on long chains
    return seen


def trap_probe_parent(pages: DataFrame, seq: str) -> DataFrame:
    """The page under which a made-up path is probed: the first 200 page of one segment that is no redirect, else the first of more."""
    segments = F.size(F.filter(F.split(urls.path(F.col("url")), "/"), lambda s: s != ""))
    good = pages.filter((F.col("status_code") == 200) & (F.coalesce(F.col("redirect_url"), F.lit("")) == "") & (segments >= 1))
    return good.orderBy(segments != 1, seq).limit(1).select(seq, "url", segments.alias("segments"))
