"""References to records that do not exist, and what inherits from them (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions.page_key import key_host, page_key
from seamark.plans.skew import BROADCAST_ROWS, hot_split_join, lookup_join
from seamark.session import cut, cut_table

#: Statuses of a page that is gone.
GONE = (404, 410)
#: Most record ids (16 bytes each) that are broadcast after they were counted.
BROADCAST_IDS = 500_000


def references(pages: DataFrame) -> DataFrame:
    """``page_id, crawl_id, crawl_day, url_key, ref_field, target_key``: one row a reference of a page, by page key.

    A page's references through one field that are spelled alike are one; null, empty and blank addresses are no
    references. An address that begins with one slash is read on the page's own host.
    """
    one = lambda name: F.struct(F.lit(name).alias("ref_field"), F.col(name).alias("address"))
    links = F.transform(
        F.array_distinct(F.coalesce(F.col("internal_link_urls.target"), F.array().cast("array<string>"))),
        lambda t: F.struct(F.lit("internal_link_urls").alias("ref_field"), t.alias("address")),
    )
    # explode_outer, as explode would have the list computed once more to tell whether it is empty
    each = F.explode_outer(F.concat(F.array(one("canonical"), one("redirect_url")), links))
    rows = pages.select("page_id", "crawl_id", "crawl_day", page_key(F.col("url")).alias("url_key"), each.alias("r")).filter("r.address <> ''")
    return rows.select("page_id", "crawl_id", "crawl_day", "url_key", "r.ref_field", page_key(F.col("r.address"), key_host(F.col("url_key"))).alias("target_key"))


def key_history(pages: DataFrame) -> DataFrame:
    """``key, day, gone``: per page key and crawl day, whether all of the day's latest-fetched answers say the page is gone."""
    return (
        pages.select(page_key(F.col("url")).alias("key"), F.col("crawl_day").alias("day"), F.coalesce(F.col("status_code").isin(*GONE), F.lit(False)).alias("gone"))
        .groupBy("key", "day")
        .agg(F.min("gone").alias("gone"))
    )


def resolve(demand: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``orphan_kind`` to ``target_key, crawl_day, n_refs``: missing, late, deleted, or null if the page was there;
    and ``target_day``, the day of the answer that tells.

    An as-of match without a join: both sides are lined up per key by day, and each reference takes
    over the last answer of its own or an earlier day. A key holds a row a day at most on either
    side, so windows stay small however often the key is referred to. Rows without a day come first.
    """
    both = history.select("key", "day", "gone", F.lit(None).cast("long").alias("n_refs"), F.lit(0).alias("side")).unionByName(
        demand.select(F.col("target_key").alias("key"), F.col("crawl_day").alias("day"), F.lit(None).cast("boolean").alias("gone"), "n_refs", F.lit(1).alias("side"))
    )
    past = Window.partitionBy("key").orderBy(F.col("day").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.select("key", "day", "n_refs", "side", F.last("gone", ignorenulls=True).over(past).alias("was"), F.last(F.when(F.col("side") == 0, F.struct("day")), ignorenulls=True).over(past).alias("at"), F.min("side").over(Window.partitionBy("key")).alias("known"))
        .filter("side = 1")
        .select(
            F.col("key").alias("target_key"), F.col("day").alias("crawl_day"), "n_refs",
            F.when(F.col("known") == 1, "missing").when(F.col("was").isNull(), "late").when(F.col("was"), "deleted").alias("orphan_kind"), F.col("at.day").alias("target_day"),
        )
    )


def record_id(key: Column, day: Column) -> Column:
    """128-bit id of a record, which is a page key on a crawl day: keys travel and meet as numbers."""
    return F.struct(F.xxhash64(key, day).alias("a"), F.xxhash64(F.lit("record"), day, key).alias("b"))


def verdicts(refs: DataFrame, history: DataFrame) -> DataFrame:
    """``target_key, crawl_day, n_refs, orphan_kind, record`` of every key referred to on a day, cut from lineage.

    ``record`` is the record that a standing reference means: the latest of its own or an earlier day. Keys of hosts of which there is no row, and
    the empty key, have no row: references to them do not count.
    """
    demand = refs.filter("target_key <> ''").groupBy("target_key", "crawl_day").agg(F.count(F.lit(1)).alias("n_refs"))
    hosts = cut(history.select(key_host(F.col("key")).alias("key_host")).distinct())
    found = lookup_join(resolve(demand, history).withColumn("key_host", key_host(F.col("target_key"))), hosts, ["key_host"], "left_semi")
    record = F.when(F.col("orphan_kind").isNull(), record_id(F.col("target_key"), F.col("target_day")))
    return cut(found.select("target_key", "crawl_day", "n_refs", "orphan_kind", record.alias("record")))


def orphaned_records(edges: DataFrame, first: DataFrame) -> DataFrame:
    """``record, level``: the records ``first`` (``record``) at level 0, and those that refer to them over n ``edges`` (``record, target``).

    A fixpoint of semi-joins down the references until a round finds no new record. Each record is found
    once, so cycles end, however long the chains.
    """
    frontier, level = cut(first), 0
    done = frontier.withColumn("level", F.lit(0))
    while not frontier.isEmpty():
        level += 1
        hit = lookup_join(edges, frontier.select(F.col("record").alias("target")), ["target"], "left_semi", rows=BROADCAST_IDS)
        frontier = cut(hit.select("record").distinct().join(done, "record", "left_anti"))
        done = done.unionByName(frontier.withColumn("level", F.lit(level)))
        if level % 16 == 0:
            done = cut(done)  # keeps the plan short on long chains
    return done


def _bound(refs: DataFrame, told: DataFrame) -> DataFrame:
    """References with what is told of their key and day (unique, with ``n_refs``): broadcast if few were counted, else split by hot keys."""
    if told.count() <= BROADCAST_ROWS:
        return refs.join(F.broadcast(told.drop("n_refs")), (refs["target_key"] == told["target_key"]) & refs["crawl_day"].eqNullSafe(told["crawl_day"])).select(refs["*"], *(c for c in told.columns if c not in ("target_key", "crawl_day", "n_refs")))
    return hot_split_join(refs, told, ["target_key", "crawl_day"], "n_refs").drop("n_refs")


class Cascade:
    """The settled cascade over a table of pages: which keys are orphans on which days, direct or inherited.

    A record is a page key on a crawl day. It is orphaned if any of its references, in any of the three
    fields, is a direct orphan or leads to an orphaned record; every reference to an orphaned record is
    ``inherited``, whatever else its page refers to. A reference means the latest record of its own or an
    earlier day, of whatever crawl. What a record refers to on itself hands nothing on.
    ``crawl_day`` null is a day before all others; an empty table has no orphans.

    ``told`` is ``target_key, crawl_day, n_refs, orphan_kind, level``: missing, late and deleted at level 0, inherited over n
    references at level n; cut from its lineage.
    """

    def __init__(self, pages: DataFrame):
        self.refs = cut_table(references(pages))
        settled = verdicts(self.refs, key_history(pages))
        linked = _bound(self.refs.select("target_key", "crawl_day", record_id(F.col("url_key"), F.col("crawl_day")).alias("own")), settled)
        graph = cut_table(linked.filter("orphan_kind IS NOT NULL OR record <> own").select(F.col("own").alias("record"), F.col("record").alias("target")))
        records = orphaned_records(graph.filter("target IS NOT NULL"), graph.filter("target IS NULL").select("record").distinct())
        inherited = settled.join(records, "record", "left").select(
            "target_key", "crawl_day", "n_refs", F.coalesce("orphan_kind", F.when(F.col("level").isNotNull(), "inherited")).alias("orphan_kind"), F.when(F.col("orphan_kind").isNotNull(), F.lit(0)).otherwise(F.col("level") + 1).alias("level")
        )
        self.told = cut(inherited.filter("orphan_kind IS NOT NULL"))

    def orphans(self, direct_only: bool = False) -> DataFrame:
        """``page_id, crawl_id, crawl_day, url_key, ref_field, target_key, orphan_kind, level``: every orphan reference, or those of level 0."""
        found = _bound(self.refs, self.told.filter("level = 0") if direct_only else self.told)
        return found.filter("level = 0 OR target_key <> url_key")

    def report(self) -> DataFrame:
        """``ref_field, month, orphan_kind, level, refs, targets``: orphan references per field and month of crawl_day, and how many targets they name.

        References are counted by key and day before they meet what is told of them.
        """
        per = self.refs.groupBy("target_key", "crawl_day", "ref_field", (F.col("target_key") == F.col("url_key")).alias("own")).agg(F.count(F.lit(1)).alias("refs"))
        same = (per["target_key"] == self.told["target_key"]) & per["crawl_day"].eqNullSafe(self.told["crawl_day"])
        found = per.join(self.told, same).filter("level = 0 OR NOT own").select("ref_field", F.date_format(per["crawl_day"], "yyyy-MM").alias("month"), "orphan_kind", "level", per["target_key"], "refs")
        by = ["ref_field", "month", "orphan_kind", "level"]
        return found.groupBy(*by, "target_key").agg(F.sum("refs").alias("refs")).groupBy(*by).agg(F.sum("refs").alias("refs"), F.count(F.lit(1)).alias("targets"))


def orphan_cascade(pages: DataFrame) -> DataFrame:
    """Every orphan reference with ``level``: 0 for direct ones, n for those inherited over n references; see Cascade."""
    return Cascade(pages).orphans()
