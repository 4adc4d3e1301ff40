"""Keyword research as joins: expansion, trends, result-page signals, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import scoring, text
from seamark.session import cut

#: Words that show an intent to buy, and the suffixes a keyword is expanded by.
MONEY_WORDS = (
    "buy price prices pricing cost cheap cheapest best top review reviews rated vs versus compare coupon discount deal deals sale free trial download near "
    "shop store order online subscription license alternative software tool tools service services company hire agency course tutorial template"
).split()
SUFFIXES = list("abcdefghijklmnopqrstuvwxyz0123456789")


def suggestions(payloads: DataFrame) -> DataFrame:
    """``query, ac_rank, suggestion`` from ``query, payload``, the payload being JSON ``[query, [suggestion, ...]]``; others give no rows."""
    listed = F.from_json(F.get_json_object("payload", "$[1]"), "array<string>")
    return payloads.select("query", F.posexplode(listed).alias("p", "suggestion")).select("query", (F.col("p") + 1).alias("ac_rank"), "suggestion").filter("suggestion IS NOT NULL")


def expand(seed: str, source: DataFrame, depth: int = 2, most: int | None = None) -> DataFrame:
    """``keyword, depth, ac_rank``: breadth-first expansion of a seed through ``source`` (``query, ac_rank, suggestion``).

    Each round asks for the frontier's keywords and for them with every suffix, and keeps what is new
    after normalisation (the best rank of each). ``most`` keywords of a level, chosen by hash and so
    without bias, are expanded further.
    """
    spark = source.sparkSession
    known = cut(spark.createDataFrame([(seed, 0, 1)], "keyword string, depth int, ac_rank int").withColumn("norm", text.fold("keyword")))
    frontier = known
    answers = source.withColumn("query", text.fold("query"))
    for level in range(1, depth + 1):
        forms = F.concat(F.array("norm"), F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(F.col("norm"), F.lit(" "), s)))
        asked = frontier.select(F.explode(forms).alias("query"))
        found = asked.join(answers, "query").withColumn("norm", text.fold("suggestion")).filter("norm <> ''")
        new = found.groupBy("norm").agg(F.min(F.struct("ac_rank", "suggestion")).alias("m")).join(known.select("norm"), "norm", "left_anti")
        frontier = new.select(F.col("m.suggestion").alias("keyword"), F.lit(level).alias("depth"), F.col("m.ac_rank").alias("ac_rank"), "norm")
        if most is not None:
            frontier = frontier.orderBy(F.xxhash64("norm")).limit(most)
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.drop("norm")


def trend_features(points: DataFrame, keys: list[str], order: str = "ts", value: str = "interest") -> DataFrame:
    """``*keys, points, mean_interest, direction, velocity``: mean of the last three points against the first three.

    Direction is their difference and velocity their relative difference, in percent within -100 and
    100; both are 0 for fewer than six points. Null values count as 0.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    asc = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    desc = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    rows = points.select(*keys, v.alias("v"), asc.alias("a"), desc.alias("d"))
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.avg("v").alias("mean"), F.avg(F.when(F.col("a") <= 3, F.col("v"))).alias("head"), F.avg(F.when(F.col("d") <= 3, F.col("v"))).alias("tail"))
    enough = F.col("points") >= 6
    diff = F.col("tail") - F.col("head")
    velocity = F.when(F.col("head") > 0, scoring.clamp(diff / F.col("head") * 100.0, -100.0, 100.0)).when(F.col("tail") > 0, 100.0).otherwise(0.0)
    return agg.select(
        *keys, "points", F.round("mean", 4).alias("mean_interest"),
        F.when(enough, F.round(scoring.clamp(diff, -100.0, 100.0), 1)).otherwise(0.0).alias("direction"), F.when(enough, F.round(velocity, 1)).otherwise(0.0).alias("velocity"),
    )


def top_regions(regions: DataFrame, most: int = 25) -> DataFrame:
    """The ``most`` regions of each keyword (``keyword, region_code, region_name, region_score``) with a positive score."""
    w = Window.partitionBy("keyword").orderBy(F.col("region_score").desc(), "region_code")
    return regions.filter("region_score > 0").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")


def related(rising: DataFrame, top: DataFrame) -> DataFrame:
    return rising.withColumn("type", F.lit("rising")).unionByName(top.withColumn("type", F.lit("top")))


def result_count(html: Column) -> Column:
    """Number of results that a result page states, in English, German or French; 0 if none."""
    digits = F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"([\d.,\s]+)\s*(?:results|Ergebnisse|résultats)", 1), r"\D", "")
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(F.expr("0").cast("long") + F.try_to_number(digits, F.lit("9" * 18)).cast("long"))


def money_words(keyword: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(F.split(F.lower(F.trim(keyword)), r"\s+")), F.array(*map(F.lit, MONEY_WORDS))))


def result_signals(serp: DataFrame) -> DataFrame:
    """Signals of result pages (``keyword, html``): counts, flags, competition and intent, rounded to tenths."""
    html = F.coalesce(F.col("html"), F.lit(""))
    has = lambda *signs: html.rlike("|".join(signs))
    links = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"href=[\"']([^\"']*(?:/aclk\?|&(?:amp;)?adurl=)[^\"']*)[\"']"), F.lit(1)), lambda x: F.left(x, F.lit(80))))
    blocks = F.regexp_count(html, F.lit(r"id=[\"'](?:tads|taw|bottomads)[\"']|<div[^>]*\bdata-text-ad\b"))
    base = serp.select(
        "keyword", result_count(html).alias("result_count"), (blocks + F.size(links)).alias("ad_count"),
        has(r"<block-component", r"data-attrid=[\"']wa:/description[\"']").alias("featured_snippet"), has("<g-section-with-header", r"data-attrid=[\"'][^\"']*Stories").alias("top_stories"),
        has(r"class=[\"'][^\"']*related-question-pair", r"jsname=[\"']yEVEwb[\"']").alias("paa"), has(r"data-attrid=[\"']kc:/local:one line summary[\"']", r"class=[\"'][^\"']*\brzgmgc\b").alias("local_pack"),
    )
    comp, density = scoring.competition(F.col("result_count")), scoring.ad_density(F.col("ad_count"))
    intent = scoring.commercial_intent(density, F.col("local_pack"), F.col("featured_snippet"), money_words(F.col("keyword")), comp)
    return base.select("*", F.lit("ok").alias("status"), F.round(comp, 1).alias("competition"), F.round(density, 1).alias("ad_density"), F.round(intent, 1).alias("commercial_intent"))


def scored_keywords(keywords: DataFrame, trends: DataFrame, serp: DataFrame) -> DataFrame:
    """Keywords (``keyword, ac_rank``) with trends (``mean_interest, direction, velocity``) and signals (``result_count,
    competition, commercial_intent``), scored; what is absent counts as unknown and its status as skipped."""
    t = trends.select("keyword", "mean_interest", "direction", "velocity", F.lit("ok").alias("trends_status"))
    s = serp.select("keyword", "result_count", "competition", "commercial_intent", F.lit("ok").alias("serp_status"))
    j = keywords.join(t, "keyword", "left").join(s, "keyword", "left")
    volume = scoring.volume_proxy(F.col("ac_rank"), F.col("mean_interest"), F.col("result_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    known = F.when(F.coalesce("competition", F.lit(0.0)) == 0, 50.0).otherwise(F.col("competition"))
    return j.select(
        "keyword", "ac_rank", volume.alias("volume_proxy"), zero("mean_interest"), zero("direction"), zero("velocity"), "result_count", F.round(known, 1).alias("competition"), zero("commercial_intent"),
        scoring.opportunity(F.col("direction"), F.col("competition"), F.col("commercial_intent"), volume).alias("opportunity"),
        F.coalesce("trends_status", F.lit("skipped")).alias("trends_status"), F.coalesce("serp_status", F.lit("skipped")).alias("serp_status"),
    )


def keyword_summary(scored: DataFrame, seed: str) -> DataFrame:
    """``metric, value`` rows about a run."""
    t = scored.agg(F.count(F.lit(1)).alias("keywords_found"), F.count_if(F.col("trends_status") == "ok").alias("trends_ok"), F.count_if(F.col("serp_status") == "ok").alias("serp_probed"))
    cells = [F.struct(F.lit("seed").alias("metric"), F.lit(seed).alias("value"))] + [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in t.columns]
    return t.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def batches(keywords: DataFrame, size: int = 5) -> DataFrame:
    """Adds ``batch``: groups of about ``size`` keywords by hash, for sources that take a few at a time."""
    n = F.greatest(F.lit(1), F.ceil(F.lit(keywords.count()) / size))
    return keywords.withColumn("batch", F.pmod(F.xxhash64("keyword"), n))
