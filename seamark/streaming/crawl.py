"""A crawl as a stream: running counters, inlinks, per-host pacing, error streaks, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seamark.plans.ordered import in_order, ordered_scan

PAGE_EVENT = "seq long, host string, url string, status_code int, response_time double, error string, waf string, ts timestamp, internal_link_urls array<struct<target:string,anchor:string,placement:string>>"

#: Fixed values of pacing: error streak lengths at which a notice is due, and the time a suspended crawl stays resumable.
NOTICES = (3, 6, 12)
RESUME_SECONDS = 1800


def read_events(spark: SparkSession, folder: str, schema: str = PAGE_EVENT, files_per_batch: int = 1) -> DataFrame:
    """Stream of page events from a folder of JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def running_totals(events: DataFrame) -> DataFrame:
    """Pages, errors and response time so far (for update or complete mode)."""
    return events.groupBy().agg(F.count(F.lit(1)).alias("crawled"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.sum(F.coalesce("response_time", F.lit(0.0))).alias("total_time"))


def running_inlinks(events: DataFrame) -> DataFrame:
    """Links to each target so far."""
    return events.select(F.explode("internal_link_urls").alias("e")).groupBy(F.col("e.target").alias("target")).agg(F.count(F.lit(1)).alias("links"))


# ---- per-host pacing: a pure step, folded in batch and in streams alike ----


def next_pace(pace: float, status: int, waf: str | None, error: str | None) -> tuple[float, float]:
    """Delay multiplier after an answer, and for how many seconds the host rests.

    429 and 503 slow down at once and rest 30 s, 403 60 s; a firewall's block slows down most and rests
    300 s. A failed connection slows down a little; a success speeds up again, to 1 at least.
    """
    if status in (429, 503, 403):
        if waf:
            return (max(pace * 5, 20.0) if pace < 20 else min(pace * 2, 40.0)), 300.0
        if status == 403:
            return (max(pace * 3, 10.0) if pace < 10 else min(pace * 2, 30.0)), 60.0
        return (max(pace * 2, 10.0) if pace < 10 else min(pace * 2, 40.0)), 30.0
    if status == 0 or error:
        return min(pace * 1.5, 20.0), 0.0
    return max(1.0, pace * 0.8) if pace > 1 else pace, 0.0


def next_streak(streak: int, failed: bool) -> tuple[int, int | None]:
    """Error streak after an answer (a success takes one off, not below 0), and the notice that is due."""
    streak = streak + 1 if failed else max(0, streak - 1)
    return streak, streak if failed and streak in NOTICES else None


PACE_SCHEMA = "host string, seq long, pace double, rest double, streak int, notice int"


def _fold(rows: pd.DataFrame, pace: float, streak: int) -> tuple[list[tuple], float, int]:
    out = []
    for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
        status = 0 if pd.isna(r.status_code) else int(r.status_code)
        error, waf = (None if pd.isna(x) or x == "" else x for x in (r.error, r.waf))
        pace, rest = next_pace(pace, status, waf, error)
        streak, notice = next_streak(streak, status >= 400 or status == 0 or error is not None)
        out.append((r.host, r.seq, pace, rest, streak, notice))
    return out, pace, streak


def stream_pacing(events: DataFrame, expire: bool = False) -> DataFrame:
    """PACE_SCHEMA for every event of a stream, with state per host kept across batches in the checkpoint; with ``expire``,
    a host's state is dropped after RESUME_SECONDS without events. Batches must come in the order of ``seq``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pace, streak = state.get if state.exists else (1.0, 0)
        rows = pd.concat(list(batches))
        out, pace, streak = _fold(rows, pace, streak)
        state.update((pace, streak))
        if expire:
            state.setTimeoutDuration(RESUME_SECONDS * 1000)
        yield pd.DataFrame(out, columns=["host", "seq", "pace", "rest", "streak", "notice"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return events.select("host", "seq", "status_code", "error", "waf").groupBy("host").applyInPandasWithState(step, PACE_SCHEMA, "pace double, streak int", "append", timeout)


def batch_pacing(log: DataFrame) -> DataFrame:
    """PACE_SCHEMA for every row of a response log (``host, seq, status_code, error, waf``): the same fold in batch, for hosts of any size."""

    def step(state, row):
        host, seq, status, error, waf = (None if pd.isna(x) else x for x in row)
        pace, streak = state or (1.0, 0)
        status, error, waf = int(status or 0), error or None, waf or None
        pace, rest = next_pace(pace, status, waf, error)
        streak, notice = next_streak(streak, status >= 400 or status == 0 or error is not None)
        return [pace, streak], [(host, seq, pace, rest, streak, notice)]

    rows = log.select(F.coalesce("host", F.lit("")).alias("host"), "seq", "status_code", "error", "waf")
    return ordered_scan(in_order(rows, "host", "seq"), "host", step, PACE_SCHEMA)


# ---- event-time windows ----


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are left out of streams."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    out = src.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of each user: start, end and number of events."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    out = src.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def start(df: DataFrame, name: str, mode: str, checkpoint: str, seconds: int | None = None):
    """Starts a query into an in-memory table; without ``seconds`` it takes what there is and ends."""
    w = df.writeStream.queryName(name).format("memory").outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()
