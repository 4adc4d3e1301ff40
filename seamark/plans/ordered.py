"""Sequential folds over ordered groups of any size, in parallel."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame

from seamark.session import cut

#: ``step(state, row) -> (next state, rows out)``: state is None at a group's start and survives JSON; row is a tuple of the columns.
Step = Callable[[object, tuple], tuple[object, list[tuple]]]


def in_order(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Range-partitioned and sorted by group and order, and cut from its lineage: no group is bound to one partition.

    The number of partitions is left to the engine, which joins small neighbouring ranges.
    """
    return cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order))


def ordered_scan(rows: DataFrame, group: str, step: Step, schema: str) -> DataFrame:
    """Folds ``step`` over every group of ``rows`` (the result of in_order) and returns what it puts out.

    A group may lie in many partitions. Each partition is scanned in order, beginning with the state
    its predecessor ends in. Those states are settled by repeating the scan of partitions whose start
    has changed, and of no others, until none does: a state that soon forgets its start takes two or three rounds, any
    other at most one a partition. The driver holds one state a partition, whatever the number of
    rows. Group values must not be null.
    """
    columns = rows.columns
    at = columns.index(group)
    names = [c.strip().split(" ", 1)[0] for c in schema.split(",")]

    sc = rows.sparkSession.sparkContext

    def scan(starts: Broadcast, emit: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pid = TaskContext.get().partitionId()
            current, state = starts.value.get(pid) or (None, None)
            seen = False
            for b in batches:
                out: list[tuple] = []
                for row in b.itertuples(index=False, name=None):
                    if row[at] != current:
                        current, state = row[at], None
                    state, more = step(state, row)
                    seen = True
                    if emit:
                        out += more
                if emit:
                    yield pd.DataFrame(out, columns=names)
            if seen and not emit:
                yield pd.DataFrame([(pid, json.dumps([current, state]))], columns=["pid", "end"])

        return run

    n = rows.rdd.getNumPartitions()
    starts: dict[int, list | None] = {}
    ends: dict[int, list] = {}
    todo = list(range(n))
    while todo and n > 1:
        ended = rows.mapInPandas(scan(sc.broadcast(starts), False), "pid int, end string").rdd
        for r in sc.runJob(ended, list, todo):
            ends[r["pid"]] = json.loads(r["end"])
        new, carried = {}, None
        for pid in range(n):
            new[pid] = carried
            carried = ends.get(pid, carried)
        todo = [pid for pid in range(n) if new[pid] != starts.get(pid)]
        starts = new
    return rows.mapInPandas(scan(sc.broadcast(starts), True), schema)
