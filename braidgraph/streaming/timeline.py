"""Dated facts as a timeline: each fact of a key holds until the next one.

Facts arrive in any order. They wait in state until the watermark has passed
their time, when no earlier one can come any more: an event-time timeout then takes up all
that are due, in the order of time and id, closes the span that was open and those in
between, and leaves the last one open. A fact that arrives twice, in one batch or
in several, counts once. What arrives after the watermark has passed its time is dropped.

State holds a key's facts of the last ``delay`` only, and the one that is open. Keys share
a fixed number of state rows, as each group that Spark hands to Python has a cost of its
own, which for keys of some tens of facts is nearly all there is to do.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A fact's time is kept in microseconds, as timestamps are; the watermark is in milliseconds.
SPANS = "key string, id string, value string, start_us long, end_us long"
#: The facts of a group's keys that wait or are open, as columns.
_STATE = "keys array<string>, ids array<string>, ats array<long>, facts array<string>"


def _spans(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Input: key, id, at (microseconds), value, and the event time; none at a timeout. Output: closed spans."""
    past = state.getCurrentWatermarkMs() * 1000
    held = zip(*state.get, strict=True) if state.exists else ()
    fresh = (f for part in parts for f in zip(*(part[c].tolist() for c in ("key", "id", "at", "value")), strict=True) if f[2] >= past)
    facts = defaultdict(dict)
    for key, i, at, value in chain(held, fresh):
        facts[key][at, i is None, i] = value  # a repeated fact is one; a null id comes last
    closed, left, wake = [], [], None
    for key, of_key in facts.items():
        order = sorted(of_key)
        n_due = bisect_left(order, (past,))
        closed += ((key, f[2], of_key[f], f[0], after[0]) for f, after in pairwise(order[:n_due]))
        left += ((key, f[2], f[0], of_key[f]) for f in order[max(n_due - 1, 0) :])
        if n_due < len(order):
            wake = order[n_due][0] if wake is None else min(wake, order[n_due][0])
    if left:
        state.update(tuple(map(list, zip(*left, strict=True))))
    if wake is not None:
        state.setTimeoutTimestamp(max(wake // 1000, 1))  # when the watermark is beyond it, that millisecond's facts are past
    if closed:
        yield pd.DataFrame(closed, columns=["key", "id", "value", "start_us", "end_us"])


def timeline(facts: DataFrame, key: Column, fact_id: Column, at: str, value: Column, delay: str = "1 hour", groups: int = 4096) -> DataFrame:
    """Closed spans (key, id, value, start, end) of a stream of facts whose event time is column ``at``.

    Facts without a time are left out. Keys share ``groups`` state rows, a number that is to
    stay with a checkpoint; a group's facts within the delay are one task's. The session's
    state store is set to RocksDB, which does not hold all of them in memory.
    """
    spark = facts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = facts.withWatermark(at, delay).where(F.col(at).isNotNull()).select(key.cast("string").alias("key"), fact_id.cast("string").alias("id"), F.unix_micros(at).alias("at"), value.cast("string").alias("value"), F.col(at).alias("event_time"))
    spans = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInPandasWithState(_spans, SPANS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return spans.select("key", "id", "value", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"))


def batch_timeline(facts: DataFrame, key: Column, fact_id: Column, at: str, value: Column) -> DataFrame:
    """The same spans of a table, the open ones included (without an end)."""
    rows = facts.select(key.cast("string").alias("key"), fact_id.cast("string").alias("id"), F.col(at).alias("start"), value.cast("string").alias("value"))
    rows = rows.dropDuplicates(["key", "start", "id"])
    return rows.withColumn("end", F.lead("start").over(Window.partitionBy("key").orderBy("start", "id"))).select("key", "id", "value", "start", "end")
