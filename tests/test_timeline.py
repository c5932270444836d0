"""A timeline from facts in any order equals the one from a table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from braidgraph.streaming import streams, timeline

SCHEMA = "who string, id string, at timestamp, what string"


def spans(df):
    return sorted((r.key, r.id, r.value, r.start, r.end) for r in df.select("key", "id", "value", "start", "end").collect())


def run(spark, folder, delay):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    return streams.drain(timeline.timeline(stream, F.col("who"), F.col("id"), "at", F.col("what"), delay))


def written(spark, folder, batches):
    """Each batch a file, read in the order of their times."""
    import os
    import time

    for n, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "who string, id string, at string, what string").coalesce(1)
        part.write.json(f"{folder}/tmp{n}")
        name = next(f for f in os.listdir(f"{folder}/tmp{n}") if f.endswith(".json"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp{n}/{name}", f"{folder}/in/{n:03d}.json")
        os.utime(f"{folder}/in/{n:03d}.json", (time.time() - 1000 + n,) * 2)
    return f"{folder}/in"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_arrival_order_gives_the_same_spans(spark, tmp_path, seed):
    rnd = random.Random(seed)
    facts = [(rnd.choice("abc"), f"f{i}", f"2024-01-{rnd.randrange(1, 20):02d} {rnd.randrange(24):02d}:00:00", rnd.choice(("x", "y", None))) for i in range(60)]
    facts += facts[:10]  # repeated ones
    rnd.shuffle(facts)
    # the last batch moves the watermark past all others; its own facts are not due
    batches = [facts[i::4] for i in range(4)] + [[("z", "end", "2030-01-01 00:00:00", None)]]
    got = run(spark, written(spark, str(tmp_path), batches), "1000 days")
    table = spark.createDataFrame(facts, "who string, id string, at string, what string").withColumn("at", F.col("at").cast("timestamp"))
    want = timeline.batch_timeline(table, F.col("who"), F.col("id"), "at", F.col("what")).where("end is not null")
    assert spans(got) == spans(want) and got.count() > 40


def test_late_facts(spark, tmp_path):
    """Within the delay a late fact splits its span; beyond it, it is dropped and nothing else changes."""
    batches = [
        [("a", "1", "2024-01-01 00:00:00", "p"), ("a", "3", "2024-01-01 02:00:00", "q")],
        [("a", "2", "2024-01-01 01:00:00", "late"), ("a", "2", "2024-01-01 01:00:00", "late")],
        [("a", "4", "2024-01-09 00:00:00", "r")],
        [("a", "0", "2024-01-01 00:30:00", "too late"), ("a", "5", "2024-01-20 00:00:00", "s"), ("a", "4", "2024-01-09 00:00:00", "r")],
        [("b", "6", "2024-02-20 00:00:00", "t")],
    ]
    got = spans(run(spark, written(spark, str(tmp_path), batches), "1 day"))
    day = lambda t: (t.day, t.hour)
    assert [(k, i, v, day(s), day(e)) for k, i, v, s, e in got] == [("a", "1", "p", (1, 0), (1, 1)), ("a", "2", "late", (1, 1), (1, 2)), ("a", "3", "q", (1, 2), (9, 0)), ("a", "4", "r", (9, 0), (20, 0))]


def test_state_rows_do_not_grow_with_facts_or_keys(spark, tmp_path):
    """What a batch writes to the state store is bounded by the keys, then by the number of groups."""
    facts = [(f"k{k}", f"f{n}", f"2024-01-{n + 1:02d} 00:00:00", "x") for k in range(100) for n in range(20)]
    folder = written(spark, str(tmp_path), [facts, [("z", "end", "2030-01-01 00:00:00", None)]])

    def of(**groups):
        rows = timeline.timeline(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder), F.col("who"), F.col("id"), "at", F.col("what"), "1 day", **groups)
        name = f"spans_{len(groups)}"
        job = rows.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        job.awaitTermination()
        return spans(spark.table(name)), max(p["stateOperators"][0]["numRowsUpdated"] for p in job.recentProgress)

    by_default, updated = of()
    assert updated <= 100 and len(by_default) == 100 * 19
    in_groups, updated = of(groups=8)
    assert updated <= 8 and in_groups == by_default


def test_nulls(spark, tmp_path):
    """Facts without a key have a timeline of their own, a null id comes last, facts without a time are left out."""
    batches = [
        [(None, "1", "2024-01-01 00:00:00", "p"), ("a", None, "2024-01-01 00:00:00", "q"), ("a", "2", "2024-01-01 00:00:00", None), ("a", "3", None, "no time")],
        [(None, "4", "2024-01-02 00:00:00", None), ("a", "5", "2024-01-02 00:00:00", "r"), ("a", "6", None, "no time")],
        [("z", "end", "2024-02-01 00:00:00", None)],
    ]
    got = run(spark, written(spark, str(tmp_path), batches), "3 days").collect()
    day = {(r.key, r.id): (r.value, r.start.day, r.end.day) for r in got}
    assert day == {(None, "1"): ("p", 1, 2), ("a", "2"): (None, 1, 1), ("a", None): ("q", 1, 2)} and len(got) == 3
