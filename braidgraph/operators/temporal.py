"""Interval joins over temporal spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ratio of the widths of a level's buckets to those of the level below: few levels, and a bucket still
#: is no wider than so many times what lies in it.
STEP = 8


def overlap_join(left: DataFrame, right: DataFrame, seconds_wide: float | None = None) -> DataFrame:
    """Pairs (left_id, right_id) whose closed intervals (id, start, end) overlap.

    An interval without start or end is open on that side; one that ends before it
    starts overlaps nothing. An interval has a level, so that buckets of the base width times
    8 to the level hold its length, and touches two buckets of its level at most. Two
    intervals meet in a bucket of the higher of their levels, so each is dealt out to
    its own level and to the higher ones that occur, not to all buckets of a fixed size
    that it covers. A pair is reported only in the first bucket it shares.

    The base width, unless given, is the tenth percentile of the lengths, so that buckets are
    hardly wider than what lies in them.
    """
    seconds = lambda c: F.unix_micros(F.col(c)) / 1e6
    ends = lambda df: df.select(F.least(F.col("start"), F.col("end")).alias("low"), F.greatest(F.col("start"), F.col("end")).alias("high"), (seconds("end") - seconds("start")).alias("length"))
    short = F.percentile_approx(F.when(F.col("length") >= 0, F.col("length")), 0.1)
    span = ends(left).unionByName(ends(right)).agg(F.min("low").alias("least"), F.max("high").alias("most"), short.alias("short"))
    if seconds_wide is None:
        seconds_wide = span.first().short
    width = max(1e-3, float(seconds_wide or 0))
    span = F.broadcast(span.select("least", "most"))

    def levelled(df: DataFrame, side: str) -> DataFrame:
        closed = df.select("id", "start", "end").crossJoin(span).select("id", F.coalesce("start", "least").alias("start"), F.coalesce("end", "most").alias("end"))
        closed = closed.where("start <= end")
        level = F.greatest(F.lit(0), F.ceil(F.log(float(STEP), F.greatest(F.lit(1.0), (seconds("end") - seconds("start")) / F.lit(width))) - 1e-9)).cast("int")
        return closed.select(F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), level.alias(f"{side}_level"))

    a, b = levelled(left, "left"), levelled(right, "right")
    # levels that occur: a few dozen numbers at most
    levels = [r[0] for r in a.select("left_level").distinct().union(b.select("right_level").distinct()).distinct().orderBy("left_level").collect()]

    def dealt(df: DataFrame, side: str) -> DataFrame:
        own = F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda x: x >= F.col(f"{side}_level"))
        at = lambda c: F.floor(seconds(f"{side}_{c}") / (F.lit(width) * F.pow(F.lit(float(STEP)), F.col("level")))).cast("long")
        rows = df.withColumn("level", F.explode(own)).withColumns({f"{side}_first": at("start"), f"{side}_last": at("end")})
        return rows.withColumn("bucket", F.explode(F.sequence(f"{side}_first", f"{side}_last")))

    both = dealt(a, "left").join(dealt(b, "right"), ["level", "bucket"])
    met = (F.col("level") == F.greatest("left_level", "right_level")) & (F.col("bucket") == F.greatest("left_first", "right_first"))
    return both.where(met & F.expr("left_start <= right_end and right_start <= left_end")).select("left_id", "right_id")
