"""Cutting lineage, and numbering rows in a global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where that is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="braid-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, removed at the end; what is read from it is to be checkpointed before."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove_folder(spark, path)


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """``df`` with its row numbers (from 1) in a global order.

    Rows are range-partitioned, sorted and counted off within their range; the ranges'
    sizes, one row each, move the numbers on. No task sees more than its range, and
    rows are shuffled once.
    """
    spark = df.sparkSession
    part, nth = f"__{name}_part", f"__{name}_nth"
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # the number's upper half is the partition, its lower half the place there, in sorted order
    at = F.monotonically_increasing_id()
    dealt = checkpointed(ranged.withColumn(nth, at).withColumn(part, F.shiftright(nth, 33)).withColumn(nth, F.col(nth).bitwiseAND(F.lit((1 << 33) - 1))))
    starts, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in dealt.groupBy(part).count().collect()):
        starts.append((p, total))
        total += n
    first = f"__{name}_first"
    before = spark.createDataFrame(starts, f"{part} long, {first} long")
    return dealt.join(F.broadcast(before), part).withColumn(name, F.col(first) + F.col(nth) + 1).drop(part, nth, first)


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", size: str | None = None) -> DataFrame:
    """``df`` with row numbers (from 1) inside the groups of ``keys``, and the groups' sizes if named.

    The numbers are those of the global order less the group's first, so a group that
    holds a large share of all rows is numbered by many tasks.
    """
    first = f"__{name}_first"
    rows = numbered(df, [*(F.asc(k) for k in keys), *order], name)
    groups = rows.groupBy(*keys).agg(F.min(name).alias(first), *([F.count("*").alias(size)] if size else []))
    return rows.join(groups, keys).withColumn(name, F.col(name) - F.col(first) + 1).drop(first)


def carried(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null at or before each row in a global order.

    Rows are range-partitioned and sorted; values are carried on inside each range, and
    from range to range by one row each, so no task sees more than its range.
    """
    spark = df.sparkSession
    part, nth, into = f"__{name}_part", f"__{name}_nth", f"__{name}_into"
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    dealt = checkpointed(ranged.withColumn(nth, at).withColumn(part, F.shiftright(nth, 33)).withColumn(nth, F.col(nth).bitwiseAND(F.lit((1 << 33) - 1))))
    lasts = dealt.where(F.col(value).isNotNull()).groupBy(part).agg(F.max_by(value, nth).alias("last")).collect()
    most = dealt.agg(F.max(part)).first()[0]
    held, ends, before = None, {r[0]: r[1] for r in lasts}, []
    for p in range(0 if most is None else most + 1):
        before.append((p, held))
        held = ends.get(p, held)
    schema = T.StructType([T.StructField(part, T.LongType()), T.StructField(into, df.schema[value].dataType)])
    inside = Window.partitionBy(part).orderBy(nth).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumn(name, F.last(value, ignorenulls=True).over(inside))
    return own.join(F.broadcast(spark.createDataFrame(before, schema)), part, "left").withColumn(name, F.coalesce(name, into)).drop(part, nth, into)


def scalar(df: DataFrame, *aggs: Column) -> DataFrame:
    """One row of aggregates, to cross with rows instead of a window over everything."""
    return F.broadcast(df.agg(*aggs))
