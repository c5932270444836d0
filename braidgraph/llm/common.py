"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset and the master is local, as in tests, a local folder is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="braid-ckpt-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query that is made and runs inside as soon as it ends.

    A DataFrame takes the setting up when it is made, not when it runs. For jobs of many rounds, whose results are collected or checkpointed: else the files
    stay until the driver's JVM happens to collect what refers to them.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join for which both sides are dealt anew, so that adaptive execution can split
    the partitions of a key that holds a large share of ``left``.

    An aggregate's result is already partitioned by its keys, and a join that reuses
    that partitioning can't be split; the hash of the keys is a further join key that
    no side is partitioned by.
    """
    k = fresh(left, "__k")
    hashed = F.xxhash64(*on)
    return left.withColumn(k, hashed).join(right.withColumn(k, hashed), [*on, k], how).drop(k)


#: Bytes of an Arrow batch that a Python task is handed, at most (one row may exceed it).
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session bounded by bytes.

    The default number of rows in a batch, times the length of texts, is what a Python
    task and its JVM hold several times over.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(key).lower().rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df
