"""Structured Streaming forms: windowed event counts and incremental ingestion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from braidgraph.operators.embed import Encoder, embed_corpus, hashing_encoder
from braidgraph.operators.ingest import ingest
from braidgraph.plans.lineage import shared_folder
from braidgraph.schema import LEDGER

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of a folder as a stream, whether it is one file or a folder of files."""
    # a pattern, as a stream takes a plain path for a folder; a filter by name would leave out a folder's files
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table of a folder as a stream, its time cast so that it can be watermarked."""
    return table_stream(spark, folder, "events", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: Column, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and user, closed by a watermark."""
    out = events.withWatermark("ts", delay).groupBy(window.alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("w_start"), F.col("w.end").cast("timestamp_ntz").alias("w_end"), "n", F.round("total", 4).alias("total"))


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return windowed(events, F.window("ts", size))


def sliding(events: DataFrame, size: str = "1 day", slide: str = "12 hours") -> DataFrame:
    return windowed(events, F.window("ts", size, slide))


def session(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return windowed(events, F.session_window("ts", gap))


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what there is and read its output back from the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    job = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def ingest_stream(spark: SparkSession, root: str, ledger_path: str, now: str, on_progress: Callable[[int, dict[str, int]], None] | None = None):
    """Ingest new files under ``root`` as they come; each batch joins the ledger of the batches
    before it and writes its outcomes, with their texts beside it, as a partition of its own.

    A batch that was written but not yet marked as done when its driver was lost runs
    again: it sees the same files and the same earlier batches, never its own first
    output, and replaces that with the same rows. So each file counts exactly once.

    ``on_progress`` is called with each batch's number and its counts by outcome, which
    are observed while the batch is written, without another job.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    ledger = f"{ledger_path}/ledger"

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        known = own.read.schema(f"{LEDGER.toDDL()}, batch long").parquet(ledger).where(F.col("batch") < number).drop("batch") if number else None
        seen = Observation()
        counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ingested", "skipped", "failed")]
        out = ingest(rows.select("path", "content"), known, now).observe(seen, *counts)
        out.write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        if on_progress is not None:
            on_progress(number, dict(seen.get))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{ledger_path}/state").trigger(availableNow=True).start()


def embed_stream(texts: DataFrame, path: str, make: Callable[[], Encoder] = hashing_encoder, prefix: str = ""):
    """Embed a stream of texts (pos, text, ...) as it comes, each batch a shard under ``path``.

    A shard is named by its batch and replaced whole, so one that was written before its
    driver was lost is written again, and each row counts once. ``read_shards`` gives
    the rows; their order is that of ``pos``, whichever batch brought them.
    """

    def batch(rows: DataFrame, number: int) -> None:
        embed_corpus(rows, make, prefix).sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/shards/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The embedded rows of all shards, without the batch they came in."""
    return spark.read.parquet(f"{path}/shards").drop("batch")
