"""Cleaning and packing a corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns
is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from braidgraph.llm.common import checkpoint_folder, remove_folder, table
from braidgraph.llm.decontaminate import decontaminate
from braidgraph.llm.group_join import keep_representatives
from braidgraph.llm.language_id import keep_identified
from braidgraph.llm.line_dedup import dedup_lines
from braidgraph.llm.pack_exact import pack


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language the byte network recognises, and their language where it was null."""
    return keep_identified(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so do documents of which nothing is left."""
    return dedup_lines(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with similarity 0.8 or more."""
    return keep_representatives(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids, each with its place in a packed sequence."""
    return pack(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder, and
    goes when the next stage is written. The last one's stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs


#: Training, tokenising and planning have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
