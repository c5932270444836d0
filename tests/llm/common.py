"""Frames that every operator must survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"w{i % 977} " * 3 for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, rank int, part int, token string, block int, `__d` int, `__t` int, `__row` int, `__k` int, spans string, r int, n int"


def edge_rows() -> list[tuple]:
    same = "the same line of seven words here\nand another line of some more words\n"
    texts = [(1, None), (2, ""), (3, "one"), (None, "a row without an id but with words"), (4, LONG), (5, same), (5, same), (6, same), (7, "\n\n \t"), (8, "ünï çødé ß 漢字 " * 8), (None, None)]
    return [(i, t, "en" if k % 2 else None, None if k % 3 else "s", k, k, "x", k, k, "t", k, k, k, k, k, "s", k, k) for k, (i, t) in enumerate(texts)]


def edge_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
