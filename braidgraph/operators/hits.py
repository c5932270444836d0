"""Retrieval hits: projection, content hydration and context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("kg_name", "kg_kind", "node_id", "name", "kind", "score", "summary", "source_path")


def project(hits: DataFrame, diary_timestamp: bool = False) -> DataFrame:
    """The eight fields of a hit, score to four digits; diary hits may carry their name as time."""
    out = hits.select(*(F.round("score", 4).alias("score") if c == "score" else c for c in FIELDS))
    if diary_timestamp:
        out = out.withColumn("timestamp", F.when(F.lower("kg_kind").endswith("diary"), F.col("name")))
    return out


def hydrate(hits: DataFrame, content: DataFrame) -> DataFrame:
    """Hits with ``content`` by (kg_name, id): empty for unknown ids, null for unknown stores."""
    stores = content.select("kg_name").distinct().withColumn("known", F.lit(True))
    texts = content.select("kg_name", F.col("id").alias("node_id"), F.col("text").alias("content"))
    joined = hits.join(texts, ["kg_name", "node_id"], "left").join(stores, "kg_name", "left")
    return joined.withColumn("content", F.when(F.col("known"), F.coalesce("content", F.lit("")))).drop("known")


def synthesize(snippets: DataFrame, question: str, complete, max_k: int = 8) -> str | None:
    """The answer of ``complete(question, context)``; None if no snippet has content or it fails."""
    row = context(snippets, max_k).first()
    if not row or not row["context"]:
        return None
    try:
        return complete(question, row["context"])
    except Exception:  # an answer is optional, whatever a remote model raises
        return None


def context(snippets: DataFrame, max_k: int) -> DataFrame:
    """One row: the first ``max_k`` snippets (pos, genre, author, title, content) that are
    not blank, each under a header, in order. Bounded by ``max_k``."""
    top = snippets.orderBy("pos").limit(max_k).where(F.trim(F.coalesce("content", F.lit(""))) != "")
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    block = F.concat(F.lit("["), F.concat_ws(" · ", given("genre"), given("author"), given("title")), F.lit("]\n"), F.trim("content"))
    rows = F.sort_array(F.collect_list(F.struct("pos", block.alias("block"))))
    return top.agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias("context"))
