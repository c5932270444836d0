"""Reading metric tables back: ranks, percentiles, scaling, selection for display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.plans.lineage import numbered, scalar

_LOG_EPSILON = 1e-9
SEED_FRACTION = 4


def available(tables: list[DataFrame]) -> DataFrame:
    """(table_ord, metric, n) of each table in order of preference."""
    out = None
    for i, t in enumerate(tables):
        own = t.groupBy("metric").agg(F.count("*").alias("n")).select(F.lit(i).alias("table_ord"), "metric", "n")
        out = own if out is None else out.unionByName(own)
    return out.orderBy("table_ord", F.desc("n"), "metric")


def load(tables: list[DataFrame], metric: str) -> DataFrame:
    """(node_id, score) of a metric from the first table that has it."""
    every = None
    for i, t in enumerate(tables):
        own = t.where(F.col("metric") == metric).select("node_id", "score", F.lit(i).alias("table_ord"))
        every = own if every is None else every.unionByName(own)
    return every.crossJoin(scalar(every, F.min("table_ord").alias("first"))).where("table_ord = first").select("node_id", "score")


def ranked(scores: DataFrame) -> DataFrame:
    """``scores`` (node_id, score) with rank from 1 by score, ties by id, and percentile."""
    out = numbered(scores, [F.desc("score"), F.asc("node_id")], "rank")
    n = scalar(scores, F.count("*").alias("n"))
    return out.crossJoin(n).withColumn("percentile", F.when(F.col("n") <= 1, 1.0).otherwise((F.col("n") - F.col("rank")) / (F.col("n") - 1))).drop("n")


def scaled(scores: DataFrame, lo: float, hi: float, scaler: str = "rank") -> DataFrame:
    """``ranked`` scores with ``scaled`` in [lo, hi]; the midpoint where all scores are equal."""
    rows = ranked(scores)
    if scaler == "rank":
        part: Column = F.col("percentile")
    else:
        rows = rows.crossJoin(scalar(scores, F.min("score").alias("least"), F.max("score").alias("most")))
        least, most, s = F.col("least"), F.col("most"), F.col("score")
        same = F.abs(most - least) <= 1e-9 * F.greatest(F.abs(most), F.abs(least))
        if scaler == "log":
            shift = _LOG_EPSILON - least
            spread = F.log(most + shift) - F.log(least + shift)
            value = F.when(spread <= 0, 0.5).otherwise((F.log(s + shift) - F.log(least + shift)) / spread)
        else:
            value = (s - least) / (most - least)
        part = F.when(same, 0.5).otherwise(value)
    return rows.withColumn("scaled", F.lit(lo) + part * F.lit(hi - lo))


def lookup(ids: DataFrame, scaled_scores: DataFrame, lo: float, hi: float, default: float | None = None) -> DataFrame:
    """``scaled`` of each id; unscored ids get the default or the midpoint."""
    miss = (lo + hi) / 2 if default is None else default
    return ids.join(scaled_scores.select("node_id", "scaled"), "node_id", "left").withColumn("scaled", F.coalesce("scaled", F.lit(miss)))


def select_for_display(nodes: DataFrame, edges: DataFrame, scores: DataFrame | None, limit: int, mode: str = "central", expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """At most ``limit`` nodes: the highest-ranked quarter, their neighbours, then the rest by rank.

    ``expand`` gives other neighbours (id) of the seeds (id) than the ends of their edges.
    """
    order = [F.asc_nulls_first("module_path"), F.asc_nulls_first("lineno"), F.asc("id")]
    if nodes.limit(limit + 1).count() <= limit:
        return nodes
    if mode != "central" or scores is None:
        return nodes.orderBy(*order).limit(limit)
    with_rank = nodes.join(ranked(scores).select(F.col("node_id").alias("id"), "rank"), "id", "left")
    by_rank = [F.asc_nulls_last("rank"), F.asc("id")]
    seeds = with_rank.orderBy(*by_rank).limit(max(1, limit // SEED_FRACTION)).select("id")
    if expand is not None:
        near = expand(seeds).select("id").distinct()
    else:
        ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(F.broadcast(seeds.withColumnRenamed("id", "a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    tiers = with_rank.join(seeds.withColumn("is_seed", F.lit(True)), "id", "left").join(near.withColumn("is_near", F.lit(True)), "id", "left")
    tiers = tiers.withColumn("tier", F.when(F.col("is_seed"), 0).when(F.col("is_near"), 1).otherwise(2))
    return tiers.orderBy("tier", *by_rank).limit(limit).select(*nodes.columns, "tier")
