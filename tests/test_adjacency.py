"""Edges at rest: results as those of the joins over plain edges, and plans that leave the edges where they are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from braidgraph.operators import graph as G
from braidgraph.sources.adjacency import Adjacency


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """A graph with one node at a third of all edges, stored with few edges to a key."""
    rnd = random.Random(2)
    rels = ("CALLS", "IMPORTS", "OTHER")
    pairs = {("hub" if rnd.random() < 0.33 else f"n{rnd.randrange(400)}", rnd.choice(rels), f"n{rnd.randrange(400)}") for _ in range(1500)}
    df = spark.createDataFrame([(*p, None, float(i)) for i, p in enumerate(sorted(pairs))], "src string, rel string, dst string, evidence string, weight double")
    stored = Adjacency.build(df, "adjacency_test", str(tmp_path_factory.mktemp("adj")), hub=50)
    yield df, stored
    stored.drop()


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_hubs_are_dealt(both):
    df, stored = both
    assert {r.node for r in stored.hubs.collect()} == {"hub"} and stored.hubs.first().cuts >= 8
    assert stored.edges.count() == 2 * df.count()
    assert stored.edges.groupBy("key").count().agg(F.max("count")).first()[0] < 120


@pytest.mark.parametrize("hop", [0, 1, 2, 3])
@pytest.mark.parametrize("seeds", [("n1", "n2", "nowhere"), ("hub",), ()])
def test_expansion_equals_that_over_plain_edges(spark, both, hop, seeds):
    df, stored = both
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(stored.expand(ids(spark, *seeds), hop, ["CALLS", "IMPORTS"])) == rows(G.expand(df, ids(spark, *seeds), hop, ["CALLS", "IMPORTS"]))


def test_edges_of_single_nodes(spark, both):
    df, stored = both
    for node in ("hub", "n7", "nowhere"):
        want = sorted(r.dst for r in G.edges_from(df, node, "CALLS").collect())
        assert sorted(r.dst for r in stored.edges_from(node, "CALLS").collect()) == want
        assert [r.dst for r in stored.edges_from(node, "CALLS", 2).collect()] == want[:2]
        assert sorted(r.id for r in stored.callers(node, "CALLS").collect()) == sorted(r.src for r in df.where((F.col("dst") == node) & (F.col("rel") == "CALLS")).collect())
    assert set(stored.edges_from("hub").columns) == set(df.columns)


def test_a_hop_does_not_shuffle_edges(spark, both):
    _, stored = both
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a frontier of any size
    try:
        step = stored.step(spark.range(1000).select(F.concat(F.lit("n"), "id").alias("node")), ["CALLS"])
        plan = step._jdf.queryExecution().executedPlan().toString()
        step.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    above, d = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < d:
            above.append(x)
            d = depth(x)
    join = next(i for i, x in enumerate(above) if "Join" in x)
    assert "Exchange" not in "".join(above[:join]), plan


def test_single_nodes_are_pushed_to_the_scan(both):
    _, stored = both
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,n7)]" in stored.of("n7")._jdf.queryExecution().executedPlan().toString()


def test_edges_are_not_sorted_by_name(spark, both):
    """Neither the writer nor a hop sorts edges by their names; a node's edges lie together all the same."""
    _, stored = both
    assert "[`key`]" not in {r.data_type for r in spark.sql("DESCRIBE EXTENDED adjacency_test").collect() if r.col_name == "Sort Columns"}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = stored.step(spark.range(1000).select(F.concat(F.lit("n"), "id").alias("node")), ["CALLS"])
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ShuffledHashJoin" in plan, plan  # the nodes and the hubs may be merged, the edges not
    rows = [r.key for r in spark.table("adjacency_test").select("key", F.spark_partition_id().alias("p")).collect()]
    runs = sum(a != b for a, b in zip(rows, rows[1:])) + 1
    assert runs == len(set(rows))
