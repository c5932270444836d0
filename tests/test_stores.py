"""Stores: writes in proportion to the batch, versions that can't be lost, merging and removal."""

from __future__ import annotations

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidgraph.operators import ivf
from braidgraph.operators import vectors as V
from braidgraph.operators.graph import upsert
from braidgraph.sources import tables as S
from braidgraph.sources.tables import Conflict, GraphTables, IngestStore, VectorTables


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def vectors(spark, ids, kind="k", at=0.0):
    return spark.createDataFrame([(f"n{i}", kind, [float(i), at, 1.0]) for i in ids], "id string, kind string, vector array<float>")


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.fixture
def store(spark, tmp_path):
    return VectorTables(spark, f"file://{tmp_path}/v")


def test_writes_follow_the_batch(spark, store, tmp_path):
    store.upsert(vectors(spark, range(20_000)))
    before = size(tmp_path)
    store.upsert(vectors(spark, range(0, 20_000, 100), "new"))
    assert size(tmp_path) - before < 0.05 * before
    before = size(tmp_path)
    assert store.delete_ids(spark.createDataFrame([("n7",), ("n100",), ("none",), ("",), (None,)], "id string")) == 2
    assert size(tmp_path) - before < 0.05 * before
    got = {r["id"]: r["kind"] for r in rows(store.rows.select("id", "kind"))}
    assert len(got) == 19_998 and "n7" not in got and "n100" not in got and got["n200"] == "new" and got["n1"] == "k"
    store.upsert(vectors(spark, [7], "back"))
    assert {r["id"]: r["kind"] for r in rows(store.rows.where("kind = 'back'"))} == {"n7": "back"}
    plan = store.rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the base is not shuffled


def test_deltas_are_merged_when_due(spark, store, monkeypatch):
    monkeypatch.setattr(S, "DELTAS", 3)
    store.upsert(vectors(spark, range(2000)))
    for i in range(9):
        store.upsert(vectors(spark, [i, i + 1], f"k{i}"))
        own = store.state()[1]["vectors"]
        assert len(own["base"]) == 1 and len(own["deltas"]) <= 3
    want = {f"n{i}": f"k{i}" for i in range(9)} | {"n9": "k8"}
    got = {r["id"]: r["kind"] for r in rows(store.rows.select("id", "kind"))}
    assert len(got) == 2000 and {i: k for i, k in got.items() if k != "k"} == want
    store.upsert(vectors(spark, range(5), "only"), wipe=True)
    assert store.count() == 5


def test_two_writers_lose_nothing(spark, store):
    """Both take up the same version; the one that is second tries again."""
    store.upsert(vectors(spark, range(3)))
    other, meet, failed = VectorTables(spark, store.root), threading.Barrier(2, timeout=60), []

    def write(own, ids):
        plain, first = own.state, [True]

        def state():
            got = plain()
            if first[0]:
                first[0] = False
                meet.wait()  # until the other has read the same
            return got

        own.state = state
        try:
            own.upsert(vectors(spark, ids, "new"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)
        own.state = plain

    both = [threading.Thread(target=write, args=a) for a in ((store, [10, 1]), (other, [11, 2]))]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert not failed
    assert {r["id"]: r["kind"] for r in rows(store.rows.select("id", "kind"))} == {"n0": "k", "n1": "new", "n2": "new", "n10": "new", "n11": "new"}
    with pytest.raises(Conflict):
        store._publish(store.state()[0], {})


def test_a_failed_write_leaves_the_version(spark, store):
    store.upsert(vectors(spark, range(3)))
    number = store.state()[0]
    broken = vectors(spark, range(3)).withColumn("kind", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.upsert(broken)
    assert store.state()[0] == number and store.count() == 3


def test_merging_keeps_what_comes_meanwhile(spark, store, monkeypatch):
    monkeypatch.setattr(S, "SHARE", 100)
    store.upsert(vectors(spark, range(100)))
    store.upsert(vectors(spark, [1], "late"))
    plain = store._written

    def written(df, keys=()):
        out = plain(df, keys)
        store._written = plain
        store.upsert(vectors(spark, [2], "later"))  # between the merge's reading and its publishing
        return out

    store._written = written
    store.compact("vectors")
    own = store.state()[1]["vectors"]
    assert len(own["base"]) == 1 and len(own["deltas"]) == 1
    assert {r["id"]: r["kind"] for r in rows(store.rows.where("kind != 'k'"))} == {"n1": "late", "n2": "later"} and store.count() == 100


def test_vacuum_removes_what_no_version_lists(spark, store, tmp_path):
    for i in range(3):
        store.upsert(vectors(spark, range(10), f"k{i}"), wipe=True)
    held = lambda: len(os.listdir(tmp_path / "v" / "data"))
    assert held() == 3 and store.vacuum() == 0  # young ones may belong to a write that is on its way
    assert store.vacuum(keep=1, older_than=0) == 2 and held() == 1 and store.count() == 10
    assert os.listdir(tmp_path / "v" / "aside") == []


def test_graph_writes_are_one_version(spark, tmp_path):
    t = GraphTables(spark, f"file://{tmp_path}/g")
    n = lambda *x: spark.createDataFrame([(*y, None, None, None, None, None, None) for y in x], t.TABLES["nodes"][0])
    e = lambda *x: spark.createDataFrame(list(x), t.TABLES["edges"][0])
    t.write(n(("a", "k", "A"), ("b", "k", "B")), e(("a", "R", "b", None, 1.0)))
    assert t.state()[0] == 1
    t.write(n(("b", "k", "B2")), e(("b", "R", "a", None, 2.0), ("a", "R", "b", "x", 3.0)))
    assert {r["id"]: r["name"] for r in rows(t.nodes)} == {"a": "A", "b": "B2"}
    assert {(r["src"], r["dst"]): (r["evidence"], r["weight"]) for r in rows(t.edges)} == {("a", "b"): ("x", 3.0), ("b", "a"): (None, 2.0)}


def test_ingestion_that_loses_a_race_is_made_again(spark, tmp_path):
    files = lambda *f: spark.createDataFrame([(p, b.encode()) for p, b in f], "path string, content binary")
    store, other = (IngestStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    plain, seen = store._publish, []

    def publish(number, state):
        if not seen:
            seen.append(other.run(files(("x/a.md", "same"), ("x/b.md", "b")), "t1", update=True).first().ingested)
        plain(number, state)

    store._publish = publish
    out = rows(store.run(files(("y/a.md", "same"), ("y/b.md", "c")), "t2", update=True))[0]
    assert seen == [2] and out["ingested"] == 1 and out["skipped"] == 1
    assert sorted(r["text"] for r in rows(store.staged)) == ["b", "c", "same"] and store.ledger.count() == 4
    assert len({r["staged_path"] for r in rows(store.staged)}) == 3


def test_upsert_orders_and_types(spark):
    old = spark.createDataFrame([("a", "stored", {"x": 1}), ("b", "stored", None)], "id string, name string, m map<string,int>")
    new = spark.createDataFrame([("a", "null order", {"y": 2}, None), ("c", "second", None, 2), ("c", "third", {"z": 3}, 3), ("c", "first", None, None)], "id string, name string, m map<string,int>, seq long")
    got = {r["id"]: (r["name"], r["m"]) for r in rows(upsert(old, new, ["id"], "seq"))}
    assert got == {"a": ("null order", {"y": 2}), "b": ("stored", None), "c": ("third", {"z": 3})}


# ---- approximate index ----


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """20,000 vectors in 150 clusters, and an index over them, written and read back."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 32))[rng.integers(0, 150, 20_000)] + 0.3 * rng.normal(size=(20_000, 32))
    df = spark.createDataFrame([(f"n{i}", i % 7, v) for i, v in enumerate(x.tolist())], "id string, kind int, vector array<float>")
    folder = str(tmp_path_factory.mktemp("ivf"))
    df.write.parquet(f"{folder}/rows")
    df = spark.read.parquet(f"{folder}/rows")
    ivf.save(ivf.build(df), f"{folder}/index")
    return df, ivf.load(spark, f"{folder}/index")


def test_every_row_has_a_cell_and_codes(clustered):
    df, index = clustered
    assert index.cells == 141 and index.codewords.shape == (2, 256, 16)
    got = index.rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("cell").alias("low"), F.max("cell").alias("high"), F.min(F.size("codes")).alias("m")).first()
    assert (got.n, got.d, got.m) == (20_000, 20_000, 2) and got.low >= 0 and got.high < index.cells


def test_recall_and_share_of_rows(spark, clustered):
    df, index = clustered
    queries = df.where("cast(substr(id, 2) as int) % 200 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    near = lambda d: d.groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    exact = {r.query_id: set(r.ids) for r in near(V.search_many(df, queries, 10)).collect()}
    found = {r.query_id: set(r.ids) for r in near(ivf.search_many(index, queries, 10)).collect()}
    assert len(exact) == 100 and all(len(x) == 10 for x in found.values())
    assert sum(len(exact[q] & found[q]) for q in exact) >= 0.95 * 1000
    scored = ivf.meetings(index, queries, 10).agg(F.sum("scored")).first()[0]
    assert scored < 0.25 * 100 * 20_000
    # all cells, and more than all rows compared exactly: the exact result, distances and ranks included
    every = ivf.search_many(index, queries.limit(5), 10, probes=index.cells, refine=2000)
    same = lambda d: {(r.query_id, r.id, r["rank"]): r._distance for r in d.collect()}
    a, b = same(every), same(V.search_many(df, queries.limit(5), 10))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_probes_follow_the_data(spark, clustered):
    df, index = clustered
    assert ivf.probes_for(index, 10, 0.95) <= index.cells // 8
    # vectors without structure lie in many cells; the share that was asked for is still found
    plain = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.concat(F.lit("n"), "vec_id").alias("id"), F.col("embedding").alias("vector"))
    loose = ivf.build(plain, cells=20)
    probes = ivf.probes_for(loose, 10, 0.95)
    assert probes > 5
    queries = plain.where("cast(substr(id, 2) as int) % 10 = 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    pairs = lambda d: {(r.query_id, r.id) for r in d.collect()}
    exact, found = pairs(V.search_many(plain, queries, 10)), pairs(ivf.search_many(loose, queries, 10, probes))
    assert len(exact & found) >= 0.9 * len(exact)


def test_one_query_reads_few_cells(spark, clustered):
    df, index = clustered
    q = df.where("id = 'n77'").first().vector
    got = rows(ivf.search(index, q, 5))
    assert got[0]["id"] == "n77" and [r["rank"] for r in got] == [0, 1, 2, 3, 4] and set(got[0]) == {"id", "kind", "vector", "_distance", "rank"}
    kept = rows(ivf.search(index, q, 5, "kind = 3"))
    assert len(kept) == 5 and all(r["kind"] == 3 for r in kept)
    # a filter that the probed cells can't satisfy goes to all rows
    far = rows(ivf.search(index, q, 2, "id in ('n1', 'n2')", probes=1))
    assert {r["id"] for r in far} == {"n1", "n2"}


def test_cells_and_queries_are_cut(spark, clustered, monkeypatch):
    df, index = clustered
    queries = df.where("cast(substr(id, 2) as int) % 500 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    whole = {(r.query_id, r.id) for r in ivf.search_many(index, queries, 3, refine=500).collect()}
    monkeypatch.setattr(ivf, "BLOCK", 50)
    monkeypatch.setattr(ivf, "ASKED", 2)
    assert {(r.query_id, r.id) for r in ivf.search_many(index, queries, 3, refine=500).collect()} == whole


def test_index_at_the_edges(spark, store):
    schema = "id string, kind string, vector array<float>"
    assert ivf.maybe_build(vectors(spark, range(5)), 6) is None and ivf.maybe_build(vectors(spark, range(5)), 0) is None
    odd = spark.createDataFrame([("a", "k", None), ("b", "k", [1.0]), ("c", "k", [0.0, 0.0]), ("d", "k", [1.0, 0.0]), ("e", "k", [1.0, 0.0]), ("f", "k", [float("nan"), 1.0])], schema)
    index = ivf.build(odd.where("id != 'f'"), cells=2)
    assert index.rows.count() == 5
    assert [r["id"] for r in rows(ivf.search(index, [1.0, 0.0], 2))] == ["d", "e"]
    empty = ivf.build(spark.createDataFrame([], schema))
    assert rows(ivf.search(empty, [1.0], 3)) == []


def test_a_store_uses_its_index_until_it_changes(spark, store):
    store.upsert(vectors(spark, range(300)))
    with pytest.raises(ValueError):
        store.search([1.0, 0.0, 0.0], 3, backend="ivf")
    assert not store.maybe_create_index(301) and store.maybe_create_index(300, cells=5)
    exact = [r["id"] for r in rows(store.search([5.0, 0.0, 1.0], 3, backend="exact"))]
    assert [r["id"] for r in rows(store.search([5.0, 0.0, 1.0], 3, backend="ivf"))] == exact
    assert store.vacuum(keep=1, older_than=0) >= 0 and [r["id"] for r in rows(store.search([5.0, 0.0, 1.0], 3))] == exact
    store.upsert(vectors(spark, [999], at=5.0))
    assert "index" not in store.state()[1] and rows(store.search([999.0, 5.0, 1.0], 1))[0]["id"] == "n999"
