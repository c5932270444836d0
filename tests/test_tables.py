from __future__ import annotations

import gzip
import hashlib
import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidgraph.operators import embed, hits, ingest, layout, scores, snapshots, temporal
from braidgraph.plans.lineage import numbered
from braidgraph.sources import caches, sqlite
from braidgraph.streaming import streams


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def metric(spark, values):
    return spark.createDataFrame(list(values.items()), "node_id string, score double")


def test_ranks_percentiles_and_scaling(spark):
    s = metric(spark, {"alpha": 0.4, "beta": 0.2, "gamma": 0.1, "delta": 0.05})
    got = {r["node_id"]: (r["rank"], r["percentile"]) for r in rows(scores.ranked(s))}
    assert got == {"alpha": (1, 1.0), "beta": (2, 2 / 3), "gamma": (3, 1 / 3), "delta": (4, 0.0)}
    tied = {r["node_id"]: r["rank"] for r in rows(scores.ranked(metric(spark, {"b": 1.0, "a": 1.0})))}
    assert tied == {"a": 1, "b": 2}
    for how in ("linear", "log"):
        assert {r["scaled"] for r in rows(scores.scaled(metric(spark, {"a": 2.0, "b": 2.0}), 8, 42, how))} == {25.0}
    lin = {r["node_id"]: r["scaled"] for r in rows(scores.scaled(s, 0, 1, "linear"))}
    assert lin["alpha"] == 1.0 and lin["delta"] == 0.0
    looked = {r["node_id"]: r["scaled"] for r in rows(scores.lookup(spark.createDataFrame([("alpha",), ("zz",)], "node_id string"), scores.scaled(s, 0, 1), 0, 1))}
    assert looked == {"alpha": 1.0, "zz": 0.5}
    assert rows(scores.ranked(metric(spark, {"x": 1.0})))[0]["percentile"] == 1.0
    assert scores.ranked(s.where("false")).count() == 0


def test_metric_tables(spark):
    a = spark.createDataFrame([("n", "x", 1.0)], "node_id string, metric string, score double")
    b = spark.createDataFrame([("n", "x", 2.0), ("m", "y", 3.0), ("n", "y", 1.0)], "node_id string, metric string, score double")
    assert [(r["table_ord"], r["metric"], r["n"]) for r in rows(scores.available([a, b]))] == [(0, "x", 1), (1, "y", 2), (1, "x", 1)]
    assert rows(scores.load([a, b], "x")) == [{"node_id": "n", "score": 1.0}] and scores.load([a, b], "y").count() == 2


def test_display_selection(spark):
    n = spark.createDataFrame([(f"n{i}", "m", i) for i in range(10)], "id string, module_path string, lineno int")
    e = spark.createDataFrame([("n7", "n3"), ("n9", "n7")], "src string, dst string")
    s = metric(spark, {f"n{i}": float(i == 7) * 5 + i / 10 for i in range(8)})
    assert [r["id"] for r in rows(scores.select_for_display(n, e, s, 4))] == ["n7", "n3", "n9", "n6"]
    assert scores.select_for_display(n, e, s, 10).count() == 10
    assert [r["id"] for r in rows(scores.select_for_display(n, e, None, 2))] == ["n0", "n1"]


def test_numbering_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    assert all(r["rn"] == r["v"] + 1 for r in rows(numbered(df, [F.asc("v")])))


def history(spark):
    data = [("a", "main", "2024-01", 10, 5, {"f": 10}), ("b", "dev", "2024-02", 10, 5, {"f": 10}), ("c", "main", "2024-03", 10, 5, {"f": 10}), ("d", "main", "2024-04", 15, 8, {"g": 15})]
    return spark.createDataFrame([(k, b, t, "1", n, e, c, {"CALLS": e}) for k, b, t, n, e, c in data], "key string, branch string, timestamp string, version string, total_nodes long, total_edges long, node_counts map<string,long>, edge_counts map<string,long>")


def test_snapshots(spark):
    h = history(spark)
    d = {r["key"]: (r["nodes_vs_previous"], r["nodes_vs_baseline"]) for r in rows(snapshots.with_deltas(h))}
    assert d == {"a": (None, None), "b": (0, 0), "c": (0, 0), "d": (5, 5)}
    assert [r["key"] for r in rows(snapshots.listing(h, 0, "main"))] == ["d", "c", "a"] and len(rows(snapshots.listing(h, 2))) == 2
    got = {(r["section"], r["name"]): r["delta"] for r in rows(snapshots.diff(h, "a", "d"))}
    assert got == {("total", "nodes"): 5, ("total", "edges"): 3, ("node_counts", "f"): -10, ("node_counts", "g"): 15, ("edge_counts", "CALLS"): 3}
    assert [r["key"] for r in rows(snapshots.prune(h, ["version", "total_nodes"]))] == ["a", "d"]
    assert [r["key"] for r in rows(snapshots.prune(h.where("key != 'd'"), ["version", "total_nodes"]))] == ["a", "c"]
    assert rows(snapshots.previous(h, "2024-03"))[0]["key"] == "b"
    new = h.where("key = 'd'").withColumn("key", F.lit("e")).withColumn("timestamp", F.lit("2024-05"))
    assert {r["key"] for r in rows(snapshots.save(h, new, ["version", "total_nodes"]))} == {"a", "b", "c", "e"}
    assert snapshots.save(h, new, ["version", "total_nodes"], force=True).count() == 5
    with pytest.raises(ValueError):
        snapshots.save(h, new.withColumn("total_nodes", F.lit(0).cast("long")), ["version"])


def test_hits(spark):
    h = spark.createDataFrame([("kg", "My Diary", "n1", "2024", "k", 0.123456, "s", "p"), ("kg", "code", "n3", "x", "k", 0.5, "s", "p"), ("gone", "code", "n1", "x", "k", 0.5, "s", "p")], "kg_name string, kg_kind string, node_id string, name string, kind string, score double, summary string, source_path string")
    c = spark.createDataFrame([("kg", "n1", "text")], "kg_name string, id string, text string")
    got = {(r["kg_name"], r["node_id"]): r["content"] for r in rows(hits.hydrate(h, c))}
    assert got == {("kg", "n1"): "text", ("kg", "n3"): "", ("gone", "n1"): None}
    p = rows(hits.project(h, True))
    assert p[0]["score"] == 0.1235 and [r["timestamp"] for r in p] == ["2024", None, None]
    s = spark.createDataFrame([(0, "poem", "", "T", " a "), (1, "x", "A", "", " "), (2, None, "B", None, "b"), (3, "q", "q", "q", "cut")], "pos int, genre string, author string, title string, content string")
    assert rows(hits.context(s, 3))[0]["context"] == "[poem · T]\na\n\n[B]\nb"
    assert hits.synthesize(s, "q", lambda q, c: f"{q}:{len(c)}", 3) == "q:19" and hits.synthesize(s.where("pos = 1"), "q", lambda q, c: c) is None
    assert hits.synthesize(s, "q", lambda q, c: 1 / 0) is None


def test_ingestion_of_files(spark, tmp_path):
    (tmp_path / "nested" / ".hidden").mkdir(parents=True)
    for name, body in {"guide.md": "# g", "notes.txt": "n", "data.csv": "a,b\n1,2\n", "nested/deep.md": "d", "photo.jpeg": "x", "copy.md": "# g", "nested/guide.md": "other", "empty.csv": "\n", "paper.pdf": "%PDF", "nested/.hidden/x.md": "no"}.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "notes.txt").write_bytes(b"n\xff")
    files = caches.read_files(spark, str(tmp_path))
    out = {r["source_path"]: r for r in rows(ingest.ingest(files, None, "2024-01-01T00:00:00"))}
    assert len(out) == 9
    assert {p for p, r in out.items() if r["status"] == "ingested"} == {"copy.md", "notes.txt", "data.csv", "nested/deep.md", "nested/guide.md"}
    assert out["guide.md"]["status"] == "skipped" and "copy.md" in out["guide.md"]["reason"] and out["photo.jpeg"]["status"] == "skipped"
    assert {p for p, r in out.items() if r["status"] == "failed"} == {"empty.csv", "paper.pdf"}
    assert out["data.csv"]["text"] == "| a | b |\n| --- | --- |\n| 1 | 2 |\n" and out["data.csv"]["staged_path"] == "data.md"
    assert out["notes.txt"]["sha256"] == hashlib.sha256(b"n\xff").hexdigest() and out["notes.txt"]["text"] == "n\ufffd"
    ledger = ingest.ingest(files, None, "t").drop("text")
    assert rows(ingest.summary(ledger))[0] == {"ingested": 5, "skipped": 2, "failed": 2, "total": 9}
    again = ingest.ingest(files, ledger, "t2")
    assert rows(ingest.summary(again))[0]["ingested"] == 0
    assert [r["source_path"] for r in rows(ingest.problems(ledger))] == ["empty.csv", "guide.md", "paper.pdf", "photo.jpeg"]


def test_ingest_store(spark, tmp_path):
    from braidgraph.sources.tables import IngestStore

    files = lambda *f: spark.createDataFrame([(p, b.encode()) for p, b in f], "path string, content binary")
    store = IngestStore(spark, f"file://{tmp_path}/s")
    assert rows(store.run(files(("a.md", "one"), ("b.md", "one"), ("c.x", "?")), "t"))[0] == {"ingested": 1, "skipped": 2, "failed": 0, "total": 3}
    assert rows(store.run(files(("a.md", "one"), ("d.txt", "two")), "t2", update=True))[0] == {"ingested": 1, "skipped": 1, "failed": 0, "total": 2}
    assert {(r["staged_path"], r["text"]) for r in rows(store.staged)} == {("a.md", "one"), ("d.txt", "two")} and store.ledger.count() == 5
    store.run(files(("z.md", "z")), "t3")
    assert store.ledger.count() == 1
    custom = ingest.ingest(files(("p.pdf", "x"), ("q.md", "y")), None, "t", {".pdf": lambda c: F.upper(c.cast("string"))})
    assert {r["source_path"]: (r["status"], r["text"]) for r in rows(custom)} == {"p.pdf": ("ingested", "X"), "q.md": ("skipped", None)}
    assert ".pdf" in ingest.supported_suffixes()


def test_staged_names_collide(spark):
    f = spark.createDataFrame([("a/my file!.md", "11111111aa", ".md"), ("b/my file!.md", "22222222bb", ".md"), ("c/my-file-22222222.md", "33", ".md"), ("d/...md", "44", ".md")], "path string, sha256 string, out_suffix string")
    got = {r["path"]: r["staged_path"] for r in rows(ingest.staged_names(f))}
    assert got["a/my file!.md"] == "my-file.md" and got["d/...md"] == "document.md" and len(set(got.values())) == 4


def test_incremental_ingestion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one")
    streams.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), "t").awaitTermination()
    (tmp_path / "in" / "b.md").write_text("one")
    (tmp_path / "in" / "c.md").write_text("two")
    streams.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), "t").awaitTermination()
    got = {r["source_path"].rpartition("/")[2]: r["status"] for r in rows(spark.read.parquet(str(tmp_path / "out" / "ledger")))}
    assert got == {"a.md": "ingested", "b.md": "skipped", "c.md": "ingested"}


@pytest.mark.parametrize("lost", [0, 1])
def test_a_replayed_batch_loses_nothing(spark, tmp_path, lost):
    """The driver goes after a batch is written and before it is marked as done."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    run = lambda: streams.ingest_stream(spark, str(source), str(out), "t").awaitTermination()
    (source / "a.txt").write_text("alpha")
    run()
    if lost:
        (source / "b.txt").write_text("beta")
        run()
    seen = lambda: {r["source_path"].rpartition("/")[2]: (r["status"], r["staged_path"], r["text"]) for r in rows(spark.read.parquet(str(out / "ledger")))}
    before = seen()
    for mark in (out / "state" / "commits").glob(f"*{lost}*"):
        mark.unlink()
    (source / "c.txt").write_text("gamma")  # of the next batch
    run()
    after = seen()
    assert before == {k: v for k, v in after.items() if k != "c.txt"} and after["c.txt"] == ("ingested", "c.txt", "gamma")
    assert after["a.txt"][2] == "alpha" and (not lost or after["b.txt"] == ("ingested", "b.txt", "beta"))
    assert spark.read.parquet(str(out / "ledger")).count() == len(after)


def test_progress_is_observed(spark, tmp_path):
    told = []
    for i, body in enumerate((("a.md", "one"), ("b.md", "one"), ("c.xyz", "two"))):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / body[0]).write_text(body[1])
        streams.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), "t", lambda n, counts: told.append((n, counts))).awaitTermination()
    assert told == [(0, {"ingested": 1, "skipped": 0, "failed": 0}), (1, {"ingested": 0, "skipped": 1, "failed": 0}), (2, {"ingested": 0, "skipped": 1, "failed": 0})]


@pytest.mark.parametrize("lost", [0, 1])
def test_embedded_shards_have_each_row_once(spark, tmp_path, lost):
    """The driver goes between a shard's writing and its mark; the batch runs again over what is there."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    rows_of = lambda n: spark.createDataFrame([(10 * i + n, f"text {i} of {n}" if i else None) for i in range(5)], "pos long, text string").coalesce(1)
    def run():
        texts = spark.readStream.schema("pos long, text string").parquet(str(source))
        streams.embed_stream(texts, out).awaitTermination()
    for n in range(2):
        rows_of(n).write.mode("append").parquet(str(source))
        run()
    for mark in (tmp_path / "out" / "state" / "commits").iterdir():
        if mark.name.lstrip(".").partition(".")[0] in [str(k) for k in range(lost, 2)]:
            mark.unlink()
    if not lost:  # of two batches without a mark Spark replays the last; the first is whole
        assert streams.read_shards(spark, out).count() == 10
    rows_of(2).write.mode("append").parquet(str(source))
    run()
    got = streams.read_shards(spark, out).orderBy("pos").collect()
    assert [r.pos for r in got] == sorted(10 * i + n for i in range(5) for n in range(3))
    want = embed.hashing_encoder()([r.text or "" for r in got])
    assert np.allclose([r.vector for r in got], want)


def test_names_of_earlier_batches_are_kept(spark, tmp_path):
    for i, text in enumerate(("one", "two", "two", "three")):
        (tmp_path / "in" / str(i)).mkdir(parents=True)
        (tmp_path / "in" / str(i) / "x.md").write_text(text)
        streams.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), "t").awaitTermination()
    got = sorted((r["source_path"].split("/")[-2], r["status"], r["staged_path"]) for r in rows(spark.read.parquet(str(tmp_path / "out" / "ledger"))))
    assert [g[:2] for g in got] == [("0", "ingested"), ("1", "ingested"), ("2", "skipped"), ("3", "ingested")]
    names = [g[2] for g in got if g[2]]
    assert names[0] == "x.md" and len(set(names)) == 3 and all(n.startswith("x-") for n in names[1:])


def test_safe_join():
    assert caches.safe_join("/r", "a/../b") == "/r/b"
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            caches.safe_join("/r", bad)


def test_embedding(spark):
    d = spark.createDataFrame([(i, f"word{i} text") for i in range(10)] + [(10, None)], "pos long, text string")
    got = sorted(rows(embed.embed_corpus(d)), key=lambda r: r["pos"])
    assert len(got) == 11 and abs(np.linalg.norm(got[0]["vector"]) - 1) < 1e-6 and not any(got[10]["vector"])
    assert np.allclose(got[3]["vector"], embed.hashing_encoder()(["word3 text"])[0])
    chosen = lambda n: [r["pos"] for r in rows(d.where(embed.sample_positions(F.col("pos"), 11, n)).orderBy("pos"))]
    assert chosen(3) == [0, 5, 10] and chosen(1) == [0] and len(chosen(50)) == 11
    n = spark.createDataFrame([("a", "f", "n", None, None, 1, "doc"), ("s", "symbol", "n", None, None, 1, None)], "id string, kind string, name string, qualname string, module_path string, lineno int, docstring string")
    built = embed.build_index(n, ["f"])
    assert [r["text"] for r in rows(built)] == ["KIND: f\nNAME: n\nLINE: 1\nDOCSTRING:\ndoc"]
    stale = built.withColumn("id", F.lit("old"))
    assert embed.build_index(n, ["f"], stale).count() == 2 and embed.build_index(n, ["f"], stale, sync=True).count() == 1


def test_caches(spark, tmp_path):
    whole = {"model": "m", "dim": 2, "texts": ["a", "b"], "vectors": [[1, 0], [0, 1]], "metadata": [{"k": "v"}, {}]}
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        json.dump(whole, f)
    got = sorted(rows(caches.read_cache(spark, str(tmp_path / "c.json.gz"))), key=lambda r: r["pos"])
    assert [(r["pos"], r["text"], r["metadata"]) for r in got] == [(0, "a", {"k": "v"}), (1, "b", {})]
    d = spark.createDataFrame([(1, "b", [0.0, 1.0]), (0, "a", [1.0, 0.0])], "pos long, text string, vector array<float>")
    caches.write_jsonl(d, str(tmp_path / "j"), "m", 2, "now")
    head, body = caches.read_jsonl(spark, f"{tmp_path}/j/*")
    assert rows(head)[0]["n_vectors"] == 2 and {r["id"]: r["text"] for r in rows(body)} == {"0": "a", "1": "b"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text(json.dumps({"tree_hash": "h", "branch": "b", "timestamp": "t", "metrics": {"total_nodes": 3, "x": {"y": 1}}}))
    assert [(r["key"], r["total_nodes"]) for r in rows(caches.read_snapshots(spark, str(tmp_path / "s")))] == [("h", 3)]


def test_staged_files_are_written_whole_or_not_at_all(spark, tmp_path):
    from braidgraph.sources import staging

    out, held = tmp_path / "out", lambda: {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    texts = spark.createDataFrame([("a.md", "one\r\n"), ("deep/b.txt", "zwei \u00fc"), ("c.md", None)], "staged_path string, text string").repartition(3)
    staging.write_staged(texts, str(out))
    assert held() == {"a.md": b"one\r\n", "deep/b.txt": "zwei \u00fc".encode(), "c.md": b""} and not (out / "_staging").exists()
    read = {r.path.rpartition("/")[2]: r.content for r in caches.read_files(spark, str(out)).collect()}
    assert bytes(read["b.txt"]) == "zwei \u00fc".encode()
    before = held()
    for bad in ("../x.md", None, "_staging/x"):
        with pytest.raises(Exception):  # noqa: B017
            staging.write_staged(texts.unionByName(spark.createDataFrame([(bad, "x")], "staged_path string, text string")).withColumn("text", F.lit("changed")), str(out), overwrite=True)
        assert held() == before and not (out / "_staging").exists()
    staging.write_staged(texts.where("staged_path = 'a.md'").withColumn("text", F.lit("new")), str(out))
    assert held() == before | {"a.md": b"new"}
    staging.write_staged(texts.where("staged_path = 'c.md'").withColumn("text", F.lit("only")), str(out), overwrite=True)
    assert held() == {"c.md": b"only"}


def test_as_of_over_ranges(spark):
    import random

    rnd = random.Random(6)
    history = [(f"s{i}", rnd.choice("xy"), f"2024-{rnd.randrange(1, 13):02d}", i, 2 * i) for i in range(15)]
    snaps = spark.createDataFrame(history, "key string, branch string, timestamp string, total_nodes long, total_edges long")
    asked = [(i, rnd.choice((None, f"2024-{rnd.randrange(1, 13):02d}-15", f"2024-{rnd.randrange(1, 13):02d}")), rnd.choice("xyz")) for i in range(200)]
    times = spark.createDataFrame(asked, "id long, at string, branch string")
    for by_branch in (False, True):
        want = {}
        for i, at, branch in asked:
            before = [(t, k) for k, b, t, _, _ in history if at is not None and t < at and (not by_branch or b == branch)]
            want[i] = max(before)[1] if before else None
        got = snapshots.previous_of(times, snaps, by_branch)
        assert got.columns == ["id", "at", "branch", "snapshot"]
        assert {r.id: r.snapshot.key if r.snapshot else None for r in got.collect()} == want
        assert snapshots.previous_of(times.limit(0), snaps, by_branch).count() == 0
        assert snapshots.previous_of(times, snaps.limit(0), by_branch).where("snapshot is null").count() == 200


def test_sqlite_filters_are_pushed(spark, tmp_path):
    """Rows that the filters leave out can't even be read: their weight is no number."""
    path = str(tmp_path / "p.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE nodes (id TEXT COLLATE NOCASE PRIMARY KEY, kind TEXT, weight INTEGER)")
        con.executemany("INSERT INTO nodes VALUES (?, ?, ?)", [("a", "k", 1), ("b", "k", 2), ("c", None, 3), ("d", "z", "bad"), ("e", "k", 5)])
    sqlite.register(spark)
    nodes = spark.read.format("braid_sqlite").option("path", path).option("table", "nodes").option("partitions", 2).load()
    with pytest.raises(Exception):  # noqa: B017
        nodes.collect()
    found = lambda where: sorted(r.id for r in nodes.where(where).collect())
    assert found("kind = 'k'") == ["a", "b", "e"] and found("kind = 'k' and weight > 1 and weight <= 5") == ["b", "e"]
    assert found("id in ('a', 'c', 'A')") == ["a", "c"] and found("kind is null") == ["c"]
    assert found("kind = 'k' and length(id) = 2") == [] and found("id = 'A'") == []
    wanted = spark.createDataFrame([("a",), ("c",), (None,), ("nope",)], "id string")
    assert sorted(r.id for r in sqlite.rows_of(spark, path, "nodes", "id", wanted).collect()) == ["a", "c"]
    hits = spark.createDataFrame([("s", "a"), ("s", "nope"), ("other", "a")], "kg_name string, node_id string")
    got = {(r.kg_name, r.node_id): r.content for r in sqlite.attach_content(hits, {"s": path}, text="kind").collect()}
    assert got == {("s", "a"): "k", ("s", "nope"): "", ("other", "a"): None}


def test_sqlite_source(spark, tmp_path):
    with sqlite3.connect(tmp_path / "g.sqlite") as con:
        con.execute("CREATE TABLE nodes (id TEXT, lineno INTEGER, score REAL)")
        con.executemany("INSERT INTO nodes VALUES (?, ?, ?)", [(f"n{i}", i, i / 2) for i in range(20)])
    sqlite.register(spark)
    got = spark.read.format("braid_sqlite").option("path", str(tmp_path / "g.sqlite")).option("table", "nodes").option("partitions", 3).load()
    assert dict(got.dtypes) == {"id": "string", "lineno": "bigint", "score": "double"} and got.agg(F.sum("lineno")).first()[0] == 190
    none = spark.read.format("braid_sqlite").schema("id string").option("path", str(tmp_path / "no.sqlite")).option("table", "nodes").load()
    assert none.count() == 0


def test_layouts(spark):
    n = spark.createDataFrame([(f"{k}{i}", k) for k in "abc" for i in range(5)], "id string, kind string")
    f = {r["id"]: r for r in rows(layout.funnel(n, {"a": 2, "b": 1}))}
    assert {r["z"] for i, r in f.items() if i[0] == "a"} == {20.0} and (f["a0"]["x"], f["a0"]["y"]) == (0.0, 0.0)
    assert max(np.hypot(r["x"], r["y"]) for r in f.values()) == pytest.approx(4.0)
    e = spark.createDataFrame([("a0", "CONTAINS", f"b{i}") for i in range(3)] + [("b0", "CONTAINS", "c0")], "src string, rel string, dst string")
    p = {r["id"]: (r["x"], r["y"], r["z"]) for r in rows(layout.allium(n, e, root_kind="a"))}
    assert len(p) == 15 and p["a0"][2] == 0.0
    apex = np.array([p["a0"][0], p["a0"][1], 8.0])
    assert np.linalg.norm(np.array(p["b1"]) - apex) == pytest.approx(2.0 + np.sqrt(3) * 0.4)
    assert np.linalg.norm(np.array(p["c0"]) - np.array(p["b0"])) == pytest.approx(0.95)
    single = {r["id"]: (r["x"], r["y"], r["z"]) for r in rows(layout.allium(n.where("id = 'a0'"), e, root_kind="a"))}
    assert single == {"a0": (14.0, 0.0, 0.0)}


def test_organic_trees(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(k, *map(float, rng.uniform(-3, 3, 2)), float(rng.uniform(2, 6))) for k in ("x", "y") for _ in range(30)], "tree_key string, x double, y double, z double")
    a, b = (sorted(rows(layout.grow(pts)), key=lambda r: (r["tree_key"], r["idx"])) for _ in range(2))
    assert a == b and len(a) > 20
    for key in ("x", "y"):
        tree = {r["idx"]: r for r in a if r["tree_key"] == key}
        for i, r in tree.items():
            kids = [c["radius"] for c in tree.values() if c["parent"] == i]
            assert not kids or r["radius"] ** 2.2 == pytest.approx(sum(k**2.2 for k in kids))
    sk = layout.grow(pts)
    assert all(r["path"][0] == 0 for r in rows(layout.root_to_tip_paths(sk)))
    tips = {(r["tree_key"], r["tip"]): r["path"] for r in rows(layout.root_to_tip_paths(sk))}
    ends = {(r["tree_key"], r["path"][-1]) for r in rows(layout.limb_paths(sk))}
    assert set(tips) <= ends
    curve = [r for r in rows(layout.smooth_paths(sk)) if (r["tree_key"], r["tip"]) == min(tips)]
    assert len(curve) == 4 * (len(tips[min(tips)]) - 1) + 1
    assert all(r["spacing"] > 0 for r in rows(layout.crown_spacing(pts)))
    box = rows(layout.frame(spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 2.0, 2.0)], "x double, y double, z double")))[0]
    assert (box["cx"], box["radius"]) == (1.0, pytest.approx(3**0.5))
    leaves = spark.createDataFrame([("x", "l", 0.0, 0.0, 0.0)], "tree_key string, leaf string, x double, y double, z double")
    assert rows(layout.nearest_node(leaves, sk))[0]["idx"] == 0


def test_overlap_join(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(i, int(s), int(s) + int(rng.integers(0, 90))) for i, s in enumerate(rng.integers(0, 900, n))]
    a, b = make(60), make(60)
    frame = lambda x: spark.createDataFrame(x, "id int, s int, e int").select("id", F.expr("timestamp'2000-01-01' + make_dt_interval(s)").alias("start"), F.expr("timestamp'2000-01-01' + make_dt_interval(e)").alias("end"))
    got = sorted((r["left_id"], r["right_id"]) for r in rows(temporal.overlap_join(frame(a), frame(b))))
    assert got == sorted((i, j) for i, s, e in a for j, t, f in b if s <= f and t <= e)


def test_captured_snapshots(spark):
    s = rows(snapshots.capture(spark, "k", "main", "1", "2024", {"total_nodes": 3, "node_counts": {"f": 3}, "at": "/repo/a/b.py"}, "/repo", [{"path": "/repo/x", "n": 2}, {"path": "/other/x"}], total_edges=4))[0]
    assert (s["total_nodes"], s["total_edges"], s["node_counts"]) == (3, 4, {"f": 3}) and '"at": "a/b.py"' in s["metrics"]
    assert s["hotspots"] == [{"path": "x", "n": "2"}, {"path": "/other/x"}]
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert {(r["key"], r["problem"]) for r in rows(snapshots.broken(keys("a", "b"), keys("b", "c")))} == {("a", "broken entry"), ("c", "orphan file")}


def test_whole_tables_are_queried(spark, data):
    from braidgraph.queries import QUERIES

    table = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    asked = QUERIES["vec_knn_multi_query_share"](spark, data)
    assert asked.count() == 5 * table("embeddings").where("vec_id % 20 = 0").count()
    ordered = [(r["rank"], r["k"], r["event_id"]) for r in QUERIES["temporal_sort_all"](spark, data).orderBy("rank").collect()]
    assert [r for r, _, _ in ordered] == list(range(1, table("events").count() + 1)) and [x[1:] for x in ordered] == sorted(x[1:] for x in ordered)
    lines = [(r[0] * 10 + r[1], 2 * (r[0] + r[1]), 2 * (r[0] + r[1]) + r[1]) for r in table("lineitem").select("l_orderkey", "l_linenumber").collect()]
    starting = [[] for _ in range(2 * max(x[2] for x in lines) + 64)]
    for k, (_, s, e) in enumerate(lines):
        for h in range(s, e + 1):
            starting[h].append(k)
    want = []  # lines may repeat each other, so they are told apart by their places
    for (o,) in table("orders").select("o_orderkey").collect():
        want += [(o, lines[k][0]) for k in {k for h in range(2 * o, 2 * o + o % 9 + 1) for k in starting[h]}]
    got = [(r["left_id"], r["right_id"]) for r in QUERIES["temporal_overlap_join_whole"](spark, data).collect()]
    assert sorted(got) == sorted(want)


def test_every_document_is_staged(spark):
    from braidgraph.queries import QUERIES

    folder = "/root/testdata/sf0.01"  # more than 900 documents
    got = rows(QUERIES["ingest_staged_names_all"](spark, folder))
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count() > 900
    assert len({r["path"] for r in got}) == len({r["staged_path"] for r in got}) == len(got)
    assert sum(r["staged_path"].count("-") == 1 for r in got) == 300


def test_files_of_other_kinds_never_meet_the_csv_reader(spark):
    odd = '"' + "x" * 200_000
    files = spark.createDataFrame([("a/n.txt", odd.encode()), ("a/b.csv", b"x,y\n1,2\n"), ("a/long.csv", odd.encode() + b"y"), ("a/empty.csv", b""), ("a/z.csv", b"\0\n"), ("a/p.jpeg", b"\xff")], "path string, content binary")
    got = {r["source_path"]: r for r in ingest.ingest(files, None, "2024-01-01T00:00:00").collect()}
    assert len(got) == 6 and got["a/n.txt"]["text"] == odd and got["a/b.csv"]["text"].startswith("| x | y |")
    assert got["a/long.csv"]["status"] == "ingested" and got["a/empty.csv"]["status"] == "failed" and got["a/p.jpeg"]["status"] == "skipped"


def test_ledger_lookups(spark):
    files = spark.createDataFrame([("a.md", b"one"), ("b.md", b"one"), ("c.jpeg", b"two")], "path string, content binary")
    first = ingest.ingest(files, None, "2024-01-01T00:00:00")
    again = ingest.ingest(files, first, "2024-02-01T00:00:00")
    last = {r["source_path"]: r for r in ingest.latest(first.drop("text").unionByName(again.drop("text"))).collect()}
    assert last["a.md"]["status"] == "ingested" and last["a.md"]["ingested_at"] == "2024-01-01T00:00:00"
    assert last["b.md"]["ingested_at"] == "2024-02-01T00:00:00"
    assert [r[0] for r in ingest.staged_paths(first).collect()] == ["a.md"]


def test_hot_names_and_equal_digests(spark):
    rows = [(f"d{i}/same.md", f"{i % 7:064d}", ".md") for i in range(300)] + [("d/other.md", "f" * 64, ".md")]
    got = {r["path"]: r["staged_path"] for r in ingest.staged_names(spark.createDataFrame(rows, "path string, sha256 string, out_suffix string").repartition(5)).collect()}
    first = min(p for p, _, _ in rows[:300])
    assert got[first] == "same.md" and got["d/other.md"] == "other.md"
    assert sum(p == f"same-{'0' * 8}.md" for p in got.values()) == 1 and len(got) == 301


def test_overlaps_of_long_and_open_intervals(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(6)
    start = datetime(2000, 1, 1)

    def made(n):
        out = []
        for i in range(n):
            a = start + timedelta(days=rng.randrange(9000))
            b = a + timedelta(hours=rng.choice([0, 1, 30, 900, 30_000, 200_000]))
            out.append((i, None if rng.random() < 0.1 else a, None if rng.random() < 0.1 else b))
        return [*out, (n, start + timedelta(9), start)]

    left, right = made(60), made(80)
    low, high = datetime.min, datetime.max
    want = {(i, j) for i, a, b in left for j, c, d in right if (a or low) <= (b or high) and (c or low) <= (d or high) and (a or low) <= (d or high) and (c or low) <= (b or high)}
    schema = "id long, start timestamp, end timestamp"
    got = [tuple(r) for r in temporal.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()]
    assert sorted(got) == sorted(want)
    assert temporal.overlap_join(spark.createDataFrame([], schema), spark.createDataFrame(right, schema)).count() == 0


def test_several_sources(spark, tmp_path):
    for name in ("a/x.md", "a/.git/h.md", "a/out/staged.md", "b/y.txt", "b/.hidden.md", "c/named.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    at = lambda n: str(tmp_path / n)
    got = caches.read_sources(spark, [at("a"), at("b"), at("b/y.txt"), at("c/named.bin")], at("a/out"))
    assert sorted(r["path"] for r in got.collect()) == [at("a/x.md"), at("b/y.txt"), at("c/named.bin")]
    with pytest.raises(FileNotFoundError):
        caches.read_sources(spark, [at("nowhere")])


def test_snapshot_hooks(spark):
    make = lambda k, t, n: snapshots.capture(spark, k, "main", "1", t, {"total_nodes": n, "total_edges": 2 * n})
    history = make("a", "2024-01", 5).unionByName(make("b", "2024-02", 9))
    new = make("c", "2024-03", 7)
    row = snapshots.captured(history, new).first()
    assert (row["nodes_vs_previous"], row["edges_vs_baseline"]) == (-2, 4)
    assert snapshots.load(history, "latest").first()["key"] == "b" and snapshots.load(history, "zz").count() == 0
    twice = snapshots.load(history, "b", lambda c, before: F.when(before.isNotNull(), 2 * (F.col(c) - before[c]))).first()
    assert twice["nodes_vs_previous"] == 8
    kept = snapshots.save(history, new, ["total_nodes"], changed=lambda old, own: abs(old["total_nodes"] - own["total_nodes"]) > 5)
    assert sorted(r["key"] for r in kept.collect()) == ["a", "c"]


def test_registered_backends(spark):
    from braidgraph.operators import vectors

    rows_ = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<float>")
    vectors.register_backend("first", lambda v, q, k: v.orderBy("id").limit(k))
    assert [r["id"] for r in vectors.search_with("first", rows_, [0.0, 1.0], 1).collect()] == ["a"]
    assert [r["id"] for r in vectors.search_with("exact", rows_, [0.0, 1.0], 1).collect()] == ["b"]
    with pytest.raises(ValueError):
        vectors.search_with("none", rows_, [1.0])


def test_a_written_upsert_shuffles_once(spark):
    from braidgraph.operators.graph import upsert

    rows = [("a", 1), ("b", 2), ("a", 3), ("c", 4), ("a", 5)]
    none = spark.createDataFrame([], "id string, n long")
    last = upsert(none, spark.createDataFrame(rows, "id string, n long").coalesce(1), ["id"], ranges=True)
    out = last.sortWithinPartitions("id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan, plan
    assert sorted(map(tuple, out.collect())) == [("a", 5), ("b", 2), ("c", 4)]
