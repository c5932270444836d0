from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from braidgraph.functions import text as X
from braidgraph.operators import graph as G
from braidgraph.operators import retrieve as R
from braidgraph.operators import vectors as V
from braidgraph.schema import EDGES, NODES
from braidgraph.sources.tables import GraphTables, VectorTables


def nodes(spark, *rows):
    """(id, kind, name, qualname, module_path, lineno, end_lineno, docstring) with trailing parts optional."""
    full = [(*r, *[None] * (9 - len(r))) for r in rows]
    return spark.createDataFrame([(r[0], r[1] or "function", r[2] or r[0].rpartition(":")[2], *r[3:]) for r in full], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], EDGES)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize(("hop", "want"), [(0, {"a"}), (1, {"a", "b"}), (2, {"a", "b", "c"})])
def test_chain_expansion(spark, hop, want):
    e = edges(spark, ("a", "CALLS", "b"), ("b", "CALLS", "c"))
    assert {r["id"] for r in rows(G.expand(e, ids(spark, "a"), hop))} == want


def test_expansion_details(spark):
    e = edges(spark, ("a", "CALLS", "b"), ("a", "IMPORTS", "c"))
    got = {r["id"]: (r["best_hop"], r["via_seed"]) for r in rows(G.expand(e, ids(spark, "a"), 1))}
    assert got == {"a": (0, "a"), "b": (1, "a"), "c": (1, "a")}
    assert {r["id"] for r in rows(G.expand(e, ids(spark, "a"), 1, ("CALLS",)))} == {"a", "b"}
    assert {r["id"] for r in rows(G.expand(e, ids(spark, "zz"), 2))} == {"zz"}
    assert rows(G.expand(e, ids(spark, "a"), 2, ())) == [{"id": "a", "best_hop": 0, "via_seed": "a"}]
    assert G.expand(e, ids(spark, "a").where("false"), 2).count() == 0


def test_expansion_equals_a_sequential_walk(spark):
    rng = random.Random(1)
    pairs = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)}
    e = edges(spark, *((a, "CALLS", b) for a, b in pairs))
    seeds = ["n1", "n2", "n3"]
    near = {}
    for s in seeds:
        seen, last = {s: 0}, {s}
        for h in (1, 2, 3):
            last = {y for x in last for a, b in pairs for y in ((b,) if a == x else ()) + ((a,) if b == x else ())} - set(seen)
            seen |= dict.fromkeys(last, h)
        for n, h in seen.items():
            near[n] = min(near.get(n, (9, "")), (h, s))
    got = {r["id"]: (r["best_hop"], r["via_seed"]) for r in rows(G.expand(e, ids(spark, *seeds), 3))}
    assert got == near


def test_upsert_replaces_whole_rows(spark):
    old = nodes(spark, ("n:a", None, None, None, None, None, None, "v1"), ("n:b",))
    new = nodes(spark, ("n:a", None, None, None, None, None, None, "v2"), ("n:a", None, None, None, None, None, None, "v3")).withColumn("seq", F.when(F.col("docstring") == "v2", 1).otherwise(2))
    got = {r["id"]: r["docstring"] for r in rows(G.upsert(old, new, ["id"], "seq"))}
    assert got == {"n:a": "v3", "n:b": None}


def test_edges_within_and_from(spark):
    e = edges(spark, ("a", "CALLS", "b"), ("b", "CALLS", "c"), ("a", "IMPORTS", "b"))
    assert len(rows(G.edges_within(e, ids(spark, "a", "b")))) == 2
    assert [r["dst"] for r in rows(G.edges_from(e, "a"))] == ["b"]


def test_stats_and_coverage(spark):
    n = nodes(spark, ("f", "function", None, None, None, None, None, "doc"), ("m", "method", None, None, None, None, None, " "), ("c", "class"), ("s", "symbol"))
    got = rows(G.stats(n, edges(spark, ("f", "CALLS", "m"))))[0]
    assert (got["total_nodes"], got["total_edges"], got["meaningful_nodes"], got["docstring_coverage"]) == (4, 1, 3, 1.0)
    assert rows(G.coverage(n, ["function", "method"]))[0]["coverage"] == 0.5
    empty = n.where("false")
    assert rows(G.stats(empty, edges(spark).where("false")))[0]["docstring_coverage"] == 0.0
    assert rows(G.coverage(empty, ["function"]))[0]["coverage"] == 0.0


def test_symbols_resolve_in_two_tiers(spark):
    n = nodes(
        spark,
        ("mod", "module", "mod", "mod", "src/pkg/mod.py"),
        ("f1", "function", "foo", "foo", "src/pkg/mod.py"),
        ("f2", "function", "bar", "bar", "src/pkg/a.py"),
        ("f3", "function", "bar", "bar", "src/pkg/b.py"),
        ("sym:pkg.mod.foo", "symbol", "foo", "pkg.mod.foo"),
        ("sym:bar", "symbol", "bar"),
        ("sym:mod", "symbol", "mod", "no.such.mod"),
        ("sym:none", "symbol", "none"),
    )
    got = {(r["src"], r["dst"]): r["evidence"] for r in rows(G.resolve_symbols(n))}
    assert set(got) == {("sym:pkg.mod.foo", "f1"), ("sym:bar", "f2"), ("sym:bar", "f3"), ("sym:mod", "mod")}
    assert '"confidence":"high"' in got["sym:pkg.mod.foo", "f1"] and '"candidate_count":2' in got["sym:bar", "f2"] and '"medium"' in got["sym:mod", "mod"]
    variants = spark.createDataFrame([("src/pkg/mod.py",), ("lib/x.py",)], "p string").select(G.dotted_variants(F.col("p")).alias("v"))
    assert [r["v"] for r in variants.collect()] == [["src.pkg.mod", "pkg.mod"], ["lib.x"]]


def test_callers_direct_and_through_stubs(spark):
    n = nodes(spark, ("t", "function", "foo", "foo", "src/t.py"), ("d", None, None, None, "src/d.py"), ("s1", None, None, None, "src/s1.py"), ("s2", None, None, None, "src/s2.py"), ("m2", "module", None, None, "src/s2.py"), ("sym:a.foo", "symbol", "foo"), ("sym:b.foo", "symbol", "foo"))
    e = edges(
        spark,
        ("d", "CALLS", "t", '{"lineno": 4}'), ("d", "CALLS", "sym:a.foo", '{"lineno": 9, "expr": "x.foo"}'),
        ("s1", "CALLS", "sym:a.foo", '{"lineno": "bad", "expr": "foo"}'), ("s2", "CALLS", "sym:a.foo", '{"lineno": 5, "expr": "foo"}'),
        ("sym:a.foo", "RESOLVES_TO", "t"), ("m2", "IMPORTS", "sym:b.foo"), ("ghost", "CALLS", "t"),
    )
    got = {r["id"]: r["call_site_lineno"] for r in rows(G.callers_of(n, e, "t"))}
    assert got == {"d": 4, "s1": None}  # s2's module imports another foo
    ok = e.unionByName(edges(spark, ("sym:b.foo", "RESOLVES_TO", "t")))
    assert set(r["id"] for r in rows(G.callers_of(n, ok, "t"))) == {"d", "s1", "s2"}


def test_tables_keep_versions(spark, tmp_path):
    t = GraphTables(spark, f"file://{tmp_path}/store")
    assert t.nodes.count() == 0
    t.write(nodes(spark, ("a",), ("b",)), edges(spark, ("a", "CALLS", "b", None, 2.0)))
    t.write(nodes(spark, ("a", "class"),), edges(spark, ("a", "CALLS", "b", "{}")))
    assert {r["id"]: r["kind"] for r in rows(t.nodes)} == {"a": "class", "b": "function"}
    assert [(r["evidence"], r["weight"]) for r in rows(t.edges)] == [("{}", None)]
    t.clear()
    assert t.nodes.count() == 0 and t.edges.count() == 0


def vecs(spark):
    import numpy as np

    m = np.random.default_rng(42).normal(size=(8, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(f"n{i}", "class" if i % 2 else "function", m[i].tolist()) for i in range(8)], "id string, kind string, vector array<float>")


def test_exact_search(spark):
    m, df = vecs(spark)
    near = rows(V.search(df, m[3], 3))
    assert near[0]["id"] == "n3" and abs(near[0]["_distance"]) < 1e-6 and [r["rank"] for r in near] == [0, 1, 2]
    assert {r["id"] for r in rows(V.search(df, m[0], 8, "kind = 'class'"))} == {"n1", "n3", "n5", "n7"}
    assert rows(V.search(df, m[5], 1, int8=True))[0]["id"] == "n5"
    assert V.delete_ids(df, ids(spark, "n0", "n1", "missing", "")).count() == 6
    assert rows(V.lsh_search(df, m[2], 1, probes=8))[0]["id"] == "n2"
    many = V.search_many(df, df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), 2)
    assert {(r["query_id"], r["id"]) for r in rows(many) if r["rank"] == 0} == {(f"n{i}", f"n{i}") for i in range(8)}
    one = spark.range(1).select(V.distance_of(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1.0), F.lit(7)).alias("d"))
    assert rows(one)[0]["d"] == 0.5


def test_vector_tables(spark, tmp_path):
    m, df = vecs(spark)
    t = VectorTables(spark, f"file://{tmp_path}/v")
    assert t.count() == 0 and t.delete_ids(ids(spark, "n0")) == 0 and t.version() is None
    t.upsert(df)
    t.upsert(df.where("id = 'n1'").withColumn("kind", F.lit("new")))
    assert t.count() == 8 and {r["id"] for r in rows(t.rows.where("kind = 'new'"))} == {"n1"}
    for backend in ("auto", "int8", "lsh"):
        assert rows(t.search(m[4], 1, backend=backend))[0]["id"] == "n4"
    with pytest.raises(ValueError):
        t.search(m[4], 1, backend="other")
    assert t.delete_ids(ids(spark, "n0", "n1", "missing")) == 2 and t.existing_ids().count() == 6


def corpus(spark):
    names = ["embedder", "store", "pipeline", "semantic"]
    n = nodes(spark, ("mod", "module", "mod", "mod", "src/mod.py", None, None, "all of it"), *((f"fn:{x}", "function", x, f"mod.{x}", "src/mod.py", 10 * i + 1, 10 * i + 4, f"{x} batch code") for i, x in enumerate(names)))
    e = edges(spark, *(("mod", "CONTAINS", f"fn:{x}") for x in names))
    v = spark.createDataFrame([(f"fn:{x}", [float(i == j) for j in range(4)]) for i, x in enumerate(names)], "id string, vector array<float>")
    return n, e, v


def test_query_modes_and_caps(spark):
    n, e, v = corpus(spark)
    r = R.query(n, e, v, [0, 1, 0, 0], "store code", k=2, hop=1)
    got = rows(r.nodes)
    assert {x["id"] for x in got} == {"fn:store", "fn:embedder", "mod"} and max(x["score"] for x in got) == 1.0
    assert rows(r.counters()) == [{"seeds": 2, "expanded_nodes": 3, "returned_nodes": 3, "edges": 2}]
    assert R.query(n, e, v, [0, 1, 0, 0], "store", k=4, hop=2, max_per_module=2, mode="hybrid").nodes.count() == 2
    assert R.query(n, e, v, [0, 1, 0, 0], "store", k=4, hop=0, min_score=0.9).nodes.count() == 1
    assert R.query(n, e, v, [0, 1, 0, 0], "store", k=4, hop=0, min_score=2.0).nodes.count() == 0
    free = {x["id"]: x["score"] for x in rows(R.query(n, e, v, [0, 1, 0, 0], "store", hop=0, mode="hybrid", semantic_weight=0.0, lexical_weight=0.0).nodes)}
    assert set(free.values()) == {0.0}


def greedy(rows_, cap):
    kept, spans, counts = [], {}, {}
    for r in sorted(rows_, key=lambda r: r[2:4]):
        i, f, _, _, s, e = r
        if not f or s is None or e < s:
            kept.append(i)
        elif not any(s <= b + 2 and a <= e + 2 for a, b in spans.get(f, [])) and (cap is None or counts.get(f, 0) < cap):
            kept.append(i)
            counts[f] = counts.get(f, 0) + 1
            spans.setdefault(f, []).append((s, e))
    return set(kept)


def test_greedy_spans_equal_the_sequential_rule(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([None, "", "a", "b", "c"]), rng.random(), i, *((s, s + rng.randrange(-1, 9)) if (s := rng.randrange(1, 60)) % 7 else (None, None))) for i in range(120)]
    df = spark.createDataFrame(data, "id int, module_path string, k1 double, k2 int, span_start int, span_end int")
    for cap in (None, 2):
        assert {r["id"] for r in rows(R.greedy_spans(df, ("k1", "k2"), cap))} == greedy(data, cap)


def test_pack_snippets_and_summaries(spark):
    n, e, v = corpus(spark)
    n = n.unionByName(nodes(spark, ("fn:zlost", "function", "zlost", "mod.store.zlost", "src/mod.py"), ("fn:orphan", "function", "orphan", "nothing.orphan", "src/mod.py")))
    e = e.unionByName(edges(spark, ("fn:store", "CALLS", "fn:zlost"), ("fn:store", "CALLS", "fn:orphan")))
    text = "\n".join(f"line {i}" for i in range(1, 101))
    files = spark.createDataFrame([("src/mod.py", text)], "module_path string, text string").select("module_path", X.lines(F.col("text")).alias("lines"))
    p = R.pack(n, e, v, files, [0, 1, 0, 0], "store", k=1, hop=1, context=1)
    got = {r["id"]: r for r in rows(p.nodes)}
    assert got["fn:store"]["snippet"].splitlines()[0] == "   10: line 10" and (got["fn:store"]["span_start"], got["fn:store"]["span_end"]) == (10, 15)
    assert got["fn:orphan"]["snippet"] is None and "fn:zlost" not in got and "mod" not in got  # both overlap the better store
    said = {r["id"]: r["warning"] for r in rows(p.warnings)}
    assert "capped parent span 10-15" in said["fn:zlost"] and "omitted" in said["fn:orphan"]
    s = rows(R.module_summary(n.where("id = 'mod'"), n, e, 60))[0]["text"]
    assert s.splitlines()[0] == "       all of it" and "#   mod.store (L11) — store batch code" in s and "# functions (4):" in s


def test_lsh_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.concat(F.lit("n"), "vec_id").alias("id"), F.col("embedding").alias("vector")).cache()
    asked = [r[0] for r in df.where("cast(substr(id, 2) as int) % 100 = 7").select("vector").collect()]
    exact = [{r["id"] for r in V.search(df, q, 10).collect()} for q in asked]
    for how in ({}, {"probes": 3}):
        found = [{r["id"] for r in V.lsh_search(df, q, 10, **how).collect()} for q in asked]
        assert sum(len(a & b) for a, b in zip(exact, found, strict=True)) >= 0.9 * 10 * len(asked)


def test_last_of_a_batch_is_written(spark, tmp_path):
    from braidgraph.plans.module import EdgeSpec, NodeSpec, frames
    from braidgraph.sources.tables import GraphTables, VectorTables

    specs = [NodeSpec("x", "k", "zz first"), EdgeSpec("x", "y", "R", 9.0), NodeSpec("y", "k", "only"), NodeSpec("x", "k", "aa last"), EdgeSpec("x", "y", "R", 1.0)]
    store = GraphTables(spark, str(tmp_path / "g"))
    store.write(*frames(spark, specs))
    assert {r["id"]: r["name"] for r in store.nodes.collect()} == {"x": "aa last", "y": "only"}
    assert [r["weight"] for r in store.edges.collect()] == [1.0]
    store.write(*frames(spark, [NodeSpec("x", "k", "a later batch"), NodeSpec("x", "k", "Its end")]))
    assert {r["id"]: r["name"] for r in store.nodes.collect()} == {"x": "Its end", "y": "only"}
    rows = VectorTables(spark, str(tmp_path / "v"))
    made = lambda *xs: spark.createDataFrame([(i, "k", [float(x)]) for i, x in xs], "id string, kind string, vector array<float>")
    rows.upsert(made(("a", 9), ("b", 2), ("a", 1)))
    assert {r["id"]: r["vector"] for r in rows.rows.collect()} == {"a": [1.0], "b": [2.0]}


def test_edges_of_the_tables_are_those_of_their_sql(spark, data):
    """Duplicates are taken out before names are made; what is read must stay the mapping's rows."""
    from braidgraph.plans import star

    tables = {t: spark.read.parquet(f"{data}/{t}.parquet") for t in ("nation", "customer", "supplier", "orders")}
    tables["lineitem"] = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (1, 2, 4), (None, 2, 3), (None, 2, 3), (1, None, None), (12, 3, None)], "l_orderkey long, l_partkey long, l_suppkey long")
    got = spark.sql(star._BY_NUMBER[star.EDGES], **tables)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.sql(star.EDGES, **tables).collect()))
    assert "DISTINCT concat" not in star._BY_NUMBER[star.EDGES]
