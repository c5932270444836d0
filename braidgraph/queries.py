"""The engine's operators as named queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.functions import temporal as TM
from braidgraph.functions import text as X
from braidgraph.functions.vectors import cosine_distance, dot, to_int8
from braidgraph.operators import embed, graph, hits, ingest, ivf, layout, retrieve, scores, snapshots, temporal, vectors
from braidgraph.plans import star
from braidgraph.plans.lineage import checkpointed, numbered, scratch
from braidgraph.sources.adjacency import Adjacency
from braidgraph.sources.tables import GraphTables, VectorTables
from braidgraph.streaming import streams, timeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


_N, _E = star.text(star.NODES), star.text(star.EDGES)
_CN, _CE = star.text(star.CODE_NODES), star.text(star.CODE_EDGES)
_DN, _DE = star.text(star.DOC_NODES), star.text(star.DOC_EDGES)

# ---- graph store ----


@query("graph_nodes_by_kind", f"SELECT kind, count(*) AS n FROM ({_N}) GROUP BY kind")
def graph_nodes_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts_by(star.of(spark, d, star.NODES), "kind")


@query("graph_edges_by_rel", f"SELECT rel, count(*) AS n FROM ({_E}) GROUP BY rel")
def graph_edges_by_rel(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts_by(star.of(spark, d, star.EDGES), "rel")


@query("graph_query_nodes", f"SELECT id, kind, name, lineno FROM ({_N}) WHERE kind IN ('customer', 'supplier') AND module_path = 'NATION_7'")
def graph_query_nodes(spark: SparkSession, d: str) -> DataFrame:
    out = graph.query_nodes(star.of(spark, d, star.NODES), ["customer", "supplier"], "NATION_7")
    return graph.in_store_order(out).select("id", "kind", "name", "lineno")


@query("graph_node", f"SELECT id, name, qualname FROM ({_N}) WHERE id = 'part:7'")
def graph_node(spark: SparkSession, d: str) -> DataFrame:
    return graph.node(star.of(spark, d, star.NODES), "part:7").select("id", "name", "qualname")


@query("graph_edges_from", f"SELECT src, rel, dst FROM ({_E}) WHERE src = 'nation:3' AND rel = 'CONTAINS' ORDER BY dst LIMIT 10")
def graph_edges_from(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_from(star.of(spark, d, star.EDGES), "nation:3", "CONTAINS", 10).select("src", "rel", "dst")


@query("graph_edges_within", f"SELECT src, rel, dst FROM ({_E}) WHERE src IN (SELECT id FROM ({_N}) WHERE kind IN ('region', 'nation', 'supplier')) AND dst IN (SELECT id FROM ({_N}) WHERE kind IN ('region', 'nation', 'supplier'))")
def graph_edges_within(spark: SparkSession, d: str) -> DataFrame:
    ids = star.of(spark, d, star.NODES).where(F.col("kind").isin("region", "nation", "supplier")).select("id")
    return graph.edges_within(star.of(spark, d, star.EDGES), ids).select("src", "rel", "dst")


@query("graph_upsert_last_wins", f"""
SELECT n.id, coalesce(b.name, n.name) AS name, CASE WHEN b.id IS NULL THEN n.docstring ELSE b.docstring END AS docstring FROM ({_N}) n
LEFT JOIN (SELECT concat('customer:', o_custkey) AS id, concat('Buyer ', o_custkey) AS name, o_orderpriority AS docstring FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) b USING (id)
""")
def graph_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    batch = _t(spark, d, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("id"), F.lit("customer").alias("kind"), F.concat(F.lit("Buyer "), "o_custkey").alias("name"), F.col("o_orderpriority").alias("docstring"), "o_orderkey")
    return graph.upsert(star.of(spark, d, star.NODES), batch, ["id"], "o_orderkey").select("id", "name", "docstring")


@query("graph_store_merge", f"""
SELECT n.id, coalesce(b.name, n.name) AS name, CASE WHEN b.id IS NULL THEN n.docstring ELSE b.docstring END AS docstring FROM ({_N}) n
LEFT JOIN (SELECT concat('customer:', o_custkey) AS id, concat('Buyer ', o_custkey) AS name, max_by(o_orderpriority, o_orderkey) AS docstring FROM orders GROUP BY o_custkey) b USING (id)
UNION ALL SELECT 'audit', 'Audit', NULL
""")
def graph_store_merge(spark: SparkSession, d: str) -> DataFrame:
    # a base, two deltas, one of them written twice, and what readers make of them
    orders, none = _t(spark, d, "orders"), F.lit(None).cast("string")
    last = orders.groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("docstring"))
    buyers = last.select(F.concat(F.lit("customer:"), "o_custkey").alias("id"), F.lit("customer").alias("kind"), F.concat(F.lit("Buyer "), "o_custkey").alias("name"), "docstring")
    with scratch(spark) as folder:
        store = GraphTables(spark, folder)
        edges = star.of(spark, d, star.EDGES)
        store.write(star.of(spark, d, star.NODES), edges)
        store.write(buyers.withColumn("docstring", none), edges.where("false"))
        store.write(buyers.unionByName(spark.createDataFrame([("audit", "audit", "Audit", None)], buyers.schema)), edges.where("false"))
        found = checkpointed(store.nodes.select("id", "name", "docstring"))
    return found


@query("graph_upsert_edges", f"""
SELECT e.src, e.rel, e.dst, coalesce(b.evidence, e.evidence) AS evidence FROM ({_E}) e
LEFT JOIN (SELECT concat('customer:', o_custkey) AS src, concat('order:', o_orderkey) AS dst, o_orderstatus AS evidence FROM orders) b ON e.rel = 'PLACED' AND e.src = b.src AND e.dst = b.dst
UNION ALL SELECT concat('order:', o_orderkey), 'SEEN_IN', 'audit', o_orderpriority FROM orders
""")
def graph_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").withColumn("order", F.concat(F.lit("order:"), "o_orderkey"))
    again = orders.select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.lit("PLACED").alias("rel"), F.col("order").alias("dst"), F.col("o_orderstatus").alias("evidence"))
    new = orders.select(F.col("order").alias("src"), F.lit("SEEN_IN").alias("rel"), F.lit("audit").alias("dst"), F.col("o_orderpriority").alias("evidence"))
    return graph.upsert(star.of(spark, d, star.EDGES), again.unionByName(new), ["src", "rel", "dst"]).select("src", "rel", "dst", "evidence")


def _expand_sql(seeds: str, hop: int, rels: str) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM ({_E}) WHERE rel IN ({rels}) UNION SELECT dst, src FROM ({_E}) WHERE rel IN ({rels})),
walk AS (SELECT id, 0 AS hop, id AS seed FROM (VALUES {seeds}) s(id) UNION SELECT e.b, hop + 1, seed FROM walk JOIN e ON walk.id = e.a WHERE hop < {hop}),
best AS (SELECT id, min(hop) AS best_hop FROM walk GROUP BY id)
SELECT id, CAST(best_hop AS INTEGER) AS best_hop, min(seed) AS via_seed FROM best JOIN walk USING (id) WHERE hop = best_hop GROUP BY 1, 2
"""


for _hop in (1, 2, 3):

    @query(f"graph_expand_hop{_hop}", _expand_sql("('nation:1'), ('nation:8')", _hop, "'CONTAINS', 'PLACED', 'SUPPLIED_BY'"))
    def _expand(spark: SparkSession, d: str, hop: int = _hop) -> DataFrame:
        return graph.expand(star.of(spark, d, star.EDGES), _ids(spark, "nation:1", "nation:8"), hop, ("CONTAINS", "PLACED", "SUPPLIED_BY"))


@query("graph_expand_stored", _expand_sql("('nation:1'), ('nation:8')", 3, "'CONTAINS', 'PLACED', 'SUPPLIED_BY'"))
def graph_expand_stored(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as folder:
        stored = Adjacency.build(star.of(spark, d, star.EDGES), f"edges_{folder.rpartition('-')[2]}", folder)
        found = checkpointed(stored.expand(_ids(spark, "nation:1", "nation:8"), 3, ["CONTAINS", "PLACED", "SUPPLIED_BY"]))
        stored.drop()
    return found


@query("graph_edges_stored", f"SELECT src, rel, dst FROM ({_E}) WHERE (src = 'nation:3' AND rel = 'CONTAINS') OR (dst = 'supplier:2' AND rel = 'SUPPLIED_BY')")
def graph_edges_stored(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as folder:
        stored = Adjacency.build(star.of(spark, d, star.EDGES), f"edges_{folder.rpartition('-')[2]}", folder)
        into = stored.callers("supplier:2", "SUPPLIED_BY").select(F.col("id").alias("src"), F.lit("SUPPLIED_BY").alias("rel"), F.lit("supplier:2").alias("dst"))
        found = checkpointed(stored.edges_from("nation:3", "CONTAINS").select("src", "rel", "dst").unionByName(into))
        stored.drop()
    return found


@query("graph_expand_rel_filter", _expand_sql("('nation:1'), ('nowhere:0')", 2, "'CONTAINS'"))
def graph_expand_rel_filter(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand(star.of(spark, d, star.EDGES), _ids(spark, "nation:1", "nowhere:0"), 2, ("CONTAINS",))


@query("graph_expand_names", f"""
WITH x AS ({_expand_sql("('nation:1'), ('nation:8')", 2, "'CONTAINS', 'PLACED'")}) SELECT x.id, n.kind, n.name, x.best_hop, x.via_seed FROM x JOIN ({_N}) n USING (id)
""")
def graph_expand_names(spark: SparkSession, d: str) -> DataFrame:
    found = graph.expand(star.of(spark, d, star.EDGES), _ids(spark, "nation:1", "nation:8"), 2, ("CONTAINS", "PLACED"))
    return star.of(spark, d, star.NODES).join(found, "id").select("id", "kind", "name", "best_hop", "via_seed")


_RESOLVED = f"""
SELECT s.id AS src, d.dst, 'exact_qualname' AS mode, CAST(NULL AS BIGINT) AS candidates FROM ({_CN}) s JOIN (
  SELECT DISTINCT id AS dst, CASE WHEN kind = 'module' THEN m ELSE concat(m, '.', qualname) END AS key FROM (SELECT *, unnest(list_distinct([replace(replace(module_path, '.py', ''), '/', '.'), regexp_replace(replace(replace(module_path, '.py', ''), '/', '.'), '^src[.]', '')])) AS m FROM ({_CN}) WHERE kind <> 'symbol')) d
  ON s.kind = 'symbol' AND contains(s.qualname, '.') AND s.qualname = d.key
UNION ALL SELECT s.id, d.id, CASE WHEN count(*) OVER (PARTITION BY s.id) > 1 THEN 'name_fallback_ambiguous' ELSE 'name_fallback' END, count(*) OVER (PARTITION BY s.id)
FROM ({_CN}) s JOIN ({_CN}) d ON s.kind = 'symbol' AND d.kind <> 'symbol' AND s.name = d.name
WHERE s.qualname IS NULL OR NOT contains(s.qualname, '.')
"""


@query("graph_resolve_symbols", f"SELECT src, dst, mode, CASE WHEN mode = 'name_fallback_ambiguous' THEN candidates END AS candidates FROM ({_RESOLVED})")
def graph_resolve_symbols(spark: SparkSession, d: str) -> DataFrame:
    found = graph.resolve_symbols(star.of(spark, d, star.CODE_NODES))
    part = lambda k: F.get_json_object("evidence", f"$.{k}")
    return found.select("src", "dst", part("resolution_mode").alias("mode"), part("candidate_count").cast("bigint").alias("candidates"))


@query("graph_callers", f"""
WITH n AS ({_CN}), e AS ({_CE}), r AS ({_RESOLVED}), stub AS (SELECT src AS stub FROM r WHERE dst = 'fn:8'),
direct AS (SELECT src AS id, evidence, 0 AS phase, '' AS stub FROM e WHERE rel = 'CALLS' AND dst = 'fn:8'),
via AS (SELECT e.src AS id, e.evidence, 1 AS phase, stub FROM e JOIN stub ON e.dst = stub.stub WHERE e.rel = 'CALLS'),
ok AS (SELECT via.* FROM via JOIN n ON n.id = via.id LEFT JOIN n m ON m.kind = 'module' AND m.module_path = n.module_path
  WHERE NOT EXISTS (SELECT 1 FROM e i WHERE i.src = m.id AND i.rel = 'IMPORTS' AND split_part(i.dst, '.', -1) = split_part(json_extract_string(via.evidence, '$.expr'), '.', -1))
  OR EXISTS (SELECT 1 FROM e i JOIN stub ON i.dst = stub.stub WHERE i.src = m.id AND i.rel = 'IMPORTS' AND split_part(i.dst, '.', -1) = split_part(json_extract_string(via.evidence, '$.expr'), '.', -1))),
every AS (SELECT * FROM direct UNION ALL SELECT * FROM ok)
SELECT n.id, n.name, CAST(json_extract_string(evidence, '$.lineno') AS INTEGER) AS call_site_lineno FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY phase, stub) = 1) x JOIN n USING (id)
""")
def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = star.of(spark, d, star.CODE_NODES), star.of(spark, d, star.CODE_EDGES)
    every = edges.unionByName(graph.resolve_symbols(nodes))
    return graph.callers_of(nodes, every, "fn:8").select("id", "name", "call_site_lineno")


@query("graph_stats", f"""
SELECT n.*, e.total_edges FROM (SELECT count(*) AS total_nodes, count(*) FILTER (kind <> 'symbol') AS meaningful_nodes, count(*) FILTER (kind = 'module') AS module_count, count(*) FILTER (kind = 'class') AS class_count,
  count(*) FILTER (kind = 'function') AS function_count, count(*) FILTER (kind = 'method') AS method_count,
  round(count(*) FILTER (kind IN ('function', 'method') AND docstring <> '') / CAST(count(*) FILTER (kind IN ('function', 'method')) AS DOUBLE), 3) AS docstring_coverage FROM ({_CN})) n, (SELECT count(*) AS total_edges FROM ({_CE})) e
""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(star.of(spark, d, star.CODE_NODES), star.of(spark, d, star.CODE_EDGES))


@query("graph_stats_snapshots", f"SELECT (SELECT count(*) FROM ({_DN})) AS total_nodes, (SELECT count(*) FROM ({_DE})) AS total_edges, (SELECT count(*) FROM ({star.text(star.SNAPSHOTS)})) AS snapshot_count")
def graph_stats_snapshots(spark: SparkSession, d: str) -> DataFrame:
    found = graph.stats(star.of(spark, d, star.DOC_NODES), star.of(spark, d, star.DOC_EDGES), _snapshots(spark, d))
    return found.select("total_nodes", "total_edges", "snapshot_count")


@query("graph_coverage", f"SELECT round(avg(CASE WHEN trim(coalesce(docstring, '')) <> '' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM ({_CN}) WHERE kind IN ('function', 'module')")
def graph_coverage(spark: SparkSession, d: str) -> DataFrame:
    return graph.coverage(star.of(spark, d, star.CODE_NODES), ["function", "module"]).select(F.round("coverage", 6).alias("coverage"))


@query("graph_degree", f"SELECT node_id, 'degree' AS metric, CAST(count(*) AS DOUBLE) AS score FROM (SELECT src AS node_id FROM ({_E}) UNION ALL SELECT dst FROM ({_E})) GROUP BY node_id")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_metrics(star.of(spark, d, star.EDGES))


# ---- vectors ----


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.concat(F.lit("document:"), "vec_id").alias("id"), F.col("label").cast("string").alias("kind"), F.col("embedding").alias("vector"))


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return _t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


_V = "(SELECT concat('document:', vec_id) AS id, CAST(label AS VARCHAR) AS kind, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _knn_sql(vec_id: int, k: int, where: str = "true") -> str:
    return f"SELECT a.id, a.kind, round(list_cosine_distance(a.v, q.v), 6) AS distance, CAST(row_number() OVER (ORDER BY list_cosine_distance(a.v, q.v), a.id) - 1 AS INTEGER) AS rank FROM {_V} a, (SELECT v FROM {_V} WHERE vec_id = {vec_id}) q WHERE {where} QUALIFY rank < {k}"


def _near(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", F.round("_distance", 6).alias("distance"), "rank")


@query("vec_knn", _knn_sql(7, 10))
def vec_knn(spark: SparkSession, d: str) -> DataFrame:
    return _near(vectors.search(_vectors(spark, d), _vector(spark, d, 7), 10))


@query("vec_knn_prefilter", _knn_sql(7, 10, "a.kind = '2'"))
def vec_knn_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return _near(vectors.search(_vectors(spark, d), _vector(spark, d, 7), 10, "kind = '2'"))


_Q8 = "list_transform(v, lambda x: greatest(-128.0, least(127.0, round_even(x * 127, 0))))"


@query("vec_knn_int8", f"SELECT a.id, round(list_cosine_distance(a.w, q.w), 6) AS distance FROM (SELECT id, {_Q8} AS w FROM {_V}) a, (SELECT {_Q8} AS w FROM {_V} WHERE vec_id = 7) q ORDER BY list_cosine_distance(a.w, q.w), a.id LIMIT 10")
def vec_knn_int8(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(_vectors(spark, d), _vector(spark, d, 7), 10, int8=True).select("id", F.round("_distance", 6).alias("distance"))


_MANY = f"""
SELECT q.vec_id AS query_id, a.id, round(list_cosine_distance(a.v, q.v), 6) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(a.v, q.v), a.id) - 1 AS INTEGER) AS rank
FROM {_V} a, (SELECT vec_id, v FROM {_V} WHERE vec_id % 20 = 0) q QUALIFY rank < 5
"""


@query("vec_knn_multi_query", _MANY)
@query("vec_knn_multi_query_share", _MANY)
def vec_knn_multi_query(spark: SparkSession, d: str) -> DataFrame:
    queries = _t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.search_many(_vectors(spark, d), queries, 5).select("query_id", "id", F.round("_distance", 6).alias("distance"), "rank")


@query("vec_delete_ids", f"SELECT id FROM {_V} WHERE vec_id % 3 <> 0")
def vec_delete_ids(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    gone = _t(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.concat(F.lit("document:"), "vec_id").alias("id"))
    return vectors.existing_ids(vectors.delete_ids(v, gone))


@query("vec_upsert", f"SELECT id, CASE WHEN vec_id < 50 THEN 'new' ELSE kind END AS kind FROM {_V}")
def vec_upsert(spark: SparkSession, d: str) -> DataFrame:
    batch = _t(spark, d, "embeddings").where("vec_id < 50").select(F.concat(F.lit("document:"), "vec_id").alias("id"), F.lit("new").alias("kind"), F.col("embedding").alias("vector"))
    return vectors.upsert_vectors(_vectors(spark, d), batch.unionByName(batch)).select("id", "kind")


@query("vec_store_merge", f"SELECT id, CASE WHEN vec_id % 50 = 0 THEN 'back' WHEN vec_id < 50 THEN 'new' ELSE kind END AS kind FROM {_V} WHERE vec_id % 3 <> 0 OR vec_id % 50 = 0")
def vec_store_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "embeddings").select("vec_id", F.concat(F.lit("document:"), "vec_id").alias("id"), F.col("label").cast("string").alias("kind"), F.col("embedding").alias("vector"))
    with scratch(spark) as folder:
        store = VectorTables(spark, folder)
        store.upsert(rows.drop("vec_id"))
        store.upsert(rows.where("vec_id < 50").drop("vec_id").withColumn("kind", F.lit("new")))
        store.delete_ids(rows.where("vec_id % 3 = 0").select("id"))
        store.upsert(rows.where("vec_id % 50 = 0").drop("vec_id").withColumn("kind", F.lit("back")))
        found = checkpointed(store.rows.select("id", "kind"))
    return found


@query("vec_index_rows", f"SELECT id, kind, CAST(4 AS INTEGER) AS n_codes, true AS in_a_cell FROM {_V}")
def vec_index_rows(spark: SparkSession, d: str) -> DataFrame:
    index = ivf.build(_vectors(spark, d))
    return index.rows.select("id", "kind", F.size("codes").alias("n_codes"), ((F.col("cell") >= 0) & (F.col("cell") < index.cells)).alias("in_a_cell"))


@query("vec_knn_ivf")
def vec_knn_ivf(spark: SparkSession, d: str) -> DataFrame:
    # approximate, so without SQL; tests measure its recall
    queries = _t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    with scratch(spark) as folder:
        ivf.save(ivf.build(_vectors(spark, d)), folder)
        index = ivf.load(spark, folder)
        found = checkpointed(ivf.search_many(index, queries, 5, probes=ivf.probes_for(index, 5)))
    return found.select("query_id", "id", F.round("_distance", 6).alias("distance"), "rank")


@query("vec_knn_ivf_whole", _MANY)
def vec_knn_ivf_whole(spark: SparkSession, d: str) -> DataFrame:
    # every cell is probed and every row compared exactly: the index loses no row and no distance
    queries = _t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = ivf.build(_vectors(spark, d))
    found = ivf.search_many(index, queries, 5, probes=index.cells, refine=ivf.BLOCK)
    return found.select("query_id", "id", F.round("_distance", 6).alias("distance"), "rank")


@query("vec_norms", f"SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, len(list_filter({_Q8}, lambda x: x > 0)) AS positive FROM {_V}")
def vec_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    return _vectors(spark, d).select("id", F.round(F.sqrt(dot(v, v)), 6).alias("norm"), F.size(F.filter(to_int8(v), lambda x: x > 0)).cast("bigint").alias("positive"))


@query("vec_distance_of", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value + 1 WHEN 2 THEN 1 / (1 + value) ELSE event_id % 10 END AS distance FROM events")
def vec_distance_of(spark: SparkSession, d: str) -> DataFrame:
    # rows report a distance of their own, a distance, a score, or their rank only
    kind, value = F.col("event_id") % 4, F.col("value")
    found = vectors.distance_of(F.when(kind == 0, value), F.when(kind == 1, value + 1), F.when(kind == 2, value), F.col("event_id") % 10)
    return _t(spark, d, "events").select("event_id", found.alias("distance"))


@query("vec_knn_lsh")
def vec_knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    return _near(vectors.lsh_search(_vectors(spark, d), _vector(spark, d, 7), 10, probes=3))


# ---- text ----

_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query("text_tokens", f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n, CAST(len(list_distinct(list_filter({_TOK}, lambda t: length(t) >= 2))) AS BIGINT) AS uniq FROM documents")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    # the test texts hold no underscores between word characters
    return _t(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("n"), F.size(X.query_tokens(F.col("text"))).cast("bigint").alias("uniq"))


@query("text_docstring_signal", f"SELECT doc_id, round(CASE WHEN len({_TOK}) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.6 * least(1.0, len({_TOK}) / 40.0) + 0.4 * len(list_distinct({_TOK})) / len({_TOK}))) END, 6) AS signal FROM documents")
def text_docstring_signal(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.round(X.docstring_signal(F.col("text")), 6).alias("signal"))


_QT = "['the', 'of', 'and', 'rend']"


@query("text_lexical_overlap", f"SELECT id, round(len(list_intersect({_QT}, regexp_extract_all(lower(concat_ws(' ', coalesce(name, ''), coalesce(qualname, ''), coalesce(module_path, ''), coalesce(docstring, ''))), '[a-z0-9_]+'))) / 4.0, 6) AS overlap FROM ({_DN})")
def text_lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = star.of(spark, d, star.DOC_NODES)
    q = X.query_tokens(X.normalize_query(F.lit("the_of and-rend")))
    return n.select("id", F.round(X.lexical_overlap(q, F.col("name"), F.col("qualname"), F.col("module_path"), F.col("docstring")), 6).alias("overlap"))


@query("text_index_text", f"""
SELECT id, concat_ws(chr(10), concat('KIND: ', kind), concat('NAME: ', name), CASE WHEN qualname <> '' THEN concat('QUALNAME: ', qualname) END, CASE WHEN module_path <> '' THEN concat('MODULE: ', module_path) END,
  CASE WHEN lineno IS NOT NULL THEN concat('LINE: ', lineno) END, CASE WHEN docstring <> '' THEN concat('DOCSTRING:', chr(10), trim(docstring)) END,
  CASE WHEN len(k) > 0 THEN concat('KEYWORDS: ', array_to_string(k, ' ')) END) AS text
FROM (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i AND NOT list_contains(regexp_extract_all(lower(coalesce(docstring, '')), '[a-z]+'), x)) AS k
  FROM (SELECT *, list_filter(list_transform(regexp_extract_all(concat_ws(' ', name, qualname, module_path), '[a-zA-Z]+'), lambda x: lower(x)), lambda x: length(x) > 2) AS w FROM ({_N}) WHERE kind IN ('nation', 'part', 'supplier')))
""")
def text_index_text(spark: SparkSession, d: str) -> DataFrame:
    n = graph.query_nodes(star.of(spark, d, star.NODES), ["nation", "part", "supplier"])
    return n.select("id", X.index_text(*map(F.col, ("kind", "name", "qualname", "module_path", "lineno", "docstring"))).alias("text"))


@query("text_metadata", f"SELECT id, json_extract_string(metadata, '$.lang') AS lang, CAST(json_extract_string(metadata, '$.n_chars') AS BIGINT) AS n_chars FROM ({_DN})")
def text_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = X.metadata_map(F.col("metadata"))
    return star.of(spark, d, star.DOC_NODES).select("id", m["lang"].alias("lang"), m["n_chars"].cast("bigint").alias("n_chars"))


@query("text_labels", "SELECT p_partkey, replace(concat(p_brand, '_', p_type), '_', ' ') AS label, greatest(0, p_size % 7 * 10 - p_size) AS n_lines, trim(concat(p_name, ' ')) AS spoken FROM part")
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("<think>a plan\nof it</think> "), "p_name", F.lit(" <think></think>"))
    size = F.col("p_size")
    return _t(spark, d, "part").select("p_partkey", X.metric_label(F.concat("p_brand", F.lit("_"), "p_type")).alias("label"), X.line_count(size, size % 7 * 10).alias("n_lines"), X.strip_thinking(said).alias("spoken"))


@query("text_colors", "SELECT p_partkey, concat('rgba(', p_size, ',', p_size + 100, ',0,', printf('%.3f', least(1.0, p_size / 40.0)), ')') AS color FROM part")
def text_colors(spark: SparkSession, d: str) -> DataFrame:
    color = F.format_string("#%02x%02x00", F.col("p_size"), F.col("p_size") + 100)
    return _t(spark, d, "part").select("p_partkey", X.with_alpha(color, F.col("p_size") / 40.0).alias("color"))


# ---- retrieval ----


def _retrieve_sql(mode: str, k: int = 8, hop: int = 1, max_nodes: int = 25, cap: int | None = None, min_score: float = 0.0) -> str:
    """CTEs ending in ``kept``: the rows that a query returns, before scores are scaled."""
    key = {"legacy": "best_hop, dist", "semantic": "-sem, best_hop", "hybrid": "-(0.7 * sem + 0.3 * lex), best_hop"}[mode]
    limit = f"QUALIFY module_path IS NULL OR row_number() OVER (PARTITION BY module_path ORDER BY {key}, id) <= {cap}" if cap else ""
    return f"""
WITH RECURSIVE n AS ({_DN}), e AS ({_DE}),
seeds AS (SELECT a.id, list_cosine_distance(a.v, q.v) AS d FROM {_V} a, (SELECT v FROM {_V} WHERE vec_id = 3) q ORDER BY d, a.id LIMIT {k}),
s AS (SELECT * FROM seeds WHERE 1 / (1 + greatest(0, d)) >= {min_score}),
u AS (SELECT src AS a, dst AS b FROM e WHERE rel IN ('CONTAINS', 'CALLS', 'IMPORTS', 'INHERITS') UNION SELECT dst, src FROM e WHERE rel IN ('CONTAINS', 'CALLS', 'IMPORTS', 'INHERITS')),
walk AS (SELECT id, 0 AS hop, id AS seed FROM s UNION SELECT u.b, hop + 1, seed FROM walk JOIN u ON walk.id = u.a WHERE hop < {hop}),
best AS (SELECT id, min(hop) AS best_hop FROM walk GROUP BY id),
reached AS (SELECT id, best_hop, min(seed) AS via_seed FROM best JOIN walk USING (id) WHERE hop = best_hop GROUP BY 1, 2),
scored AS (SELECT n.*, best_hop, via_seed, coalesce(s.d, 1e9) AS dist, 1 / (1 + greatest(0, coalesce(s.d, 1e9))) AS sem,
  len(list_intersect({_QT}, regexp_extract_all(lower(concat_ws(' ', coalesce(name, ''), coalesce(qualname, ''), coalesce(module_path, ''), coalesce(docstring, ''))), '[a-z0-9_]+'))) / 4.0 AS lex
  FROM reached JOIN n USING (id) LEFT JOIN s ON s.id = via_seed WHERE n.kind <> 'symbol'),
capped AS (SELECT * FROM scored {limit}),
kept AS (SELECT *, {"0.7 * sem + 0.3 * lex" if mode == "hybrid" else "sem"} AS raw FROM capped ORDER BY {key}, id LIMIT {max_nodes})
"""


_SHOWN = "SELECT id, kind, CAST(best_hop AS INTEGER) AS hop, via_seed, round(round(raw / max(raw) OVER (), 6), 5) AS score, round(sem, 6) AS semantic, round(lex, 6) AS lexical FROM kept"


def _retrieved(spark: SparkSession, d: str, **how) -> retrieve.Retrieved:
    return retrieve.query(star.of(spark, d, star.DOC_NODES), star.of(spark, d, star.DOC_EDGES), _vectors(spark, d), _vector(spark, d, 3), "the_of and-rend", **how)


def _shown(r: retrieve.Retrieved) -> DataFrame:
    return r.nodes.select("id", "kind", "hop", "via_seed", F.round("score", 5).alias("score"), F.round("semantic", 6).alias("semantic"), F.round("lexical", 6).alias("lexical"))


@query("query_legacy", _retrieve_sql("legacy") + _SHOWN)
def query_legacy(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_retrieved(spark, d))


@query("query_semantic", _retrieve_sql("semantic") + _SHOWN)
def query_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_retrieved(spark, d, mode="semantic"))


@query("query_hybrid", _retrieve_sql("hybrid", hop=2, max_nodes=40) + _SHOWN)
def query_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_retrieved(spark, d, mode="hybrid", hop=2, max_nodes=40))


@query("query_unknown_mode", _retrieve_sql("legacy") + _SHOWN)
def query_unknown_mode(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_retrieved(spark, d, mode="no such mode"))


@query("query_module_cap", _retrieve_sql("hybrid", hop=2, cap=2) + _SHOWN)
def query_module_cap(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_retrieved(spark, d, mode="hybrid", hop=2, max_per_module=2))


@query("query_min_score", _retrieve_sql("semantic", min_score=0.7) + _SHOWN)
def query_min_score(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_retrieved(spark, d, mode="semantic", min_score=0.7))


@query("query_edges", _retrieve_sql("legacy") + "SELECT src, rel, dst FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def query_edges(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d).edges.select("src", "rel", "dst")


@query("query_counters", _retrieve_sql("legacy") + "SELECT (SELECT count(*) FROM s) AS seeds, (SELECT count(*) FROM reached) AS expanded_nodes, (SELECT count(*) FROM kept) AS returned_nodes, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)) AS edges")
def query_counters(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d).counters()


# ---- snippets ----


@query("pack_spans", """
SELECT p_partkey, CAST(CASE WHEN p_type LIKE 'ECONOMY%' THEN 1 ELSE greatest(1, p_size - 5) END AS INTEGER) AS span_start,
  CAST(CASE WHEN p_type LIKE 'ECONOMY%' THEN least(55, 20) WHEN least(55, p_size + p_partkey % 30 + 5) - greatest(1, p_size - 5) + 1 > 20 THEN least(55, greatest(1, p_size - 5) + 19) ELSE least(55, p_size + p_partkey % 30 + 5) END AS INTEGER) AS span_end FROM part
""")
def pack_spans(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_type").startswith("ECONOMY"), "module").otherwise("function")
    span = X.compute_span(kind, F.col("p_size"), F.col("p_size") + (F.col("p_partkey") % 30).cast("int"), F.lit(55), 5, 20)
    return _t(spark, d, "part").withColumn("s", span).select("p_partkey", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


_FITS = "len(starts) < 5 AND len(list_filter(starts, lambda x: NOT (x + 8 < r.s OR r.s + 8 < x))) = 0"


@query("pack_greedy_dedup", f"""
WITH RECURSIVE r AS (SELECT p_partkey AS id, concat(p_brand, '/', p_type) AS module_path, p_size AS s, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS i FROM part),
g AS (SELECT id, module_path, s, i, true AS kept, [s] AS starts FROM r WHERE i = 1
  UNION ALL SELECT r.id, r.module_path, r.s, r.i, {_FITS}, CASE WHEN {_FITS} THEN list_append(starts, r.s) ELSE starts END FROM g JOIN r ON r.module_path = g.module_path AND r.i = g.i + 1)
SELECT id, module_path, s AS span_start, s + 6 AS span_end FROM g WHERE kept
""")
def pack_greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), "p_type").alias("module_path"), (-F.col("p_retailprice")).alias("k1"), F.col("p_size").alias("span_start"), (F.col("p_size") + 6).alias("span_end"))
    return retrieve.greedy_spans(rows, ("k1", "id"), 5).select("id", "module_path", "span_start", "span_end")


@query("pack_snippets", """
SELECT doc_id, array_to_string(list_transform(l[2:4], lambda x, i: concat(lpad(CAST(i + 1 AS VARCHAR), 5, ' '), ': ', x)), chr(10)) AS snippet FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)
""")
def pack_snippets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.snippet(X.lines(F.col("text")), F.lit(2), F.lit(4)).alias("snippet"))


@query("pack_relevance_tier", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN value / 100 >= 0.60 THEN 'HIGH' WHEN value / 100 >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM events) GROUP BY tier")
def pack_relevance_tier(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(X.relevance_tier(F.col("value") / 100).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


_LINES = "string_split(regexp_replace(text, '\\n$', ''), chr(10))"
_PACKED = _retrieve_sql("hybrid", max_nodes=15).replace(f"({_DN})", f"(SELECT * REPLACE (CASE WHEN kind = 'document' THEN id END AS module_path, CASE WHEN kind = 'document' THEN 1 END AS lineno) FROM ({_DN}))")


@query("pack_full", _PACKED + f"""
SELECT id, round(raw, 6) AS score, CAST(CASE WHEN module_path IS NOT NULL THEN 1 END AS INTEGER) AS span_start, CAST(CASE WHEN l IS NOT NULL THEN least(6, len(l)) END AS INTEGER) AS span_end,
  array_to_string(list_transform(l[1:6], lambda x, i: concat(lpad(CAST(i AS VARCHAR), 5, ' '), ': ', x)), chr(10)) AS snippet
FROM kept LEFT JOIN (SELECT concat('document:', doc_id) AS module_path, {_LINES} AS l FROM documents) USING (module_path)
""")
def pack_full(spark: SparkSession, d: str) -> DataFrame:
    nodes = star.of(spark, d, star.DOC_NODES).withColumn("module_path", F.when(F.col("kind") == "document", F.col("id"))).withColumn("lineno", F.when(F.col("kind") == "document", F.lit(1)))
    files = _t(spark, d, "documents").select(F.concat(F.lit("document:"), "doc_id").alias("module_path"), X.lines(F.col("text")).alias("lines"))
    out = retrieve.pack(nodes, star.of(spark, d, star.DOC_EDGES), _vectors(spark, d), files, _vector(spark, d, 3), "the of and rend", mode="hybrid")
    return out.nodes.select("id", F.round("score", 6).alias("score"), "span_start", "span_end", "snippet")


@query("pack_module_summary", f"""
SELECT id, array_to_string(list_transform(list_slice(list_concat([concat('# functions (', n, '):')], items, ['']), 1, 12), lambda x: concat('       ', x)), chr(10)) AS text
FROM (SELECT m.id, count(*) AS n, list(concat('#   ', f.qualname, ' (', CASE WHEN coalesce(f.lineno, 0) <> 0 THEN concat('L', f.lineno) ELSE '?' END, ')',
    CASE WHEN trim(coalesce(f.docstring, '')) <> '' THEN concat(' — ', left(trim(f.docstring), 80)) ELSE '' END) ORDER BY coalesce(f.lineno, 0), f.id) AS items
  FROM ({_CN}) m JOIN ({_CE}) e ON e.src = m.id AND e.rel = 'CONTAINS' JOIN ({_CN}) f ON f.id = e.dst WHERE m.kind = 'module' GROUP BY m.id)
""")
def pack_module_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes = star.of(spark, d, star.CODE_NODES)
    return retrieve.module_summary(nodes, nodes, star.of(spark, d, star.CODE_EDGES), 12)


@query("pack_spans_overlap", "SELECT l_orderkey, l_linenumber, NOT (l_linenumber + 4 < l_partkey % 12 OR l_partkey % 12 + 3 < l_linenumber) AS meets FROM lineitem")
def pack_spans_overlap(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_linenumber"), F.col("l_partkey") % 12
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.spans_overlap(a, a + 2, b, b + 1).alias("meets"))


# orders as classes, their lines as methods, every other one without a line number
_SPAN_OF = "greatest(1, {0} - 2) AS s, least(60, {0} + {1} + 2) AS e"


@query("pack_parent_span", f"""
WITH o AS (SELECT concat('o:', o_orderkey) AS id, o_orderkey, {_SPAN_OF.format("(o_orderkey % 40 + 1)", "o_orderkey % 15")} FROM orders),
ow AS (SELECT id, o_orderkey, s, least(e, s + 11) AS e FROM o),
l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT id, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end, false AS warned FROM ow
UNION ALL SELECT concat('o:', l_orderkey, ':', l_linenumber), CAST(CASE WHEN l_linenumber % 2 = 0 THEN ow.s ELSE greatest(1, l_linenumber - 2) END AS INTEGER), CAST(CASE WHEN l_linenumber % 2 = 0 THEN ow.e ELSE l_linenumber + 2 END AS INTEGER), l_linenumber % 2 = 0
FROM l LEFT JOIN ow ON l_orderkey = o_orderkey
""")
def pack_parent_span(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = _t(spark, d, "orders"), _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    path = lambda k: F.concat(F.lit("f"), F.col(k) % 50)
    rows = orders.select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.lit("class").alias("kind"), F.concat(F.lit("O"), "o_orderkey").alias("qualname"), path("o_orderkey").alias("module_path"), (F.col("o_orderkey") % 40 + 1).cast("int").alias("lineno"), (F.col("o_orderkey") % 40 + 1 + F.col("o_orderkey") % 15).cast("int").alias("end_lineno"))
    numbered_line = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber").cast("int"))
    rows = rows.unionByName(lines.select(F.concat(F.lit("o:"), "l_orderkey", F.lit(":"), "l_linenumber").alias("id"), F.lit("method").alias("kind"), F.concat(F.lit("O"), "l_orderkey", F.lit(".l"), "l_linenumber").alias("qualname"), path("l_orderkey").alias("module_path"), numbered_line.alias("lineno"), numbered_line.alias("end_lineno")))
    files = orders.select(path("o_orderkey").alias("module_path")).distinct().withColumn("lines", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i.cast("string")))
    out = retrieve.with_spans(rows, files, 2, 12, "cap_or_skip")
    return out.select("id", F.col("span_start").cast("int").alias("span_start"), F.col("span_end").cast("int").alias("span_end"), F.col("warning").isNotNull().alias("warned"))


@query("pack_legacy_span", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE greatest(1, p_size - 2) END AS INTEGER) AS span_start, CAST(CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE least(60, p_size + 2) END AS INTEGER) AS span_end, false AS warned FROM part")
def pack_legacy_span(spark: SparkSession, d: str) -> DataFrame:
    # without a line number the whole file is shown, as far as its bound
    line = F.when(F.col("p_partkey") % 2 == 1, F.col("p_size")).cast("int")
    rows = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("function").alias("kind"), F.col("p_name").alias("qualname"), F.col("p_brand").alias("module_path"), line.alias("lineno"), line.alias("end_lineno"))
    files = rows.select("module_path").distinct().withColumn("lines", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i.cast("string")))
    out = retrieve.with_spans(rows, files, 2, 12, "legacy")
    return out.select(F.col("id").cast("bigint").alias("p_partkey"), F.col("span_start").cast("int").alias("span_start"), F.col("span_end").cast("int").alias("span_end"), F.col("warning").isNotNull().alias("warned"))


# ---- temporal ----

_TMP = f"""(SELECT event_id, occurred, p, CASE p WHEN 'year' THEN strptime(occurred || '-01-01', '%Y-%m-%d') WHEN 'month' THEN strptime(occurred || '-01', '%Y-%m-%d') WHEN 'day' THEN strptime(occurred, '%Y-%m-%d') WHEN 'time' THEN strptime(occurred, '%Y-%m-%dT%H:%M:%S') END AS i
  FROM (SELECT *, CASE WHEN regexp_full_match(occurred, '[0-9]{{4}}') THEN 'year' WHEN regexp_full_match(occurred, '[0-9]{{4}}-[0-9]{{2}}') THEN 'month' WHEN regexp_full_match(occurred, '[0-9-]{{10}}') THEN 'day' WHEN length(occurred) = 19 THEN 'time' END AS p FROM ({star.text(star.TEMPORAL)})))"""
_END = "CASE p WHEN 'year' THEN i + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND WHEN 'month' THEN i + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND WHEN 'day' THEN i + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND ELSE i END"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return star.of(spark, d, star.TEMPORAL).withColumn("span", TM.span(F.col("occurred"), none, none))


@query("temporal_parse", f"SELECT event_id, i AS instant, p AS prec FROM {_TMP}")
def temporal_parse(spark: SparkSession, d: str) -> DataFrame:
    t = TM.parse(F.col("occurred"))
    return star.of(spark, d, star.TEMPORAL).select("event_id", t["instant"].cast("timestamp_ntz").alias("instant"), t["precision"].alias("prec"))


@query("temporal_zones", "SELECT event_id, date_trunc('second', ts) - INTERVAL 1 HOUR * (event_id % 5) AS instant FROM events")
def temporal_zones(spark: SparkSession, d: str) -> DataFrame:
    written = F.concat(F.substring(F.col("ts").cast("string"), 1, 10), F.lit("T"), F.substring(F.col("ts").cast("string"), 12, 8), F.lit("+0"), (F.col("event_id") % 5).cast("string"), F.lit(":00"))
    return _t(spark, d, "events").select("event_id", TM.parse(written)["instant"].cast("timestamp_ntz").alias("instant"))


@query("temporal_spine_id", "SELECT event_id, concat('t:', CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y') WHEN 1 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END) AS spine FROM events")
def temporal_spine_id(spark: SparkSession, d: str) -> DataFrame:
    at, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    spine = F.when(kind == 0, TM.spine_id(at, "year")).when(kind == 1, TM.spine_id(at, "month")).otherwise(TM.spine_id(at))
    return _t(spark, d, "events").select("event_id", spine.alias("spine"))


@query("temporal_period_end", f"SELECT event_id, {_END} AS period_end FROM {_TMP} WHERE p IS NOT NULL")
def temporal_period_end(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).where("span is not null").select("event_id", F.col("span.end").cast("timestamp_ntz").alias("period_end"))


@query("temporal_overlap_window", f"SELECT event_id FROM {_TMP} WHERE p IS NOT NULL AND {_END} >= TIMESTAMP '2024-01-10' AND i <= TIMESTAMP '2024-01-12' + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND")
def temporal_overlap_window(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).where(TM.overlaps(F.col("span"), F.lit("2024-01-10"), F.lit("2024-01-12"))).select("event_id")


@query("temporal_spine", f"SELECT spine, count(*) AS n FROM (SELECT unnest(list_slice(['t:' || strftime(i, '%Y'), 't:' || strftime(i, '%Y-%m'), 't:' || strftime(i, '%Y-%m-%d')], 1, CASE p WHEN 'year' THEN 1 WHEN 'month' THEN 2 ELSE 3 END)) AS spine FROM {_TMP} WHERE p IS NOT NULL) GROUP BY spine")
def temporal_spine(spark: SparkSession, d: str) -> DataFrame:
    t = TM.parse(F.col("occurred"))
    rows = star.of(spark, d, star.TEMPORAL).withColumn("t", t).where("t is not null")
    return rows.select(F.explode(TM.spine_chain(F.col("t.instant"), F.col("t.precision"))).alias("spine")).groupBy("spine").agg(F.count("*").alias("n"))


@query("temporal_sort", f"SELECT event_id, strftime(coalesce(i, TIMESTAMP '0001-01-01'), '%Y-%m-%d %H:%M:%S') AS k FROM {_TMP} ORDER BY k, event_id")
def temporal_sort(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("event_id", F.date_format(TM.sort_key(F.col("span")), "yyyy-MM-dd HH:mm:ss").alias("k")).orderBy("k", "event_id")


@query("temporal_sort_all", f"SELECT event_id, k, row_number() OVER (ORDER BY k, event_id) AS rank FROM (SELECT event_id, strftime(coalesce(i, TIMESTAMP '0001-01-01'), '%Y-%m-%d %H:%M:%S') AS k FROM {_TMP})")
def temporal_sort_all(spark: SparkSession, d: str) -> DataFrame:
    rows = _spans(spark, d).select("event_id", F.date_format(TM.sort_key(F.col("span")), "yyyy-MM-dd HH:mm:ss").alias("k"))
    return numbered(rows, [F.col("k"), F.col("event_id")], "rank").select("event_id", "k", "rank")


@query("temporal_metadata", f"SELECT event_id, CASE p WHEN 'year' THEN strftime(i, '%Y') WHEN 'month' THEN strftime(i, '%Y-%m') WHEN 'day' THEN strftime(i, '%Y-%m-%d') WHEN 'time' THEN strftime(i, '%Y-%m-%dT%H:%M:%S') END AS occurred_start FROM {_TMP}")
def temporal_metadata(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return star.of(spark, d, star.TEMPORAL).select("event_id", TM.metadata(F.col("occurred"), none, none)["occurred_start"].alias("occurred_start"))


# intervals spread by key, as dates alone hold more overlaps the larger the tables are
_HOUR = "(SELECT {0} AS id, {1} * 3600 AS s, {1} * 3600 + {2} * 1800 AS e FROM {3})"
_HOURS = {"orders": ("o_orderkey", "o_orderkey", "(o_orderkey % 9)"), "lineitem": ("l_orderkey * 10 + l_linenumber", "(l_orderkey + l_linenumber)", "l_linenumber")}


_OVERLAPS = f"SELECT a.id AS left_id, b.id AS right_id FROM {_HOUR.format(*_HOURS['orders'], 'orders')} a JOIN {_HOUR.format(*_HOURS['lineitem'], 'lineitem')} b ON a.s <= b.e AND b.s <= a.e"


@query("temporal_overlap_join", _OVERLAPS)
@query("temporal_overlap_join_whole", _OVERLAPS)
def temporal_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    def side(name: str) -> DataFrame:
        i, first, halves = _HOURS[name]
        return _t(spark, d, name).selectExpr(f"{i} AS id", f"timestamp_seconds({first} * 3600) AS start", f"timestamp_seconds({first} * 3600 + {halves} * 1800) AS end")

    return temporal.overlap_join(side("orders"), side("lineitem"))


# ---- scores and display ----


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("node_id"), F.lit("price").alias("metric"), F.round("p_retailprice", 0).alias("score"))


_S = "(SELECT concat('part:', p_partkey) AS node_id, round(p_retailprice, 0) AS score FROM part)"
_RANKED = f"(SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS rank, count(*) OVER () AS n FROM {_S})"


@query("scores_rank_percentile", f"SELECT node_id, rank, round((n - rank) / CAST(n - 1 AS DOUBLE), 9) AS percentile FROM {_RANKED}")
def scores_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return scores.ranked(_scores(spark, d).drop("metric")).select("node_id", "rank", F.round("percentile", 9).alias("percentile"))


for _scaler, _part in (("rank", "(n - rank) / CAST(n - 1 AS DOUBLE)"), ("linear", "(score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ())"), ("log", "(ln(score + (1e-9 - min(score) OVER ())) - ln(min(score) OVER () + (1e-9 - min(score) OVER ()))) / (ln(max(score) OVER () + (1e-9 - min(score) OVER ())) - ln(min(score) OVER () + (1e-9 - min(score) OVER ())))")):

    @query(f"scores_scaled_{_scaler}", f"SELECT node_id, round(8 + 34 * ({_part}), 5) AS scaled FROM {_RANKED}")
    def _scaled(spark: SparkSession, d: str, scaler: str = _scaler) -> DataFrame:
        return scores.scaled(_scores(spark, d).drop("metric"), 8.0, 42.0, scaler).select("node_id", F.round("scaled", 5).alias("scaled"))


@query("scores_lookup", f"SELECT id AS node_id, round(coalesce(8 + 34 * ((n - rank) / CAST(n - 1 AS DOUBLE)), 25.0), 5) AS scaled FROM ({_N}) LEFT JOIN {_RANKED} ON node_id = id WHERE kind IN ('part', 'supplier')")
def scores_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = graph.query_nodes(star.of(spark, d, star.NODES), ["part", "supplier"]).select(F.col("id").alias("node_id"))
    found = scores.lookup(ids, scores.scaled(_scores(spark, d).drop("metric"), 8.0, 42.0, "rank"), 8.0, 42.0)
    return found.select("node_id", F.round("scaled", 5).alias("scaled"))


@query("scores_available", f"SELECT CAST(1 AS INTEGER) AS table_ord, 'price' AS metric, count(*) AS n FROM part UNION ALL SELECT 0, 'degree', count(DISTINCT x) FROM (SELECT src AS x FROM ({_E}) UNION ALL SELECT dst FROM ({_E}))")
def scores_available(spark: SparkSession, d: str) -> DataFrame:
    return scores.available([graph.degree_metrics(star.of(spark, d, star.EDGES)), _scores(spark, d)])


@query("scores_load", f"SELECT node_id, score FROM {_S}")
def scores_load(spark: SparkSession, d: str) -> DataFrame:
    return scores.load([graph.degree_metrics(star.of(spark, d, star.EDGES)), _scores(spark, d)], "price")


@query("display_select", f"""
WITH r AS (SELECT n.id, s.rank FROM ({_N}) n LEFT JOIN {_RANKED} s ON s.node_id = n.id), seed AS (SELECT id FROM r ORDER BY rank NULLS LAST, id LIMIT 15),
near AS (SELECT dst AS id FROM ({_E}) WHERE src IN (SELECT id FROM seed) UNION SELECT src FROM ({_E}) WHERE dst IN (SELECT id FROM seed))
SELECT id, CAST(CASE WHEN id IN (SELECT id FROM seed) THEN 0 WHEN id IN (SELECT id FROM near) THEN 1 ELSE 2 END AS INTEGER) AS tier FROM r ORDER BY tier, rank NULLS LAST, id LIMIT 60
""")
def display_select(spark: SparkSession, d: str) -> DataFrame:
    out = scores.select_for_display(star.of(spark, d, star.NODES), star.of(spark, d, star.EDGES), _scores(spark, d).drop("metric"), 60)
    return out.select("id", "tier")


# ---- snapshots ----

_SN = star.text(star.SNAPSHOTS)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = star.of(spark, d, star.SNAPSHOTS)
    counts = F.map_filter(F.create_map(F.lit("F"), "n_f", F.lit("O"), "n_o", F.lit("P"), "n_p"), lambda _, v: v > 0)
    return s.select("key", "branch", "timestamp", "version", "total_nodes", "total_edges", counts.alias("node_counts"), F.create_map(F.lit("PLACED"), "total_edges").alias("edge_counts"), "n_f", "n_o", "n_p")


@query("snap_delta_previous", f"""
SELECT key, total_nodes - lag(total_nodes) OVER w AS nodes_vs_previous, total_edges - lag(total_edges) OVER w AS edges_vs_previous,
  CASE WHEN row_number() OVER w > 1 THEN total_nodes - first_value(total_nodes) OVER w END AS nodes_vs_baseline FROM ({_SN}) WINDOW w AS (ORDER BY timestamp, key)
""")
def snap_delta_previous(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.with_deltas(_snapshots(spark, d)).select("key", "nodes_vs_previous", "edges_vs_previous", "nodes_vs_baseline")


@query("snap_list", f"SELECT key, timestamp, total_nodes - lag(total_nodes) OVER (ORDER BY timestamp, key) AS nodes_vs_previous FROM ({_SN}) WHERE branch = 'main' ORDER BY timestamp DESC, key DESC LIMIT 12")
def snap_list(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.listing(_snapshots(spark, d), 12, "main").select("key", "timestamp", "nodes_vs_previous")


@query("snap_diff", f"""
WITH s AS ({_SN}), f AS (SELECT key, unnest(['total', 'total', 'node_counts', 'node_counts', 'node_counts', 'edge_counts']) AS section, unnest(['nodes', 'edges', 'F', 'O', 'P', 'PLACED']) AS name, unnest([total_nodes, total_edges, n_f, n_o, n_p, total_edges]) AS v FROM s)
SELECT section, name, CAST(sum(CASE WHEN key = 's40' THEN v ELSE -v END) AS BIGINT) AS delta FROM f WHERE key IN ('s3', 's40') GROUP BY 1, 2 HAVING section <> 'node_counts' OR max(v) > 0
""")
def snap_diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.diff(_snapshots(spark, d), "s3", "s40")


@query("snap_prune", f"SELECT key FROM (SELECT key, lag((version, total_nodes, total_edges, n_f)) OVER w IS NOT DISTINCT FROM (version, total_nodes, total_edges, n_f) AND row_number() OVER w > 1 AS same, lead(key) OVER w IS NULL AS final FROM ({_SN}) WINDOW w AS (ORDER BY timestamp, key)) WHERE NOT same OR final")
def snap_prune(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.prune(_snapshots(spark, d), ["version", "total_nodes", "total_edges", "n_f"]).select("key")


@query("snap_previous", f"SELECT key, total_nodes FROM ({_SN}) WHERE timestamp < '1995-06' ORDER BY timestamp DESC, key DESC LIMIT 1")
def snap_previous(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.previous(_snapshots(spark, d), "1995-06").select("key", "total_nodes")


@query("snap_asof", f"""
WITH o AS (SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS at, CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE 'dev' END AS branch FROM orders)
SELECT o.o_orderkey, s.key AS snapshot, t.key AS of_branch FROM o ASOF LEFT JOIN ({_SN}) s ON o.at > s.timestamp ASOF LEFT JOIN ({_SN}) t ON o.branch = t.branch AND o.at > t.timestamp
""")
def snap_asof(spark: SparkSession, d: str) -> DataFrame:
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 7)
    asked = _t(spark, d, "orders").select("o_orderkey", day.alias("at"), F.when(F.col("o_orderkey") % 2 == 0, "main").otherwise("dev").alias("branch"))
    history = _snapshots(spark, d)
    first = snapshots.previous_of(asked, history).withColumn("whole", F.col("snapshot.key"))
    both = snapshots.previous_of(first.drop("snapshot"), history, by_branch=True)
    return both.select("o_orderkey", F.col("whole").alias("snapshot"), F.col("snapshot.key").alias("of_branch"))


@query("snap_save", f"SELECT key, total_nodes FROM ({_SN}) QUALIFY row_number() OVER (ORDER BY timestamp DESC, key DESC) > 1 UNION ALL SELECT * FROM (SELECT 'new', total_nodes FROM ({_SN}) ORDER BY timestamp DESC, key DESC LIMIT 1)")
def snap_save(spark: SparkSession, d: str) -> DataFrame:
    history = _snapshots(spark, d)
    new = history.orderBy(F.desc("timestamp"), F.desc("key")).limit(1).withColumns({"key": F.lit("new"), "timestamp": F.lit("9999-01")})
    return snapshots.save(history, new, ["version", "total_nodes", "total_edges", "n_f"]).select("key", "total_nodes")


@query("snap_broken", f"SELECT key, 'broken entry' AS problem FROM ({_SN}) WHERE branch = 'dev' UNION ALL SELECT concat('x', key), 'orphan file' FROM ({_SN}) WHERE branch = 'main'")
def snap_broken(spark: SparkSession, d: str) -> DataFrame:
    history = _snapshots(spark, d)
    main = history.where("branch = 'main'").select("key")
    return snapshots.broken(history, main.unionByName(main.select(F.concat(F.lit("x"), "key").alias("key"))))


@query("snap_load_latest", f"SELECT key, total_nodes, total_nodes - lag(total_nodes) OVER w AS nodes_vs_previous, total_edges - first_value(total_edges) OVER w AS edges_vs_baseline FROM ({_SN}) WINDOW w AS (ORDER BY timestamp, key) ORDER BY timestamp DESC, key DESC LIMIT 1")
def snap_load_latest(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.load(_snapshots(spark, d), "latest").select("key", "total_nodes", "nodes_vs_previous", "edges_vs_baseline")


@query("snap_cleaned", f"""
WITH p AS (SELECT key, branch, lag((version, total_nodes, total_edges, n_f)) OVER w IS NOT DISTINCT FROM (version, total_nodes, total_edges, n_f) AND row_number() OVER w > 1 AND lead(key) OVER w IS NOT NULL AS gone FROM ({_SN}) WINDOW w AS (ORDER BY timestamp, key))
SELECT count(*) FILTER (gone) AS pruned, count(*) FILTER (branch = 'dev') AS broken, CAST(0 AS BIGINT) AS orphans, count(*) FILTER (gone) + count(*) FILTER (branch = 'dev') AS total_cleaned FROM p
""")
def snap_cleaned(spark: SparkSession, d: str) -> DataFrame:
    history = _snapshots(spark, d)
    return snapshots.cleaned(history, ["version", "total_nodes", "total_edges", "n_f"], history.where("branch = 'main'").select("key"))


# ---- hits, ingestion, embedding ----


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.concat(F.lit("src"), F.col("user_id") % 25).alias("kg_name"), F.when(F.col("event_id") % 2 == 0, "My Diary").otherwise("code").alias("kg_kind"), F.concat(F.lit("n"), F.col("event_id") % 1500).alias("node_id"), F.col("event_type").alias("name"), F.lit("node").alias("kind"), (F.col("value") / 7).alias("score"), F.col("props").alias("summary"), F.lit(None).cast("string").alias("source_path"), "event_id")


_H = "(SELECT concat('src', user_id % 25) AS kg_name, CASE WHEN event_id % 2 = 0 THEN 'My Diary' ELSE 'code' END AS kg_kind, concat('n', event_id % 1500) AS node_id, event_type AS name, value / 7 AS score, event_id FROM events)"


@query("hits_hydrate", f"SELECT h.event_id, md5(CASE WHEN h.kg_name IN (SELECT DISTINCT source FROM documents) THEN coalesce(d.text, '') END) AS content_md5 FROM {_H} h LEFT JOIN documents d ON d.source = h.kg_name AND concat('n', d.doc_id) = h.node_id")
def hits_hydrate(spark: SparkSession, d: str) -> DataFrame:
    content = _t(spark, d, "documents").select(F.col("source").alias("kg_name"), F.concat(F.lit("n"), "doc_id").alias("id"), "text")
    return hits.hydrate(_hits(spark, d), content).select("event_id", F.md5("content").alias("content_md5"))


@query("hits_project", f"SELECT kg_name, kg_kind, node_id, name, round(score, 4) AS score, CASE WHEN lower(kg_kind) LIKE '%diary' THEN name END AS diary_time FROM {_H}")
def hits_project(spark: SparkSession, d: str) -> DataFrame:
    return hits.project(_hits(spark, d), True).select("kg_name", "kg_kind", "node_id", "name", "score", F.col("timestamp").alias("diary_time"))


@query("hits_context", "SELECT string_agg(concat('[', concat_ws(' · ', lang, source), ']', chr(10), trim(text)), chr(10) || chr(10) ORDER BY doc_id) AS context FROM (SELECT * FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 6)")
def hits_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("lang").alias("genre"), F.lit("").alias("author"), F.col("source").alias("title"), F.col("text").alias("content"))
    return hits.context(rows, 6)


def _files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".jpeg", ".markdown"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _t(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit("/note "), F.col("doc_id") % 300, ext).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")


_FS = "(SELECT doc_id, concat(source, '/', lang, '/', doc_id, '/note ', doc_id % 300, ['.md', '.txt', '.jpeg', '.markdown'][doc_id % 4 + 1]) AS path, sha256(text) AS sha, text FROM documents)"
_ING = f"(SELECT path, sha, CASE WHEN path LIKE '%.jpeg' THEN 'skipped' WHEN path <> min(path) FILTER (path NOT LIKE '%.jpeg') OVER (PARTITION BY sha) THEN 'skipped' ELSE 'ingested' END AS status FROM {_FS})"


@query("ingest_dedup", f"SELECT path AS source_path, sha AS sha256, status FROM {_ING}")
def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest(_files(spark, d).drop("doc_id"), None, "2024-01-01T00:00:00").select("source_path", "sha256", "status")


@query("ingest_ledger_summary", f"SELECT count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM {_ING}")
def ingest_ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    return ingest.summary(ingest.ingest(_files(spark, d).drop("doc_id"), None, "2024-01-01T00:00:00"))


_NAMES = """
WITH p AS (SELECT concat(source, '/', lang, '/', doc_id, '/note ', doc_id % 300, '.md') AS path, sha256(CAST(doc_id AS VARCHAR)) AS sha, concat('note-', doc_id % 300) AS stem FROM documents),
a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY path) = 1 THEN concat(stem, '.md') ELSE concat(stem, '-', substr(sha, 1, 8), '.md') END AS second FROM p)
SELECT path, CASE WHEN row_number() OVER (PARTITION BY second ORDER BY path) = 1 THEN second ELSE concat(stem, '-', sha, '.md') END AS staged_path FROM a
"""


@query("ingest_staged_names", _NAMES)
@query("ingest_staged_names_all", _NAMES)
def ingest_staged_names(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit("/note "), F.col("doc_id") % 300, F.lit(".md")).alias("path"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.lit(".md").alias("out_suffix"))
    return ingest.staged_names(files).select("path", "staged_path")


@query("ingest_problems", f"SELECT path AS source_path FROM {_ING} WHERE status <> 'ingested'")
def ingest_problems(spark: SparkSession, d: str) -> DataFrame:
    return ingest.problems(ingest.ingest(_files(spark, d).drop("doc_id"), None, "2024-01-01T00:00:00")).select("source_path")


@query("ingest_texts", f"SELECT i.path AS source_path, md5(f.text) AS text_md5 FROM {_ING} i JOIN {_FS} f USING (path) WHERE status = 'ingested'")
def ingest_texts(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.ingest(_files(spark, d).drop("doc_id"), None, "2024-01-01T00:00:00")
    return out.where("status = 'ingested'").select("source_path", F.md5("text").alias("text_md5"))


@query("ingest_has_ingested", f"SELECT doc_id, sha AS sha256, sha IN (SELECT sha FROM {_FS} WHERE path NOT LIKE '%.jpeg' AND doc_id % 3 = 0) AS ingested FROM {_FS}")
def ingest_has_ingested(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    ledger = ingest.ingest(files.where("doc_id % 3 = 0").drop("doc_id"), None, "2024-01-01T00:00:00")
    return ingest.has_ingested(ledger, files.select("doc_id", F.sha2("content", 256).alias("sha256"))).select("doc_id", "sha256", "ingested")


@query("embed_sample", "SELECT DISTINCT CAST(round_even(i * ((SELECT count(*) FROM documents) - 1) / 16.0, 0) AS BIGINT) AS pos FROM range(17) r(i)")
def embed_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.where(embed.sample_positions(F.col("doc_id"), docs.count(), 17)).select(F.col("doc_id").alias("pos"))


@query("embed_corpus")
def embed_corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    entries = F.filter(F.transform("vector", lambda x, i: F.struct(i.alias("at"), F.round(x, 4).alias("x"))), lambda e: e["x"] != 0)
    return embed.embed_corpus(rows).select("pos", F.to_json(entries).alias("entries"))


@query("embed_index", f"SELECT t.id, n.kind, CAST(384 AS INTEGER) AS dim, md5(t.text) AS text_md5 FROM ({ORACLE_SQL['text_index_text']}) t JOIN ({_N}) n USING (id) WHERE n.kind IN ('nation', 'part')")
def embed_index(spark: SparkSession, d: str) -> DataFrame:
    return embed.build_index(star.of(spark, d, star.NODES), ["nation", "part"]).select("id", "kind", F.size("vector").alias("dim"), F.md5("text").alias("text_md5"))


# ---- layouts ----


@query("layout_funnel", f"""
SELECT id, round(r * cos(i * pi() * (3 - sqrt(5))), 6) AS x, round(r * sin(i * pi() * (3 - sqrt(5))), 6) AS y, CAST(level * 10.0 AS DOUBLE) AS z
FROM (SELECT id, level, i, greatest(4.0, 0.5 * sqrt(n)) * sqrt(i / greatest(n - 1, 1)) AS r FROM (SELECT id, level, CAST(row_number() OVER (PARTITION BY level ORDER BY id) - 1 AS DOUBLE) AS i, count(*) OVER (PARTITION BY level) AS n
  FROM (SELECT id, CASE kind WHEN 'region' THEN 3 WHEN 'nation' THEN 2 WHEN 'supplier' THEN 1 ELSE 0 END AS level FROM ({_N}) WHERE kind IN ('region', 'nation', 'supplier', 'customer'))))
""")
def layout_funnel(spark: SparkSession, d: str) -> DataFrame:
    n = graph.query_nodes(star.of(spark, d, star.NODES), ["region", "nation", "supplier", "customer"])
    out = layout.funnel(n, {"region": 3, "nation": 2, "supplier": 1})
    return out.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


_SPHERE = "CASE WHEN {n} <= 1 THEN 0.0 ELSE {r} * sqrt(greatest(0.0, 1 - pow(1 - {i} / greatest(1, {n} - 1) * 2, 2))) * cos(pi() * (3 - sqrt(5)) * {i}) END AS dx, CASE WHEN {n} <= 1 THEN 0.0 ELSE {r} * (1 - {i} / greatest(1, {n} - 1) * 2) END AS dy, CASE WHEN {n} <= 1 THEN {r} ELSE {r} * sqrt(greatest(0.0, 1 - pow(1 - {i} / greatest(1, {n} - 1) * 2, 2))) * sin(pi() * (3 - sqrt(5)) * {i}) END AS dz"


@query("layout_allium", f"""
WITH n AS (SELECT * FROM ({_N}) WHERE kind IN ('region', 'nation', 'supplier', 'part')), e AS (SELECT DISTINCT src, dst FROM ({_E}) WHERE rel = 'CONTAINS'),
r AS (SELECT id, i, n, 8.0 + i * (greatest(20.0, 8 + sqrt(n) * 4) - 8.0) / greatest(1, n - 1) AS rad FROM (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS DOUBLE) AS i, count(*) OVER () AS n FROM n WHERE kind = 'region')),
p0 AS (SELECT id, rad * cos(pi() * (3 - sqrt(5)) * i) AS x, rad * sin(pi() * (3 - sqrt(5)) * i) AS y, 0.0 AS z FROM r),
c1 AS (SELECT dst AS id, x, y, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS DOUBLE) AS i, count(*) OVER (PARTITION BY src) AS m FROM p0 JOIN e ON e.src = p0.id JOIN n ON n.id = e.dst),
p1 AS (SELECT id, x + dx AS x, y + dy AS y, 8.0 + dz AS z FROM (SELECT *, {_SPHERE.format(n="m", i="i", r="(2.0 + sqrt(m) * 0.4)")} FROM c1)),
c2 AS (SELECT dst AS id, x, y, z, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS DOUBLE) AS i, count(*) OVER (PARTITION BY src) AS m FROM p1 JOIN e ON e.src = p1.id JOIN n ON n.id = e.dst),
p2 AS (SELECT id, x + dx AS x, y + dy AS y, z + dz AS z FROM (SELECT *, {_SPHERE.format(n="m", i="i", r="(0.8 + sqrt(m) * 0.15)")} FROM c2)),
o AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS DOUBLE) AS i, count(*) OVER () AS m FROM n WHERE id NOT IN (SELECT id FROM p0 UNION SELECT id FROM p1 UNION SELECT id FROM p2)),
p3 AS (SELECT id, dx AS x, dy AS y, 3.0 + dz AS z FROM (SELECT *, {_SPHERE.format(n="m", i="i", r="3.0")} FROM o))
SELECT id, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
""")
def layout_allium(spark: SparkSession, d: str) -> DataFrame:
    n = graph.query_nodes(star.of(spark, d, star.NODES), ["region", "nation", "supplier", "part"])
    out = layout.allium(n, star.of(spark, d, star.EDGES), root_kind="region")
    return out.select("id", *((F.round(c, 5) + 0.0).alias(c) for c in ("x", "y", "z")))


@query("layout_organic")
def layout_organic(spark: SparkSession, d: str) -> DataFrame:
    points = _t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("tree_key"), (F.col("s_suppkey") % 7).cast("double").alias("x"), (F.col("s_suppkey") % 5).cast("double").alias("y"), (2 + F.col("s_suppkey") % 3).cast("double").alias("z"))
    return layout.grow(points)


# ---- streaming ----

_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_tumbling", f"SELECT user_id, w_start, w_start + INTERVAL 1 DAY AS w_end, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w_start FROM events) GROUP BY 1, 2 HAVING w_start + INTERVAL 1 DAY <= {_CLOSED}")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return streams.drain(streams.tumbling(streams.events_stream(spark, d)))


@query("stream_sliding", f"SELECT user_id, w_start, w_start + INTERVAL 1 DAY AS w_end, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w_start FROM events) GROUP BY 1, 2 HAVING w_start + INTERVAL 1 DAY <= {_CLOSED}")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return streams.drain(streams.sliding(streams.events_stream(spark, d)))


@query("stream_session", f"""
SELECT user_id, min(ts) AS w_start, max(ts) + INTERVAL 30 MINUTE AS w_end, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}
""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return streams.drain(streams.session(streams.events_stream(spark, d)))


@query("stream_timeline", """
SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS id, event_type AS value, ts AS span_start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS span_end FROM events)
WHERE span_end < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)
""")
def stream_timeline(spark: SparkSession, d: str) -> DataFrame:
    spans = timeline.timeline(streams.events_stream(spark, d), F.col("user_id"), F.col("event_id"), "ts", F.col("event_type"))
    return streams.drain(spans.select("key", "id", "value", F.col("start").cast("timestamp_ntz").alias("span_start"), F.col("end").cast("timestamp_ntz").alias("span_end")))


@query("stream_embed", "SELECT doc_id AS pos, text, CAST(384 AS INTEGER) AS n_dims FROM documents")
def stream_embed(spark: SparkSession, d: str) -> DataFrame:
    texts = streams.table_stream(spark, d, "documents", "doc_id long, text string").withColumnRenamed("doc_id", "pos")
    with scratch(spark) as folder:
        streams.embed_stream(texts, folder).awaitTermination()
        found = checkpointed(streams.read_shards(spark, folder).select("pos", "text", F.size("vector").alias("n_dims")))
    return found
