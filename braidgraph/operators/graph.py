"""Property-graph operators over ``nodes`` and ``edges`` DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.functions.text import call_site_line
from braidgraph.plans.lineage import checkpointed
from braidgraph.schema import DEFAULT_RELS


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str | None = None, ranges: bool = False) -> DataFrame:
    """``current`` with the rows of ``batch``; the last write of a key replaces its whole row.

    ``seq`` names a column of ``batch`` that orders writes of one key, those without it
    first; it is dropped. Without it the batch's own order holds: that of its partitions
    and the rows in them, as they are read from files or made from a list. A row of
    the batch always replaces a stored one. Columns may be of any type.
    With ``ranges`` the rows come in ranges of their keys, sorted; writes of one key then
    meet in its range, sorted and not held, instead of in part before the shuffle.
    """
    order, new = "__seq", "__new"
    late = batch.withColumn(order, F.col(seq).cast("long") if seq else F.monotonically_increasing_id()).withColumn(new, F.lit(True))
    late = late.drop(seq) if seq else late
    both = current.withColumn(order, F.lit(None).cast("long")).withColumn(new, F.lit(False)).unionByName(late, allowMissingColumns=True)
    names = [c for c in both.columns if c not in (order, new)]
    rest = [c for c in names if c not in keys]
    # what decides between writes of equal order
    sortable = [f.name for f in both.schema.fields if f.name in rest and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    if ranges:
        both = both.repartitionByRange(*keys)
    # a maximum, as it is taken in part before the shuffle however often a key is written
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), F.struct(new, order, *sortable)).alias("__last"))
    return last.select(*(c if c in keys else F.col("__last")[c].alias(c) for c in names))


def query_nodes(nodes: DataFrame, kinds: Sequence[str] | None = None, module: str | None = None) -> DataFrame:
    """Nodes of some kinds and one module; empty ``kinds`` means any."""
    out = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    return out.where(F.col("module_path") == module) if module is not None else out


def in_store_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.asc_nulls_first("module_path"), F.asc_nulls_first("lineno"), "id")


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id).limit(1)


def edges_from(edges: DataFrame, node_id: str, rel: str = "CALLS", limit: int | None = None) -> DataFrame:
    out = edges.where((F.col("src") == node_id) & (F.col("rel") == rel))
    return out.orderBy("dst").limit(limit) if limit is not None else out


def edges_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``ids`` (column id)."""
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return inside.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def undirected(edges: DataFrame, rels: Sequence[str] = DEFAULT_RELS) -> DataFrame:
    kept = edges.where(F.col("rel").isin(*rels)) if rels else edges.where(F.lit(False))
    return kept.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(kept.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def expand(edges: DataFrame, seeds: DataFrame, hop: int = 1, rels: Sequence[str] = DEFAULT_RELS) -> DataFrame:
    """(id, best_hop, via_seed) of all nodes within ``hop`` steps of a seed, either way.

    Seeds come back even if no edge or node knows them. ``via_seed`` is the smallest of
    the nearest seeds. Each level joins only the nodes found last and is checkpointed;
    above one hop the edges are read once, into (a, b) checkpointed by ``a``.
    """
    both = undirected(edges, rels)
    if hop > 1:
        both = checkpointed(both.repartition("a"))
    last = seeds.select("id").distinct().select("id", F.lit(0).alias("best_hop"), F.col("id").alias("via_seed"))
    found = last = checkpointed(last)
    for level in range(1, hop + 1):
        reached = last.join(both, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("via_seed").alias("via_seed"))
        new = reached.join(found.select("id"), "id", "left_anti").select("id", F.lit(level).alias("best_hop"), "via_seed")
        last = checkpointed(new)
        found = found.unionByName(last)
        if last.isEmpty():
            break
    return found


def dotted_variants(path: Column) -> Column:
    """Dotted module names of a file path: as it is, and without a leading ``src.``."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.when(path.isNotNull() & (path != ""), F.array_distinct(F.array(dotted, F.regexp_replace(dotted, r"^src\.", ""))))


def resolve_symbols(nodes: DataFrame) -> DataFrame:
    """RESOLVES_TO edges from symbol stubs to definitions: by dotted name, else by plain name."""
    stubs = nodes.where("kind = 'symbol' and name is not null and name != ''").select(F.col("id").alias("src"), "name", "qualname")
    defs = nodes.where("kind != 'symbol' and name is not null").select(F.col("id").alias("dst"), "kind", "name", "qualname", "module_path")
    module = defs.select("dst", "kind", "qualname", F.explode(dotted_variants(F.col("module_path"))).alias("module"))
    keyed = module.select("dst", F.when(F.col("kind") == "module", F.col("module")).when(F.col("qualname") != "", F.concat_ws(".", "module", "qualname")).alias("key")).where("key is not null").distinct()
    exact = stubs.where(F.col("qualname").contains(".")).join(keyed, F.col("qualname") == F.col("key")).select("src", "dst", F.lit("exact_qualname").alias("mode"))
    rest = stubs.join(exact.select("src").distinct(), "src", "left_anti")
    sizes = defs.groupBy("name").agg(F.count("*").alias("candidates"))
    named = rest.join(sizes, "name").join(defs.select("dst", "name"), "name")
    named = named.select("src", "dst", F.when(F.col("candidates") > 1, "name_fallback_ambiguous").otherwise("name_fallback").alias("mode"), "candidates")
    # fixed values: modes, grades of confidence and the evidence's keys are part of the output
    found = exact.withColumn("candidates", F.lit(None).cast("long")).unionByName(named)
    sure = F.when(F.col("mode") == "exact_qualname", "high").when(F.col("mode") == "name_fallback", "medium").otherwise("low")
    evidence = F.to_json(F.struct(F.col("mode").alias("resolution_mode"), sure.alias("confidence"), F.col("src").alias("symbol"), F.when(F.col("mode") == "name_fallback_ambiguous", F.col("candidates")).alias("candidate_count")))
    return found.select("src", F.lit("RESOLVES_TO").alias("rel"), "dst", evidence.alias("evidence"))


def callers_of(nodes: DataFrame, edges: DataFrame, node_id: str, rel: str = "CALLS") -> DataFrame:
    """Nodes with a ``rel`` edge to the node or to a stub that resolves to it.

    A stub's caller is left out if its module imports a symbol of the called name and
    none of those symbols resolves to the node. A caller counts once, direct first;
    ``call_site_lineno`` comes from the edge's evidence.
    """
    calls = edges.where(F.col("rel") == rel)
    direct = calls.where(F.col("dst") == node_id).select(F.col("src").alias("id"), "evidence", F.lit(0).alias("phase"), F.lit("").alias("stub"))
    resolved = edges.where("rel = 'RESOLVES_TO'")
    stubs = resolved.where(F.col("dst") == node_id).select(F.col("src").alias("stub"))
    via = calls.select(F.col("src").alias("id"), "evidence", F.col("dst").alias("stub")).join(stubs, "stub")
    short = F.element_at(F.split(F.get_json_object("evidence", "$.expr"), r"\."), -1)
    via = via.withColumn("short", F.when(F.get_json_object("evidence", "$.expr") != "", short))
    via = via.join(nodes.select("id", F.col("module_path").alias("path")), "id", "left")
    modules = nodes.where("kind = 'module'").groupBy(F.col("module_path").alias("path")).agg(F.min("id").alias("module"))
    imports = edges.where("rel = 'IMPORTS' and startswith(dst, 'sym:')").select(F.col("src").alias("module"), F.col("dst").alias("sym"), F.element_at(F.split("dst", r"\."), -1).alias("short"))
    hits = imports.join(stubs.withColumnRenamed("stub", "sym"), "sym", "left_semi").select("module", "short").distinct().withColumn("hit", F.lit(True))
    imported = imports.select("module", "short").distinct().join(hits, ["module", "short"], "left")
    judged = via.join(modules, "path", "left").join(imported.withColumn("known", F.lit(True)), ["module", "short"], "left")
    kept = judged.where("known is null or hit").select("id", "evidence", F.lit(1).alias("phase"), "stub")
    order = Window.partitionBy("id").orderBy("phase", "stub")
    once = direct.unionByName(kept).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return once.join(nodes, "id").select(*nodes.columns, call_site_line(F.col("evidence")).alias("call_site_lineno"))


def stats(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Totals of a graph and its share of documented functions and methods, in one row; with
    ``snapshots`` also their number."""
    has = F.coalesce(F.col("docstring"), F.lit("")) != ""
    code = F.col("kind").isin("function", "method")
    n = nodes.agg(
        F.count("*").alias("total_nodes"),
        F.count_if(F.col("kind") != "symbol").alias("meaningful_nodes"),
        *(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("module", "class", "function", "method")),
        F.coalesce(F.round(F.count_if(code & has) / F.nullif(F.count_if(code), F.lit(0)), 3), F.lit(0.0)).alias("docstring_coverage"),
    )
    e = edges.agg(F.count("*").alias("total_edges"))
    out = n.crossJoin(F.broadcast(e))
    return out if snapshots is None else out.crossJoin(F.broadcast(snapshots.agg(F.count("*").alias("snapshot_count"))))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def coverage(nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Share of nodes of these kinds whose docstring is more than blanks; 0 if there are none."""
    has = F.when(F.trim(F.coalesce("docstring", F.lit(""))) != "", 1.0).otherwise(0.0)
    return nodes.where(F.col("kind").isin(*kinds)).agg(F.coalesce(F.avg(has), F.lit(0.0)).alias("coverage"))


def degree_metrics(edges: DataFrame) -> DataFrame:
    """Degree of each node as a long-format metric."""
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count("*").cast("double").alias("score")).select("node_id", F.lit("degree").alias("metric"), "score")
