"""Hybrid retrieval: semantic seeds, structural expansion, ranking, caps, snippets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.functions import text as X
from braidgraph.operators.graph import edges_within, expand
from braidgraph.operators.vectors import search
from braidgraph.plans.lineage import checkpointed
from braidgraph.schema import DEFAULT_RELS

FAR = 1e9


@dataclass
class Retrieved:
    """What a query returns: nodes with their relevance, the edges among them, and counts."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame
    reached: DataFrame

    def counters(self) -> DataFrame:
        one = lambda d, n: d.agg(F.count("*").alias(n))
        return one(self.seeds, "seeds").crossJoin(one(self.reached, "expanded_nodes")).crossJoin(one(self.nodes, "returned_nodes")).crossJoin(one(self.edges, "edges"))


def priority(kind: Column, priorities: dict[str, int] | None) -> Column:
    out = F.lit(99)
    for k, p in (priorities or {}).items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def candidates(nodes: DataFrame, reached: DataFrame, seeds: DataFrame, q_tokens: Column, mode: str, semantic_weight: float, lexical_weight: float, priorities: dict[str, int] | None, include_symbols: bool) -> DataFrame:
    """Reached nodes with score columns and the sort key k1, k2, pri, id of the mode."""
    near = seeds.select(F.col("id").alias("via_seed"), "_distance")
    rows = reached.join(F.broadcast(near), "via_seed", "left").withColumn("dist", F.coalesce("_distance", F.lit(FAR))).drop("_distance")
    rows = nodes.join(rows, "id")
    if not include_symbols:
        rows = rows.where("kind != 'symbol'")
    rows = rows.withColumn("semantic", X.semantic_score(F.col("dist"))).withColumn("lexical", X.lexical_overlap(q_tokens, F.col("name"), F.col("qualname"), F.col("module_path"), F.col("docstring")))
    mixed = semantic_weight * F.col("semantic") + lexical_weight * F.col("lexical")
    hybrid = mixed if semantic_weight + lexical_weight > 0 else F.col("semantic")
    first = {"hybrid": -hybrid, "semantic": -F.col("semantic")}.get(mode, F.col("best_hop").cast("double"))
    second = F.col("best_hop").cast("double") if mode in ("hybrid", "semantic") else F.col("dist")
    return rows.withColumns({"docstring_signal": X.docstring_signal(F.col("docstring")), "mixed": mixed, "hybrid": hybrid, "k1": first, "k2": second, "pri": priority(F.col("kind"), priorities)})


ORDER = ("k1", "k2", "pri", "id")


def seeds_of(vectors: DataFrame, query_vector: Sequence[float], k: int, min_score: float, where: str | None = None) -> DataFrame:
    hits = search(vectors, query_vector, k, where)
    if min_score > 0:
        hits = hits.where(X.semantic_score(F.col("_distance")) >= min_score)
    return checkpointed(hits.select("id", "_distance", "rank"))


def query(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, query_vector: Sequence[float], query_text: str, k: int = 8, hop: int = 1, rels: Sequence[str] = DEFAULT_RELS, include_symbols: bool = False, max_nodes: int = 25, min_score: float = 0.0, max_per_module: int | None = None, mode: str = "legacy", semantic_weight: float = 0.7, lexical_weight: float = 0.3, priorities: dict[str, int] | None = None, where: str | None = None) -> Retrieved:
    """Semantic seeds, then expansion, ranking by mode, a cap for each module, a limit, and
    scores over the best one's; the edges are those among the nodes that are left."""
    seeds = seeds_of(vectors, query_vector, k, min_score, where)
    reached = expand(edges, seeds, hop, rels)
    q = X.query_tokens(X.normalize_query(F.lit(query_text)))
    rows = candidates(nodes, reached, seeds, q, mode, semantic_weight, lexical_weight, priorities, include_symbols)
    if max_per_module is not None:
        own = F.coalesce("module_path", F.lit(""))
        # nodes without a module stand alone
        nth = F.row_number().over(Window.partitionBy(own, F.when(own == "", F.col("id"))).orderBy(*ORDER))
        rows = rows.withColumn("nth", nth).where((own == "") | (F.col("nth") <= max_per_module)).drop("nth")
    top = checkpointed(rows.orderBy(*ORDER).limit(max_nodes))
    score = F.col("mixed") if mode == "hybrid" else F.col("semantic")
    best = F.broadcast(top.agg(F.max(score).alias("best")))
    scaled = top.crossJoin(best).withColumn("score", F.when(F.col("best") > 0, F.round(score / F.col("best"), 6)).otherwise(score))
    out = scaled.select(*nodes.columns, "score", "semantic", "lexical", "docstring_signal", F.col("best_hop").alias("hop"), "via_seed", F.lit(mode).alias("mode"))
    return Retrieved(out, edges_within(edges, top.select("id")), seeds, reached)


def greedy_spans(rows: DataFrame, order: Sequence[str], max_per_module: int | None = None, gap: int = 2) -> DataFrame:
    """Rows of each file that overlap no better row kept of it; at most ``max_per_module``.

    A sequential rule, so a file's rows are streamed in rank order through one task,
    which holds the spans kept of that file only. Rows without a file or span are
    always kept.
    """
    spanned = F.coalesce(F.col("module_path") != "", F.lit(False)) & F.coalesce(F.col("span_end") >= F.col("span_start"), F.lit(False))

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, spans = None, []
        for pdf in parts:
            stays = []
            for path, s, e in zip(pdf["module_path"], pdf["span_start"], pdf["span_end"], strict=True):
                if path != file:
                    file, spans = path, []
                ok = (max_per_module is None or len(spans) < max_per_module) and all(b + gap < s or e + gap < a for a, b in spans)
                if ok:
                    spans.append((s, e))
                stays.append(ok)
            yield pdf[stays]

    dealt = rows.where(spanned).repartition("module_path").sortWithinPartitions("module_path", *order)
    return dealt.mapInPandas(keep, rows.schema).unionByName(rows.where(~spanned))


def _missing(*rest: Column | str) -> Column:
    # fixed values: the two texts are part of the output
    return F.concat(F.lit("Missing line metadata for `"), "id", F.lit("`; "), *(F.lit(r) if isinstance(r, str) else r for r in rest))


def _no_parent() -> Column:
    return _missing("snippet omitted (no parent span available).")


def with_spans(rows: DataFrame, files: DataFrame, context: int, max_lines: int, policy: str) -> DataFrame:
    """``rows`` with span_start, span_end and warning; ``files`` is (module_path, lines).

    A node without a line takes its parent's span, shortened, if the parent (by qualified
    name in the same file) has one and sorts before it by id.
    """
    cap = min(max_lines, max(20, context * 4))
    sized = rows.join(files.select("module_path", F.size("lines").alias("file_lines")), "module_path", "left")
    lost = (F.col("kind") != "module") & F.col("lineno").isNull() if policy != "legacy" else F.lit(False)
    span = X.compute_span(F.col("kind"), F.col("lineno"), F.col("end_lineno"), F.coalesce("file_lines", F.lit(0)), context, max_lines)
    sized = sized.withColumn("lost", lost).withColumn("span", F.when((F.coalesce("module_path", F.lit("")) != "") & ~F.col("lost"), span))
    own = sized.withColumns({"span_start": F.col("span.start"), "span_end": F.col("span.end"), "warning": F.lit(None).cast("string")}).drop("span", "file_lines")

    # only lost nodes of files take from others
    own = own.withColumn("lost", F.coalesce((F.col("module_path") != "") & F.col("lost"), F.lit(False)))
    qual = F.coalesce("qualname", F.lit(""))
    own = own.withColumn("depth", F.length(qual) - F.length(F.replace(qual, F.lit("."))))
    done, lost = own.where(~F.col("lost")), own.where("lost")
    shown = lambda df: df.where((F.coalesce("module_path", F.lit("")) != "") & (qual != "") & F.col("span_start").isNotNull())
    # a parent's name has one dot less, so nodes are filled by depth
    filled: dict[int, DataFrame] = {}
    for d in sorted(r.depth for r in lost.select("depth").distinct().collect()):
        parents = shown(done.where(F.col("depth") == d - 1))
        if d - 1 in filled:  # read twice
            filled[d - 1] = checkpointed(filled[d - 1])
            parents = parents.unionByName(shown(filled[d - 1]))
        rows = lost.where(F.col("depth") == d)
        filled[d] = _from_parents(rows, parents, cap) if d else rows.withColumn("warning", _no_parent())
    for df in filled.values():
        done = done.unionByName(df)
    return done.drop("lost", "depth")


def _from_parents(rows: DataFrame, parents: DataFrame, cap: int) -> DataFrame:
    """``rows`` without spans with those of their parents: of the rows with the parent's name in
    the same file, the last one before them by id. Parents and children of one name are a group,
    which passes sorted and is not held."""
    up = F.expr("substring(qualname, 1, length(qualname) - length(substring_index(qualname, '.', -1)) - 1)")
    both = rows.select("*", up.alias("of"), F.lit(0).alias("parent"), F.lit(None).cast("struct<s: int, e: int>").alias("shown"))
    both = both.unionByName(parents.select("*", F.col("qualname").alias("of"), F.lit(1).alias("parent"), F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e")).alias("shown")))
    before = Window.partitionBy("module_path", "of").orderBy("id", "parent").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("shown", F.last("shown", ignorenulls=True).over(before)).where("parent = 0")
    s, e = F.col("shown.s"), F.least(F.col("shown.e"), F.col("shown.s") + (cap - 1))
    said = _missing("using capped parent span ", s, "-", e, ".")
    found = found.withColumns({"span_start": s, "span_end": e, "warning": F.when(F.col("shown").isNull(), _no_parent()).otherwise(said)})
    return found.select(*rows.columns)


def module_summary(rows: DataFrame, nodes: DataFrame, edges: DataFrame, max_lines: int) -> DataFrame:
    """(id, text) for module rows: their docstring, then their classes, functions and methods."""
    inside = edges.where("rel = 'CONTAINS'").select(F.col("src").alias("module"), F.col("dst").alias("id")).join(nodes, "id")
    inside = inside.join(rows.select(F.col("id").alias("module")), "module", "left_semi").where(F.col("kind").isin("class", "function", "method"))
    first = F.substring(F.element_at(X.lines(F.trim(F.coalesce("docstring", F.lit("")))), 1), 1, 80)
    has = F.trim(F.coalesce("docstring", F.lit(""))) != ""
    at = F.when(F.coalesce("lineno", F.lit(0)) != 0, F.concat(F.lit("L"), F.col("lineno").cast("string"))).otherwise("?")
    label = F.when(F.coalesce("qualname", F.lit("")) != "", F.col("qualname")).otherwise(F.col("name"))
    line = F.concat(F.lit("#   "), label, F.lit(" ("), at, F.lit(")"), F.when(has, F.concat(F.lit(" — "), first)).otherwise(""))
    group = inside.groupBy("module", "kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("lineno", F.lit(0)).alias("no"), "id", line.alias("line")))).alias("items"))
    block = F.concat(F.array(F.concat(F.lit("# "), F.col("kind"), F.lit("s ("), F.col("n").cast("string"), F.lit("):"))), F.transform("items", lambda i: i["line"]), F.array(F.lit("")))
    blocks = group.groupBy("module").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("kind", block.alias("rows")))), lambda b: b["rows"])).alias("body"))
    doc = F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(X.lines(F.trim("docstring")), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    every = rows.where("kind = 'module'").join(blocks, F.col("id") == F.col("module"), "left")
    shown = F.slice(F.concat(doc, F.coalesce("body", F.array().cast("array<string>"))), 1, max_lines)
    return every.select("id", F.array_join(F.transform(shown, lambda x: F.concat(F.lit("       "), x)), "\n").alias("text"))


@dataclass
class Packed:
    """Nodes with spans, snippets and relevance; the edges among them; warnings of all candidates."""

    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame


def pack(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, files: DataFrame, query_vector: Sequence[float], query_text: str, k: int = 8, hop: int = 1, rels: Sequence[str] = DEFAULT_RELS, include_symbols: bool = False, context: int = 5, max_lines: int = 60, max_nodes: int | None = 15, min_score: float = 0.0, max_per_module: int | None = None, mode: str = "legacy", semantic_weight: float = 0.7, lexical_weight: float = 0.3, missing_lineno_policy: str = "cap_or_skip", priorities: dict[str, int] | None = None) -> Packed:
    """A query whose nodes come with source snippets; ``files`` is (module_path, lines)."""
    seeds = seeds_of(vectors, query_vector, k, min_score)
    reached = expand(edges, seeds, hop, rels)
    q = X.query_tokens(X.normalize_query(F.lit(query_text)))
    rows = candidates(nodes, reached, seeds, q, mode, semantic_weight, lexical_weight, priorities, include_symbols)
    spanned = checkpointed(with_spans(rows, files, context, max_lines, missing_lineno_policy))
    kept = greedy_spans(spanned, ORDER, max_per_module).orderBy(*ORDER)
    kept = checkpointed(kept.limit(max_nodes) if max_nodes is not None else kept)
    sized = kept.join(files, "module_path", "left")
    summaries = module_summary(kept, nodes, edges, max_lines).withColumnRenamed("text", "summary")
    long_module = (F.col("kind") == "module") & (F.coalesce(F.size("lines"), F.lit(0)) > max_lines)
    shown = F.when(F.col("span_end") >= F.col("span_start"), X.snippet(F.col("lines"), F.col("span_start"), F.col("span_end")))
    score = F.col("hybrid") if mode == "hybrid" else F.col("semantic")
    out = sized.join(summaries, "id", "left").select(
        *nodes.columns, score.alias("score"), "semantic", "lexical", "docstring_signal", F.col("best_hop").alias("hop"), "via_seed",
        F.col("module_path").alias("path"), "span_start", "span_end", F.when(long_module, F.col("summary")).otherwise(shown).alias("snippet"), long_module.alias("is_summary"),
    )
    return Packed(out, edges_within(edges, kept.select("id")), spanned.where("warning is not null").select("id", "warning"))
