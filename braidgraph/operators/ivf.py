"""Approximate nearest neighbours: an inverted file of cells with product-quantised residuals.

*Training.* Cells are the centroids of k-means over unit vectors, and each of a residual's
subvectors has ``CODES`` codewords of its own, from k-means as well. Both are fitted on
a sample of at most ``SAMPLE`` rows: its rows are assigned in tasks, centroids' sums are
added up by centroid, and only centroids reach the driver.

*Index.* Every row gets its nearest cell and, for what the cell's centroid leaves over,
a code for each subvector. Rows keep all their columns. Written, they are sorted by
cell, so that a search reads the row groups of the cells that it probes.

*Search.* The cells nearest to the query are probed. A row's inner product with the query
is estimated as that of its centroid plus one table entry for each code; the best
``refine`` * k of the estimates are compared exactly, and the best k of them returned. If
the probed cells hold fewer than k rows that satisfy a filter, all rows are searched.

*Many queries.* Queries meet the blocks of their cells; a cell with many rows or queries is
cut by hash, so its share of either is no task's burden.

Rows whose vector is null, of another dimension or without length have distance 1 from
everything and lie in the cell that is nearest to the origin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidgraph.functions.vectors import cosine_distance, matrix, partitions, ranks, subvectors, unit
from braidgraph.operators.vectors import search_many as exact_many
from braidgraph.plans.lineage import checkpointed

SAMPLE, ROUNDS, CODES = 262_144, 8, 256
#: Sample rows for each cell; rows and queries of a cell that meet in one task; numbers in a product.
EACH, BLOCK, ASKED, CHUNK = 64, 32_768, 1024, 4 << 20


@dataclass
class Index:
    """Trained centroids (cells x dim), codewords (subvectors x codes x dim / subvectors), and the rows
    with their cell and codes."""

    centroids: np.ndarray
    codewords: np.ndarray
    rows: DataFrame

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def default_probes(self) -> int:
        """A sixteenth of the cells, eight at least."""
        return min(self.cells, max(8, self.cells // 16))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, some rows at a time."""
    half, out = (centroids**2).sum(1) / 2, np.empty(len(x), np.int64)
    step = max(1, CHUNK // max(1, len(centroids)))
    for i in range(0, len(x), step):
        out[i : i + step] = (x[i : i + step] @ centroids.T - half).argmax(1)
    return out


def k_means(sample: DataFrame, groups: int, k: int, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (groups x k x dim / groups) of column ``x``, whose ``groups`` subvectors are clustered apart.

    They start from ``k`` rows of the sample, chosen by hash; one without members stays.
    """
    spark, size = sample.sparkSession, dim // groups
    start = sample.orderBy(F.xxhash64("x", F.lit("start"))).limit(k).collect()
    at = np.array([r.x for r in start], np.float64).reshape(-1, groups, size).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(at)

        def partly(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cents = shared.value
            sums, counts = np.zeros_like(cents), np.zeros(cents.shape[:2], np.int64)
            for b in batches:
                x = matrix(b.column(0), dim).reshape(-1, groups, size)
                for g in range(groups):
                    own = nearest(x[:, g], cents[g])
                    np.add.at(sums[g], own, x[:, g])
                    counts[g] += np.bincount(own, minlength=len(cents[g]))
            g, c = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(g * cents.shape[1] + c), pa.array(counts[g, c]), pa.array(list(sums[g, c]), pa.list_(pa.float64()))], names=["c", "n", "s"])

        def together(t: pa.Table) -> pa.Table:
            return pa.table({"c": t.column("c")[:1], "n": [sum(t.column("n").to_pylist())], "s": pa.array([np.array(t.column("s").to_pylist()).sum(0)], pa.list_(pa.float64()))})

        schema = "c long, n long, s array<double>"
        for r in sample.select("x").mapInArrow(partly, schema).groupBy("c").applyInArrow(together, schema).collect():
            at[r.c // at.shape[1], r.c % at.shape[1]] = np.array(r.s) / r.n
    return at


def assigned(vectors: DataFrame, centroids: np.ndarray, codewords: np.ndarray | None) -> DataFrame:
    """``vectors`` with their cell, and with codewords the codes of what it leaves over (else that itself as ``x``)."""
    dim = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, codewords))
    names = vectors.columns
    more = "cell int, codes array<smallint>" if codewords is not None else "cell int, x array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, words = shared.value
        for b in batches:
            u = unit(matrix(b.column(names.index("vector")), dim))
            cell = nearest(u, cents)
            rest = u - cents[cell]
            if words is None:
                last = pa.array(list(rest.astype(np.float32)), pa.list_(pa.float32()))
            else:
                parts = rest.reshape(len(u), len(words), -1)
                last = pa.array(list(np.stack([nearest(parts[:, g], w) for g, w in enumerate(words)], 1).astype(np.int16)), pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), last], names=[*names, *("cell", "codes" if words is not None else "x")])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{fields}, {more}")


def build(vectors: DataFrame, cells: int | None = None, parts: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Index:
    """An index over every row of ``vectors`` (id, vector, ...); numbers of cells and of subvectors
    follow from the rows and the dimension unless given."""
    whole = vectors.agg(F.count("*").alias("n"), F.coalesce(F.mode(F.size("vector")), F.lit(1)).alias("dim")).first()
    dim = max(1, whole.dim)
    cells, parts = cells or partitions(whole.n), parts or subvectors(dim)
    share = min(1.0, min(sample, max(EACH * cells, 16 * CODES)) / max(1, whole.n))
    drawn = vectors.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int((1 << 30) * share))).where(F.size("vector") == dim)
    drawn = checkpointed(drawn.select(F.col("vector").cast("array<float>").alias("vector")).limit(sample))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit_of = F.transform("vector", lambda x: (x / F.when(length > 0, length).otherwise(1.0)).cast("float"))
    some = checkpointed(drawn.select(unit_of.alias("x")))
    centroids = k_means(some, 1, cells, dim, rounds)[0]
    if not len(centroids):
        centroids = np.zeros((1, dim))
    left = checkpointed(assigned(drawn, centroids, None).select("x"))
    codewords = k_means(left, parts, CODES, dim, rounds)
    if not codewords.shape[1]:
        codewords = np.zeros((parts, 1, dim // parts))
    return Index(centroids, codewords, assigned(vectors, centroids, codewords))


def maybe_build(vectors: DataFrame, threshold: int, **how) -> Index | None:
    """An index where there are ``threshold`` rows or more; below, and for a threshold of 0, none."""
    return build(vectors, **how) if 0 < threshold <= vectors.count() else None


def save(index: Index, path: str) -> None:
    """Rows sorted by cell, so that a probe reads few row groups; the trained parts beside them."""
    spark = index.rows.sparkSession
    index.rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
    parts = [("centroids", index.centroids), ("codewords", index.codewords)]
    rows = [(name, i, json.dumps(a[0].shape), a[i].ravel().tolist()) for name, a in parts for i in range(len(a))]
    spark.createDataFrame(rows, "part string, nth int, shape string, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/model").orderBy("nth").collect()
    of = lambda name: np.array([np.array(r.numbers).reshape(json.loads(r.shape)) for r in rows if r.part == name])
    return Index(of("centroids"), of("codewords"), spark.read.parquet(f"{path}/rows"))


def probed(index: Index, query: Sequence[float], probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest cells, the query's products with their centroids, and with each subvector's codewords."""
    q = unit(np.asarray([query], np.float64))[0]
    dots = index.centroids @ q
    near = np.argsort((index.centroids**2).sum(1) / 2 - dots, kind="stable")[:probes]
    tables = np.einsum("gks,gs->gk", index.codewords, q.reshape(len(index.codewords), -1))
    return near, dots[near], tables


def search(index: Index, query: Sequence[float], k: int = 8, where: str | Column | None = None, probes: int | None = None, refine: int = 20) -> DataFrame:
    """The ``k`` nearest rows that are found, with ``_distance`` and a rank from 0, as exact search gives them."""
    spark = index.rows.sparkSession
    rows = index.rows.where(where) if where is not None else index.rows
    q = F.array(*(F.lit(float(x)) for x in query))
    exact = lambda d: d.withColumn("_distance", cosine_distance(F.col("vector"), q)).orderBy("_distance", "id").limit(k)

    def found(probes: int) -> DataFrame:
        near, dots, tables = probed(index, query, probes)
        cells = spark.createDataFrame([(int(c), float(d)) for c, d in zip(near, dots, strict=True)], "cell int, __dot double")
        codes = tables.shape[1]
        flat = F.lit(tables.ravel())
        estimate = F.col("__dot")
        for g in range(len(tables)):
            estimate = estimate + F.get(flat, F.get("codes", F.lit(g)).cast("int") + g * codes)
        held = rows.where(F.col("cell").isin([int(c) for c in near])) if len(near) <= 1000 else rows
        held = held.join(F.broadcast(cells), "cell")
        return held.withColumn("__estimate", estimate).orderBy(F.desc("__estimate"), "id").limit(refine * k).drop("__dot", "__estimate")

    probes = probes or index.default_probes()
    best = checkpointed(exact(found(probes)))
    if probes < index.cells and best.count() < k:
        best = exact(rows)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("_distance", "id")) - 1).drop("cell", "codes")


def meetings(index: Index, queries: DataFrame, k: int, probes: int | None = None, refine: int = 20) -> DataFrame:
    """query_id, id and _distance of the best that each query (query_id, query_vector) finds in each block, and
    how many rows were estimated in ``scored`` (in rows without id)."""
    spark, probes = queries.sparkSession, probes or index.default_probes()
    shared = spark.sparkContext.broadcast((index.centroids, index.codewords))
    dim = index.centroids.shape[1]
    q_type, id_type = dict(queries.dtypes)["query_id"], dict(index.rows.dtypes)["id"]

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = shared.value[0]
        half = (cents**2).sum(1) / 2
        step = max(1, CHUNK // len(cents))
        for b in batches:
            q = unit(matrix(b.column(1), dim))
            near = np.concatenate([np.argsort(half - q[i : i + step] @ cents.T, axis=1, kind="stable")[:, :probes] for i in range(0, len(q), step)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(q), pa.list_(pa.float64())), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["query_id", "q", "cells"])

    asked = queries.select("query_id", "query_vector").mapInArrow(asks, f"query_id {q_type}, q array<double>, cells array<int>")
    asked = asked.select("query_id", "q", F.explode("cells").alias("cell"))
    # a cell's rows and queries are cut by hash into blocks of bounded size, as many as they need
    rows = index.rows.select("id", "vector", "cell", "codes")
    n_rows = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    n_asked = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("slices"))
    plan = checkpointed(n_rows.join(n_asked, "cell"))  # one row a cell
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(plan, "cell").withColumn("slice", deal("query_id", "slices")).withColumn("cut", every("cuts")).select("cell", "cut", "slice", "query_id", "q")
    right = rows.join(plan, "cell").withColumn("cut", deal("id", "cuts")).withColumn("slice", every("slices")).select("cell", "cut", "slice", "id", "vector", "codes")
    right = right.toDF("c", "d", "e", "id", "vector", "codes")

    def meet(a: pa.Table, t: pa.Table) -> pa.Table:
        names = ["query_id", "id", "_distance", "scored"]
        if not a.num_rows or not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, (a.schema.field("query_id").type, t.schema.field("id").type, pa.float64(), pa.int64()), strict=True)})
        cents, words = shared.value
        q, codes = matrix(a.column("q"), dim), matrix(t.column("codes"), len(words)).astype(np.int64)
        v = unit(matrix(t.column("vector"), dim))
        tables = np.einsum("gks,ngs->ngk", words, q.reshape(len(q), len(words), -1))
        wanted, place = min(refine * k, len(v)), ranks(t.column("id").combine_chunks())
        who, which, far = [], [], []
        for i in range(len(q)):
            estimate = sum(tables[i, g][codes[:, g]] for g in range(len(words)))  # the centroid's part is the same for all
            best = np.argpartition(-estimate, wanted - 1)[:wanted] if wanted < len(v) else np.arange(len(v))
            d = 1 - v[best] @ q[i]
            keep = np.lexsort((place[best], d))[:k]
            who += [i] * len(keep)
            which.append(best[keep])
            far.append(d[keep])
        rows_at = np.concatenate(which)
        none = pa.nulls(len(q), t.schema.field("id").type)
        ids = pa.concat_arrays([t.column("id").combine_chunks().take(pa.array(rows_at)), none])
        q_ids = a.column("query_id").combine_chunks()
        return pa.table({"query_id": pa.concat_arrays([q_ids.take(pa.array(np.array(who))), q_ids]), "id": ids, "_distance": pa.array([*np.concatenate(far), *[None] * len(q)], pa.float64()), "scored": pa.array([*[None] * len(rows_at), *[len(v)] * len(q)], pa.int64())})

    return left.groupBy("cell", "cut", "slice").cogroup(right.groupBy("c", "d", "e")).applyInArrow(meet, f"query_id {q_type}, id {id_type}, _distance double, scored long")


def probes_for(index: Index, k: int = 10, recall: float = 0.95, sample: int = 64) -> int:
    """The fewest cells to probe so that, of the exact ``k`` nearest of about ``sample`` rows, that share lies
    in them. Vectors in clusters need few; where they have no structure it may be most of them."""
    n = index.rows.count()
    asked = index.rows.where(F.pmod(F.xxhash64("id", F.lit("asks")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, n)))))
    asked = checkpointed(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")).limit(4 * sample))
    near = exact_many(index.rows, asked, k).select("query_id", "id")
    near = near.join(index.rows.select("id", "cell"), "id").groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
    half, needed = (index.centroids**2).sum(1) / 2, []
    for r in asked.join(near, "query_id").collect():
        q = unit(np.nan_to_num(np.array([[0.0 if x is None else x for x in (r.query_vector or [])]], np.float64)))
        q = q if q.shape[1] == index.centroids.shape[1] else np.zeros((1, index.centroids.shape[1]))
        place = np.empty(index.cells, np.int64)
        place[np.argsort(half - index.centroids @ q[0], kind="stable")] = np.arange(index.cells)
        needed += (place[r.cells] + 1).tolist()
    return int(np.sort(needed)[max(0, int(np.ceil(recall * len(needed))) - 1)]) if needed else index.cells


def search_many(index: Index, queries: DataFrame, k: int = 8, probes: int | None = None, refine: int = 20) -> DataFrame:
    """query_id, id, _distance and rank (from 0) of the ``k`` nearest that are found for each query."""
    met = meetings(index, queries, k, probes, refine).where("id is not null").drop("scored")
    order = Window.partitionBy("query_id").orderBy("_distance", "id")
    return met.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
