"""Exact top-k search by pivot-table elimination.

Vectors are scaled and floored to integers and compared by inner product. Inner
products become distances in one more dimension: with M the largest norm, a
candidate v is lifted to (v, sqrt(M^2 - |v|^2)) and a query q to (q, 0), so
``|q' - v'|^2 = |q|^2 + M^2 - 2 q.v`` and the nearest candidate has the highest
score. A table holds each candidate's distance to many pivots. By the triangle
inequality the largest ``|d(q', p') - d(v', p')|`` over the pivots p is a lower
bound of the distance and so bounds the score from above. A query's candidates are
evaluated in the order of their bounds until the next bound can't reach the k-th
score; equal scores are still evaluated, as ties go to the smaller id.

Candidates lie in the cell of their nearest pivot, in blocks of bounded size. In a
first pass each query meets one block of the cell where its nearest pivot lies, and so
gets a k-th score to start from. Each cell keeps, for every pivot, the least and the
largest distance of its members; by the same inequality these bound the scores of the
whole cell. In the second pass a query meets the blocks of those cells only whose bound
reaches its starting score, and stops in each block where the next bound falls below
it. Only pivots, ``pivots`` of them from a bounded sample, and the cells' distances,
``pivots`` squared, reach the driver.

Defined edge cases: vectors that are null or hold null or non-finite components take
no part, nor do null ids; shorter vectors are padded with zeros; candidate rows that
share an id each count, repeated query rows are answered once; a query never meets
rows of its own id; scores beyond a long are clipped to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.llm.common import checkpointed

PIVOTS, PIVOT_SAMPLE = 32, 1024
BLOCK = 16_384


def floored(vector: Column, scale: float = 256.0) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


def pivot_table(v: np.ndarray, pivots: np.ndarray, top: float, lift: bool) -> np.ndarray:
    """Distances of lifted rows to the lifted pivots; queries (``lift`` false) have 0 in the added dimension."""
    x, p = v.astype(np.float64), pivots.astype(np.float64)
    norm = (x**2).sum(1)
    cross = x @ p.T
    if lift:
        cross += np.sqrt(np.maximum(top - norm, 0))[:, None] * np.sqrt(np.maximum(top - (p**2).sum(1), 0))[None]
    return np.sqrt(np.maximum((top if lift else norm[:, None]) + top - 2 * cross, 0))


def best(queries: tuple[np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray], table: np.ndarray, to_pivots: np.ndarray, top: float, k: int, least: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(query row, candidate row, score) of the block's ``k`` best for each query, without scores
    below ``least``; and how many candidates each query was evaluated against."""
    (q_ids, q), (ids, v) = queries, block
    wide = v.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) >= 2**53
    exact = object if wide else np.float64  # floats hold these integers exactly, else Python's integers do
    qx, vx = q.astype(exact), v.astype(exact)
    slack = 1e-7 * max(1.0, top)
    half = ((q.astype(np.float64) ** 2).sum(1) + top) / 2
    out: list[tuple[int, int, int]] = []
    evaluated: list[int] = []
    for i in range(len(q_ids)):
        gap = np.abs(table - to_pivots[i]).max(1) if table.shape[1] else np.zeros(len(ids))
        bound = half[i] - gap**2 / 2 + slack
        floor = -math.inf if least is None else least[i]
        order = np.flatnonzero((bound >= floor) & (ids != q_ids[i]))
        order = order[np.argsort(-bound[order], kind="stable")]
        held_s, held_r = np.empty(0, exact), np.empty(0, np.int64)
        at, step = 0, 64
        while at < len(order):
            if len(held_s) == k and bound[order[at]] < held_s[-1]:
                break
            rows = order[at : at + step]
            at, step = at + len(rows), step * 2
            s, r = np.concatenate([held_s, vx[rows] @ qx[i]]), np.concatenate([held_r, rows])
            keep = np.lexsort((ids[r], -s))[:k] if exact is np.float64 else sorted(range(len(s)), key=lambda j: (-s[j], ids[r[j]]))[:k]
            held_s, held_r = s[keep], r[keep]
        evaluated.append(at)
        out += [(i, int(r), max(-(2**63), min(2**63 - 1, int(s)))) for r, s in zip(held_r, held_s, strict=True) if s >= floor]
    return out, evaluated


_MET = "query_id long, query_key long, vec_id long, score long, evaluated long"


def meetings(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """What each query found in each block that it met: rows of its best, and a row without
    ``vec_id`` that says how many candidates it was evaluated against."""
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), floored(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = checkpointed(rows.withColumn("row_no", F.monotonically_increasing_id()))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    far = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, x, -(x + 1)))
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(norm), F.lit(0.0)).alias("top"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.coalesce(F.max(far), F.lit(0)).alias("far")).first()
    width, top = max(1, whole.width), whole.top
    # components travel in as few bytes as hold the largest
    item = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 64)) if whole.far < 1 << bits)
    # a bounded sample, spread by hash; which vectors become pivots never changes the result
    share = F.pmod(F.xxhash64("row_no", F.lit("pivots")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, PIVOT_SAMPLE / max(1, whole.n))))
    drawn = [r.v for r in rows.where(share).select("v").limit(2 * PIVOT_SAMPLE).collect()]
    chosen = choose_pivots(np.array([x + [0] * (width - len(x)) for x in drawn], np.float64).reshape(-1, width), pivots)
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)
    n_cells = max(1, len(chosen))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pv = shared.value
        for b in batches:
            table = pivot_table(_matrix(b.column(1), width), pv, top, True)
            cell = table.argmin(1) if len(pv) else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(list(table), pa.list_(pa.float64()))], names=[*b.schema.names, "cell", "far"])

    celled = rows.withColumn("v", F.col("v").cast(f"array<{item}>")).mapInArrow(nearest, f"id long, v array<{item}>, asks boolean, row_no long, cell int, far array<double>")
    celled = checkpointed(celled)
    ranges = celled.groupBy("cell").agg(F.count("*").alias("n"), *(F.min(F.col("far")[i]).alias(f"low{i}") for i in range(len(chosen))), *(F.max(F.col("far")[i]).alias(f"high{i}") for i in range(len(chosen)))).collect()
    sizes = {r.cell: r.n for r in ranges}
    cuts = [max(1, -(-sizes.get(c, 0) // block)) for c in range(n_cells)]
    low, high = np.full((n_cells, len(chosen)), np.inf), np.full((n_cells, len(chosen)), np.inf)
    for r in ranges:
        low[r.cell], high[r.cell] = [r[f"low{i}"] for i in range(len(chosen))], [r[f"high{i}"] for i in range(len(chosen))]
    ends = vectors.sparkSession.sparkContext.broadcast((low, high))

    of = lambda values, key: F.element_at(F.array(*map(F.lit, values)), key + 1)
    spread = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), n).cast("int")
    right = celled.select("id", "v", "cell", spread("row_no", of(cuts, F.col("cell")), "v").alias("cut"))
    asked = celled.where("asks").select("id", "v", "cell", F.xxhash64("v").alias("key")).dropDuplicates(["id", "key", "v"])

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        names = ("query_id", "query_key", "vec_id", "score", "evaluated")
        if not q.num_rows or not v.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        pv = shared.value
        qm, vm = _matrix(q.column("v"), width), _matrix(v.column("w"), width)
        q_ids, ids, keys = q.column("id").to_numpy(), v.column("member").to_numpy(), q.column("key").to_numpy()
        least = np.array([-np.inf if x is None else float(x) for x in q.column("least").to_pylist()])
        found, evaluated = best((q_ids, qm), (ids, vm), pivot_table(vm, pv, top, True), pivot_table(qm, pv, top, False), top, k, least)
        out = [(q_ids[i], keys[i], ids[r], s, None) for i, r, s in found] + [(q_ids[i], keys[i], None, None, n) for i, n in enumerate(evaluated)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    def met(left: DataFrame) -> DataFrame:
        """``left`` has the cell and cut that each query meets; of a hot cell's queries each ``block`` are a group."""
        n = left.groupBy("cell", "cut").agg(F.ceil(F.count("*") / block).cast("int").alias("slices"))
        left = left.join(n, ["cell", "cut"]).withColumn("slice", spread("id", F.col("slices"), "q"))
        mine = right.join(n, ["cell", "cut"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        mine = mine.select("id", "v", "cell", "cut", "slice").toDF("member", "w", "c", "d", "e")  # names of their own, as both sides come from one table
        return left.select("id", "v", "key", "least", "cell", "cut", "slice").groupBy("cell", "cut", "slice").cogroup(mine.groupBy("c", "d", "e")).applyInArrow(meet, _MET)

    none = F.lit(None).cast("long")
    first = met(asked.select("id", "v", "key", none.alias("least"), "cell", spread("id", of(cuts, F.col("cell")), "first").alias("cut")))
    # a floor only where the block held k others
    floors = first.where("vec_id is not null").groupBy(F.col("query_id").alias("id"), F.col("query_key").alias("key")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    started = asked.drop("cell").join(floors, ["id", "key"], "left")

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pv, (low, high) = shared.value, ends.value
        for b in batches:
            q = _matrix(b.column(1), width).astype(np.float64)
            to = pivot_table(q, pv, top, False)
            gap = np.maximum(0, np.maximum(low[None] - to[:, None], to[:, None] - high[None])).max(2) if len(pv) else np.zeros((len(q), n_cells))
            bound = ((q**2).sum(1)[:, None] + top - gap**2) / 2 + 1e-7 * max(1.0, top)
            least = np.array([-np.inf if x is None else float(x) for x in b.column(3).to_pylist()])
            # cells without members have infinite distances
            open_cells = [np.flatnonzero(r).tolist() for r in (bound >= least[:, None]) & np.isfinite(gap)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(open_cells, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    pairs = started.select("id", "v", "key", "least").mapInArrow(reaches, f"id long, v array<{item}>, key long, least long, cells array<int>")
    pairs = pairs.select("id", "v", "key", "least", F.explode("cells").alias("cell"))
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), of(cuts, F.col("cell")) - 1)).alias("cut"))
    return met(pairs)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best for each row where ``queries`` holds."""
    found = meetings(vectors, queries, k, scale, pivots, block, id_col, vector_col).where("vec_id is not null")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated_share(vectors: DataFrame, queries: Column, **how) -> float:
    """Share of all pairs of a query and a candidate that the second pass evaluates."""
    r = meetings(vectors, queries, **how).agg(F.sum("evaluated").alias("e"), F.countDistinct("query_id", "query_key").alias("q")).first()
    return (r.e or 0) / max(1, r.q * (vectors.count() - 1))
