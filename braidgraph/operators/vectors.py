"""Exact nearest neighbours and the vector table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.functions.vectors import cosine_distance, matrix, ranks, to_int8, unit
from braidgraph.operators.graph import upsert

#: Queries and rows that meet in one task, and numbers in a matrix product.
QUERY_BLOCK, ROW_BLOCK, PRODUCT = 1024, 16_384, 4 << 20


def search(vectors: DataFrame, query: Sequence[float], k: int = 8, where: str | Column | None = None, int8: bool = False) -> DataFrame:
    """The ``k`` nearest rows by cosine distance among those that satisfy ``where``, with
    ``_distance`` and a rank from 0. The filter comes before the top-k."""
    rows = vectors.where(where) if where is not None else vectors
    q = F.array(*(F.lit(float(x)) for x in query))
    a, b = (to_int8(F.col("vector")), to_int8(q)) if int8 else (F.col("vector"), q)
    near = rows.withColumn("_distance", cosine_distance(a, b)).orderBy("_distance", "id").limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("_distance", "id")) - 1)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """``k`` nearest rows for each query (query_id, query_vector), with ``_distance`` and a rank from 0.

    Blocks of queries meet blocks of rows, both dealt by hash, in one job however many
    queries there are: a block pair is one matrix product, of which the best k of each
    query leave the task. Sums that decide are taken row by row, so equal vectors have
    equal distances.
    """
    sizes = vectors.agg(F.count("*").alias("n")).first().n, queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("query_vector")), F.lit(1)).alias("dim")).first()
    cuts, slices, dim = max(1, -(-sizes[0] // ROW_BLOCK)), max(1, -(-sizes[1].n // QUERY_BLOCK)), max(1, sizes[1].dim)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "query_vector", deal("query_id", slices).alias("slice")).withColumn("cut", every(cuts))
    right = vectors.select("id", "vector", deal("id", cuts).alias("d")).withColumn("e", every(slices))
    names, kinds = ["query_id", "id", "_distance"], (dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"], "double")

    def meet(q: pa.Table, t: pa.Table) -> pa.Table:
        own = [q.column("query_id").combine_chunks(), t.column("id").combine_chunks()]
        if not len(own[0]) or not len(own[1]):
            return pa.table({n: pa.array([], x) for n, x in zip(names, (own[0].type, own[1].type, pa.float64()), strict=True)})
        a, b = matrix(q.column("query_vector"), dim), matrix(t.column("vector"), dim)
        ua, ub = unit(a), unit(b)
        length = np.sqrt((a**2).sum(1)), np.sqrt((b**2).sum(1))
        found: list[tuple[np.ndarray, ...]] = []
        step = max(1, PRODUCT // len(b))
        for s in range(0, len(a), step):
            far = -(ua[s : s + step] @ ub.T)
            last = np.partition(far, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
            i, j = np.nonzero(~(far > last[:, None] + 1e-9))
            i += s
            size = length[0][i] * length[1][j]
            exact = np.where(size > 0, 1 - np.einsum("nd,nd->n", a[i], b[j]) / np.where(size > 0, size, 1), 1.0)
            found.append((i, j, exact))
        i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((ranks(own[1])[j], d, i))
        i, j, d = i[order], j[order], d[order]
        begins = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        kept = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i)))) < k
        i, j, d = i[kept], j[kept], d[kept]
        return pa.table({"query_id": own[0].take(pa.array(i)), "id": own[1].take(pa.array(j)), "_distance": pa.array(d)})

    near = left.groupBy("slice", "cut").cogroup(right.groupBy("e", "d")).applyInArrow(meet, ", ".join(f"{n} {x}" for n, x in zip(names, kinds, strict=True)))
    order = Window.partitionBy("query_id").orderBy("_distance", "id")
    return near.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


#: Searches by name; more are added by ``register_backend``.
BACKENDS: dict[str, Callable[..., DataFrame]] = {}


def register_backend(name: str, find: Callable[..., DataFrame]) -> None:
    """Make ``find(vectors, query, k)`` the search of a backend's name."""
    BACKENDS[name] = find


def search_with(backend: str, vectors: DataFrame, query: Sequence[float], k: int = 8, where: str | Column | None = None) -> DataFrame:
    """Search by a backend's name: ``exact`` (also ``auto``), ``int8``, ``lsh``, or one that was registered."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown vector backend {backend!r}")
    return BACKENDS[backend](vectors.where(where) if where is not None else vectors, query, k)


def distance_of(row_distance: Column, distance: Column, score: Column, fallback_rank: Column) -> Column:
    """The distance that a backend's row reports, in whichever form it does."""
    return F.coalesce(row_distance, distance, 1 / (1 + score), fallback_rank.cast("double"))


def upsert_vectors(current: DataFrame, batch: DataFrame, seq: str | None = None) -> DataFrame:
    """Vectors by id, last write wins, always free of repeats."""
    return upsert(current, batch, ["id"], seq)


def delete_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.where("id is not null and id != ''").select("id").distinct(), "id", "left_anti")


def existing_ids(vectors: DataFrame) -> DataFrame:
    return vectors.select("id").distinct()


def lsh_search(vectors: DataFrame, query: Sequence[float], k: int = 8, planes: int = 8, probes: int = 2, seed: int = 11, tables: int = 8) -> DataFrame:
    """Approximate search: each of ``tables`` hash tables buckets the rows by the signs of its
    own random projections, and rows within ``probes`` sign changes of the query in any are scored."""
    sign = lambda p: F.when(F.aggregate(F.zip_with("vector", F.array(*map(F.lit, map(float, p))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) >= 0, 1).otherwise(0)
    near = F.lit(False)
    for table in range(tables):
        normal = np.random.default_rng([seed, table] if table else seed).normal(size=(planes, len(query)))
        code = sum(F.shiftleft(sign(p), i) for i, p in enumerate(normal))
        own = sum(int(v >= 0) << i for i, v in enumerate(normal @ np.asarray(query, float)))
        near |= F.bit_count(code.bitwiseXOR(F.lit(own))) <= probes
    return search(vectors.where(near), query, k)


register_backend("auto", search)
register_backend("exact", search)
register_backend("int8", lambda vectors, query, k: search(vectors, query, k, int8=True))
register_backend("lsh", lsh_search)
