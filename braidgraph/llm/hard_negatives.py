"""Hard-negative mining under an orthogonal rotation to principal components.

For each anchor the ``positives`` best rows of its own label are found, and for each of
these the ``negatives`` best rows of other labels whose score lies between ``low`` and
``high`` hundredths of the positive's. Scores are inner products of vectors that are
scaled and floored to integers.

An orthogonal rotation keeps inner products, and principal components gather most of a
vector's length in few leading components. Partial products over these are accumulated
stage by stage; what the remaining components can add or take lies within the product
of the two residual norms, and a slack covers the rounding of rotation and sums. A pair
whose bound can't reach the least score of interest, or whose least possible score is
above the greatest of interest, is discarded at once. What survives is verified with
integer products. So the rotation, fitted on ``SAMPLE`` rows at most, decides about
speed and never about results.

The least score of interest starts from the same sample: scores that rows of the sample
reach are lower bounds of the final ones. It rises while a task goes through its block.

Anchors in slices of ``SLICE`` meet all rows in blocks of ``BLOCK``, both dealt by
hash, so a hot label or a hot vector has no task of its own. Each cell returns as many
rows for an anchor, or an anchor's positive, as are asked for in all; windows keep the
best. Only the sample and two counters reach the driver.

Defined edge cases: rows with a null label, vector or id, and vectors that hold null or
non-finite components, take no part; shorter vectors are padded with zeros; rows that
share an id each count, but an anchor never meets rows of its own id and repeated
anchor rows are answered once; ties go to the smaller id; without positives, or where no
row lies in the band, nothing is returned; scores beyond a long are clipped to it, before
anything else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.llm.common import checkpointed
from braidgraph.llm.pivot_search import _matrix, floored, usable

SAMPLE = 2048
SLICE, BLOCK = 2048, 16_384
#: Anchors and rows compared at a time, and the share of pairs below which they are followed one by one.
TILE, SPARSE = (256, 2048), 0.15
TOP = 2**63 - 1


def rotation(sample: np.ndarray, width: int) -> np.ndarray:
    """Orthogonal matrix whose leading columns are the sample's principal directions through the origin."""
    if not len(sample):
        return np.eye(width)
    x = sample.astype(np.float64)
    x /= max(1.0, np.abs(x).max(initial=0))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def stages(width: int) -> list[tuple[int, int]]:
    """Ranges of components: an eighth, to a quarter, to a half, the rest."""
    ends = sorted({max(1, width // 8), max(1, width // 4), max(1, width // 2), width})
    return [*zip([0, *ends[:-1]], ends, strict=True)]


class Rotated:
    """Rows with what the stages need of them."""

    def __init__(self, v: np.ndarray, turn: np.ndarray):
        self.v = v
        x = v.astype(np.float64)
        self.y = x @ turn
        self.norm = np.sqrt((x**2).sum(1))
        after = np.cumsum((self.y**2)[:, ::-1], 1)[:, ::-1]
        # lengths of what follows each stage, of the last one none
        self.rest = [np.sqrt(after[:, e]) if e < v.shape[1] else np.zeros(len(v)) for _, e in stages(v.shape[1])]


def survivors(a: Rotated, i: slice, c: Rotated, j: slice, ok: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (row of ``a[i]``, row of ``c[j]``) of ``ok`` whose score may lie in [least, most], and how many components were multiplied."""
    width = a.v.shape[1]
    # rotation and sums round by some units in the last place of each of the products
    slack = (16 * width * 2.0**-52) * a.norm[i][:, None] * c.norm[j][None] + 1e-6
    dense, rows, cols, part, work = True, None, None, np.zeros(ok.shape), 0
    for k, (s, e) in enumerate(stages(width)):
        if dense and ok.mean() < SPARSE:
            rows, cols = np.nonzero(ok)
            part, slack, dense = part[rows, cols], slack[rows, cols], False
        if dense:
            part += a.y[i, s:e] @ c.y[j, s:e].T
            work += ok.size * (e - s)
            room = a.rest[k][i][:, None] * c.rest[k][j][None] + slack
            ok = ok & (part + room >= least[:, None]) & (part - room <= most[:, None])
        else:
            part += np.einsum("nd,nd->n", a.y[i, s:e][rows], c.y[j, s:e][cols])
            work += len(rows) * (e - s)
            room = a.rest[k][i][rows] * c.rest[k][j][cols] + slack
            kept = (part + room >= least[rows]) & (part - room <= most[rows])
            rows, cols, part, slack = rows[kept], cols[kept], part[kept], slack[kept]
    if dense:
        rows, cols = np.nonzero(ok)
    return rows, cols, work


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: in 64 bits where they fit, else in Python's integers, clipped to 64 bits."""
    reach = a.shape[1] * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0))
    if reach < 2**55 or not len(a):  # hundredfold scores fit as well
        return (a.astype(np.int64) * c.astype(np.int64)).sum(1)
    whole = (a.astype(object) * c.astype(object)).sum(1)
    return np.array([max(-TOP - 1, min(TOP, s)) for s in whole], object)


def firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group by descending score, then id; in that order."""
    if score.dtype == object:
        order = np.array(sorted(range(len(group)), key=lambda x: (group[x], -score[x], ids[x])), np.int64)
    else:
        order = np.lexsort((ids, -score, group))
    g = group[order]
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    return order[nth < k]


class Held:
    """The best rows of each group so far, and from which score on another one counts."""

    def __init__(self, groups: int, k: int, start: np.ndarray):
        self.k, self.group, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = start.copy()  # as floats, never above the exact value

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        at = firsts(g, s, i, self.k)
        self.group, self.score, self.id = g[at], s[at], i[at]
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.least)) == self.k)
        last = np.searchsorted(self.group, full, "right") - 1
        kth = np.array([float(x) for x in self.score[last]])
        self.least[full] = np.maximum(self.least[full], kth - np.abs(kth) * 2.0**-50)


def best_rows(a: Rotated, a_ids: np.ndarray, a_labels: np.ndarray, c: Rotated, ids: np.ndarray, labels: np.ndarray, k: int, start: np.ndarray) -> tuple[Held, int]:
    """Each anchor's ``k`` best rows of its label with scores from ``start`` on, and the components multiplied."""
    held, work = Held(len(a_ids), k, start), 0
    for x in range(0, len(a_ids), TILE[0]):
        for y in range(0, len(ids), TILE[1]):
            i, j = slice(x, x + TILE[0]), slice(y, y + TILE[1])
            ok = (a_labels[i][:, None] == labels[j][None]) & (a_ids[i][:, None] != ids[j][None])
            r, q, n = survivors(a, i, c, j, ok, held.least[i], np.full(ok.shape[0], np.inf))
            work += n
            held.add(r + x, products(a.v[i][r], c.v[j][q]), ids[j][q])
    return held, work


def band_rows(a: Rotated, a_ids: np.ndarray, a_labels: np.ndarray, scores: list[list[int]], c: Rotated, ids: np.ndarray, labels: np.ndarray, k: int, low: int, high: int, start: np.ndarray) -> tuple[Held, int]:
    """The ``k`` best rows of other labels in the band of each anchor's positives, whose scores are given.

    Groups are anchor * (most positives) + place; ``start`` has a score for each, to begin with.
    """
    width = start.shape[1]
    exact = object if any(abs(s) >= 2**55 for own in scores for s in own) else np.int64  # hundredfold
    of = np.zeros((len(scores), width), exact)
    there = np.zeros((len(scores), width), bool)
    for n, own in enumerate(scores):
        of[n, : len(own)], there[n, : len(own)] = own, True
    # as floats, moved outwards by more than they round
    wide = lambda x, by: np.array([[float(s) / 100 + by * (abs(float(s)) * 1e-14 + 1) for s in r] for r in x.tolist()]).reshape(x.shape)
    least = np.where(there, np.maximum(wide(of * low, -1), start), np.inf)
    # above a clipped score there is no limit
    most = np.where(there, np.where(of == TOP, np.inf, wide(of * high, 1)), -np.inf).max(1, initial=-np.inf)
    held, work = Held(least.size, k, least.ravel()), 0
    for x in range(0, len(a_ids), TILE[0]):
        for y in range(0, len(ids), TILE[1]):
            i, j = slice(x, x + TILE[0]), slice(y, y + TILE[1])
            ok = (a_labels[i][:, None] != labels[j][None]) & (a_ids[i][:, None] != ids[j][None])
            r, q, n = survivors(a, i, c, j, ok, held.least.reshape(-1, width)[i].min(1, initial=np.inf), most[i])
            work += n
            score, own = products(a.v[i][r], c.v[j][q]), r + x
            for p in range(width):
                fits = there[own, p] & (low * of[own, p] <= 100 * score) & (100 * score <= high * of[own, p])
                held.add(own[fits] * width + p, score[fits], ids[j][q[fits]])
    return held, work


def candidates(vectors: DataFrame, anchors: Column, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (integers), asks and row_no of the rows that take part."""
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), floored(F.col(vector_col), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    return checkpointed(rows.withColumn("row_no", F.monotonically_increasing_id()))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", slice_size: int = SLICE, block: int = BLOCK, report: bool = False) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score of each
    anchor's hard negatives. ``report`` returns the work of each cell instead: pairs and multiplied
    components (as many as pairs times dimensions without discarding)."""
    spark = vectors.sparkSession
    rows = candidates(vectors, anchors, scale, id_col, vector_col, label_col)
    far = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, x, -(x + 1)))
    whole = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("a"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.coalesce(F.max(far), F.lit(0)).alias("far")).first()
    width = max(1, whole.width)
    item = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 64)) if whole.far < 1 << bits)
    rows = rows.withColumn("v", F.col("v").cast(f"array<{item}>"))
    share = F.pmod(F.xxhash64("row_no", F.lit("sample")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(1, whole.n))))
    drawn = rows.where(share).select("id", "label", "v").limit(2 * SAMPLE).collect()
    some = np.array([r.v + [0] * (width - len(r.v)) for r in drawn], np.int64).reshape(-1, width)
    held = (np.array([r.id for r in drawn], np.int64), np.array([r.label for r in drawn], np.int64), some, rotation(some, width))
    shared = spark.sparkContext.broadcast(held)  # at most 2 * SAMPLE rows

    cuts, slices = max(1, -(-whole.n // block)), max(1, -(-whole.a // slice_size))
    spread = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where("asks").withColumn("key", F.xxhash64("v", "label")).dropDuplicates(["id", "key", "v", "label"]).select("id", "key", "label", "v")
    asked = checkpointed(asked.withColumn("slice", spread("id", slices, "a")))
    right = rows.select("id", "label", "v", spread("row_no", cuts, "c").alias("cut")).withColumn("slice", every(slices))
    right = right.toDF("member", "kind", "w", "d", "e")  # names of their own, as both sides come from one table

    def cells(left: DataFrame, work) -> DataFrame:
        """What ``work`` makes of each slice of anchors and block of rows."""
        names = ("anchor_id", "key", "place", "row_id", "score")

        def meet(q: pa.Table, t: pa.Table) -> pa.Table:
            if not q.num_rows or not t.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in names})
            turn = shared.value[3]
            a, c = (Rotated(_matrix(x.column(n), width).astype(np.int64), turn) for x, n in ((q, "v"), (t, "w")))
            own = [x.column(n).to_numpy() for x, n in ((q, "id"), (q, "label"), (t, "member"), (t, "kind"))]
            found, per, done = work(q, a, own[0], own[1], c, own[2], own[3])
            if report:
                return pa.table({"anchor_id": [len(a.v) * len(c.v)], "key": [done], "place": [0], "row_id": [0], "score": [0]})
            keys, at = q.column("key").to_numpy(), found.group // per
            cols = (own[0][at], keys[at], found.group % per, found.id, found.score)
            return pa.table({n: pa.array(x.tolist(), pa.int64()) for n, x in zip(names, cols, strict=True)})

        left = left.withColumn("cut", every(cuts))
        return left.groupBy("slice", "cut").cogroup(right.groupBy("e", "d")).applyInArrow(meet, ", ".join(f"{n} long" for n in names))

    def likely(q: pa.Table, a: Rotated, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """From which score on a row counts, by the sample."""
        s_ids, s_labels, s, turn = shared.value
        if not len(s):
            return np.full(len(ids), -np.inf)
        return best_rows(a, ids, labels, Rotated(s, turn), s_ids, s_labels, positives, np.full(len(ids), -np.inf))[0].least

    def same_label(q, a, ids, labels, c, c_ids, c_labels):
        found, done = best_rows(a, ids, labels, c, c_ids, c_labels, positives, likely(q, a, ids, labels))
        return found, 1, done

    def in_band(q, a, ids, labels, c, c_ids, c_labels):
        scores = [x.as_py() for x in q.column("scores")]
        s_ids, s_labels, s, turn = shared.value
        start = np.full((len(ids), positives), -np.inf)
        if len(s):
            start = band_rows(a, ids, labels, scores, Rotated(s, turn), s_ids, s_labels, negatives, low, high, start)[0].least.reshape(-1, positives)
            start = np.where(np.isfinite(start), start, -np.inf)
        found, done = band_rows(a, ids, labels, scores, c, c_ids, c_labels, negatives, low, high, start)
        return found, positives, done

    first = cells(asked, same_label)
    if report:
        return first.selectExpr("anchor_id pairs", "key work")
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "row_id")
    near = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    near = near.groupBy(F.col("anchor_id").alias("id"), "key").agg(F.sort_array(F.collect_list(F.struct("nth", F.col("row_id").alias("pid"), "score"))).alias("near"))
    near = checkpointed(near)
    second = cells(asked.join(near, ["id", "key"]).select("id", "key", "label", "v", "slice", F.col("near.score").alias("scores")), in_band)
    order = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("score"), "row_id")
    out = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    places = near.select(F.col("id").alias("anchor_id"), "key", F.posexplode("near").alias("place", "p"))
    out = out.join(places.withColumn("place", F.col("place").cast("long")), ["anchor_id", "key", "place"])
    return out.select("anchor_id", F.col("p.pid").alias("positive_id"), "rank", F.col("row_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
