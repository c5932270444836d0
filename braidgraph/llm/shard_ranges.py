"""Sharding by sampled splitters.

Records are keyed by (checksum of the text, id, row number): equal texts are
neighbours. Rows are sampled with a chance in proportion to record size, their
quantiles by size become splitters of ranges, and records fall into ranges by binary
search. The exact rows and bytes of each range are then counted; a range with more
than its due is sampled again and subdivided, so a text that a third of all records
share is cut at its ids, and an id that repeats with its text at its row numbers.
Exact running sums inside ranges, moved on by the sums of the ranges
before, give each record its exact place among all bytes, and equal slices of that
order are the shards: their sizes differ by about one record.

Only samples and range totals, both bounded by parameters, reach the driver: each row
is drawn on its own, however often its key repeats. The narrow key table is
checkpointed with its row numbers, so samples, totals and places agree whatever is
recomputed. Rows of one key are equal, so how they are numbered changes no result.

Defined edge cases: a null text has size 8 and checksum 0; null ids come first;
repeated rows are placed separately; with fewer records than shards, shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.llm.common import checkpointed

SHARDS = 24
#: Bounds on what the driver holds: ranges, and sampled keys for each.
MAX_RANGES, SAMPLES = 4096, 24
_LOW = -(2**63)


#: A record's key; the row number tells repeated rows apart.
KEY = ("text_crc32", "key_id", "row_no")
Key = tuple[int, int, int]


def _locate(keys: list[np.ndarray], at: list[np.ndarray]) -> np.ndarray:
    """Number of splitters at or below each key, both given by columns."""
    lo, hi = np.searchsorted(at[0], keys[0], "left"), np.searchsorted(at[0], keys[0], "right")
    if len(keys) == 1:
        return hi
    out = lo.copy()
    # keys that agree with splitters so far are told apart by the next column
    tied = np.flatnonzero(hi > lo)
    for first in np.unique(lo[tied]):
        rows = tied[lo[tied] == first]
        a, z = lo[rows[0]], hi[rows[0]]
        out[rows] = a + _locate([k[rows] for k in keys[1:]], [x[a:z] for x in at[1:]])
    return out


def _columns(keys: list[Key]) -> list[np.ndarray]:
    return [np.array([k[i] for k in keys], np.int64) for i in range(len(KEY))]


def _ranged(keys: DataFrame, splitters: list[Key]) -> DataFrame:
    at = _columns(splitters)

    @F.pandas_udf("long")
    def where(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(_locate([c.to_numpy() for c in part], at))

    return keys.withColumn("range", where(*KEY))


def _sample(keys: DataFrame, total: int, wanted: int) -> list[tuple[Key, int]]:
    """(key, weight) of sampled rows in key order, about ``wanted`` of them, drawn by size."""
    if not total:
        return []
    # a fixed pseudo-random number in [0, 1) for each row
    u = F.pmod(F.xxhash64("row_no", F.lit("splitters")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = keys.where(u < F.col("size") * F.lit(wanted / total)).select(*KEY, "size").collect()
    return sorted(((r[0], r[1], r[2]), max(r[3], total // wanted)) for r in drawn)


def _quantiles(sample: list[tuple[Key, int]], parts: int) -> list[Key]:
    """Keys that cut the sampled weight into ``parts``."""
    total, seen, out = sum(w for _, w in sample), 0, []
    for key, w in sample:
        seen += w
        if seen * parts >= (len(out) + 1) * total and len(out) < parts - 1 and key not in out[-1:]:
            out.append(key)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, max_ranges: int = MAX_RANGES, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per record: its id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null)."""
    text = F.col(text_col)
    keys = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32")).withColumn("key_id", F.coalesce("doc_id", F.lit(_LOW))).withColumn("row_no", F.monotonically_increasing_id()))
    whole = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    parts = max(4 * shards, min(max_ranges, whole.n // 250_000))
    splitters = _quantiles(_sample(keys, whole.b, parts * samples), parts)
    totals = lambda d: {r[0]: (r[1], r[2]) for r in d.groupBy("range").agg(F.count("*"), F.sum("size")).collect()}
    ranged = _ranged(keys, splitters)
    held = totals(ranged)
    for _ in range(3):
        due_n, due_b = 2 * max(1, whole.n // parts), 2 * max(1, whole.b // parts)
        over = [k for k, (n, b) in held.items() if n > 1 and (n > due_n or b > due_b)]
        if not over:
            break
        added = set()
        inner = ranged.where(F.col("range").isin(over))
        rows_b = sum(held[k][1] for k in over)
        sample = _sample(inner, rows_b, samples * sum(-(-2 * max(held[k][0] * due_b, held[k][1] * due_n) // (due_n * due_b)) for k in over))
        of = _locate(_columns([k for k, _ in sample]), _columns(splitters)) if sample else []
        for k in over:
            n, b = held[k]
            own = [s for s, r in zip(sample, of, strict=True) if r == k]
            added |= set(_quantiles(own, int(max(2, -(-2 * n // due_n), -(-2 * b // due_b)))))
        if added <= set(splitters):
            break
        splitters = sorted(set(splitters) | added)
        ranged = _ranged(keys, splitters)
        held = totals(ranged)
    first_n, first_b, at_n, at_b = [], [], 0, 0
    for k in range(len(splitters) + 1):
        n, b = held.get(k, (0, 0))
        first_n.append(at_n)
        first_b.append(at_b)
        at_n, at_b = at_n + n, at_b + b

    @F.pandas_udf("first_n long, first_b long")
    def firsts(r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"first_n": np.array(first_n, np.int64)[r], "first_b": np.array(first_b, np.int64)[r]})

    order = Window.partitionBy("range").orderBy(*KEY)
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("nth", F.row_number().over(order)).withColumn("sum", F.sum("size").over(before)).withColumn("at", firsts("range"))
    # twice the bytes before a record's middle, as a share of twice all bytes
    middle = (2 * (F.col("at.first_b") + F.col("sum")) - F.col("size")) * F.lit(shards)
    own = (middle - middle % F.lit(2 * max(1, whole.b))) / F.lit(2 * max(1, whole.b))
    placed = placed.withColumn("rank", F.col("at.first_n") + F.col("nth") - 1)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), own).cast("int"))
    placed = checkpointed(placed.select("doc_id", "size", "text_crc32", "shard", "rank"))
    begins = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("rank")).collect()}
    begin = F.element_at(F.create_map(*(F.lit(x) for kv in begins.items() for x in kv)), F.col("shard")) if begins else F.lit(0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
