"""Best-fit packing by exact-complement hashing.

Documents become token sequences; one longer than ``capacity`` is cut so that only
its first piece may be short. What is to be packed is then described by a histogram
of piece lengths, at most ``capacity`` counters however large the corpus is. On it
the driver makes a plan: for each length, from the longest down, combinations of
one, then of two, then of three other lengths that fill the gap exactly are looked up
in indexes of single, pair and triple sums and consumed as often as all their lengths
are available; what is left is placed by best fit, decreasing, many equal bins at a
time. Exact combinations of several short pieces can take what longer ones need, so
plans are made with combinations of at most three, two, one and no other lengths, and
the one of fewest sequences holds. A plan is a list of patterns with a repeat count;
its size is bounded by the number of lengths, not of documents.

Pieces take their place in the plan by their rank among pieces of equal length.
Ranks come from counts per (length, bucket) with buckets dealt by row, so no task
ranks a hot length, or a row that is repeated often, alone.

Defined edge cases: a null text is empty and yields the end token alone; repeated
rows are packed separately; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidgraph.llm.common import checkpointed, small_batches

CAPACITY, END_ID = 1024, 2
#: How byte-level BPE of this family splits texts before merging (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True):
    """Function from text to an array of ids, once per worker.

    With ``specials`` the file's added tokens, where a text spells them out, take
    their own ids, as ``tokenizers`` does by default; else they are plain text.

    Where the vocabulary file numbers its tokens in the order of its merges, as
    byte-level BPE files do, the merge table is applied by ``tiktoken``, which gives
    the same ids at several times the speed; else ``tokenizers`` applies the file. So it
    does for texts that ``tiktoken`` refuses, as it does very long runs of blanks, and
    for those with characters that the two split differently, as their Unicode
    versions differ.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    held: list = []  # the library's tokenizer, loaded when it is needed

    def plainly(text: str) -> np.ndarray:
        if not held:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            tok.encode_special_tokens = not specials
            held.append(tok)
        return np.array(held[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    model, vocab, split = spec["model"], spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    added = spec.get("added_tokens", ())
    special = {t["content"]: t["id"] for t in added}
    # those that take blanks beside them, or whole words only, are left to tokenizers
    plain = not specials or not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
    plain = plain and model["type"] == "BPE" and spec.get("normalizer") is None and not any(model.get(k) for k in ("dropout", "ignore_merges"))
    plain = plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or any(vocab.get(m.replace(" ", "")) != 256 + k for k, m in enumerate(merges)):
        return plainly
    import tiktoken

    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    coder = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special if specials else {})
    same: set[str] = set()  # characters beyond ASCII by which both split alike
    other: set[str] = set()

    def quickly(text: str) -> np.ndarray:
        return np.asarray(coder.encode_to_numpy(text, allowed_special="all", disallowed_special=()), dtype="<u4")

    def alike(text: str) -> bool:
        for c in set(text) - same - other:
            # characters of old, whose kind has not changed since, are of one kind to all
            kind = unicodedata.ucd_3_2_0.category(c)
            beside = f"a{c}a1{c}1.{c}. {c} x\n"
            old = kind != "Cn" and kind == unicodedata.category(c)
            (same if old or np.array_equal(quickly(beside), plainly(beside)) else other).add(c)
        return not other or other.isdisjoint(text)

    def encode(text: str) -> np.ndarray:
        if not text.isascii() and not alike(text):
            return plainly(text)
        try:
            return quickly(text)
        except ValueError:  # its splitter runs out of stack
            return plainly(text)

    return encode


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a sequence of ``total`` ids; only the first may be short."""
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, specials: bool = True) -> DataFrame:
    """Pieces of each document, with their token ids if asked for; map-only."""
    schema = T.StructType([*_PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, specials)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for doc, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(value.as_py() or ""), np.array([end_id], dtype="<u4"))
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    row = (doc, k, s, n, zlib.crc32(part.tobytes()), *([part.astype("i4")] if with_ids else ()))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=schema.fieldNames())

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) with the number of sequences of each."""
    made = [filled(histogram, capacity, depth) for depth in (3, 2, 1, 0)]
    return min(made, key=lambda p: sum(n for _, n in p))


def filled(histogram: dict[int, int], capacity: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan whose exact combinations have at most ``depth`` lengths beside the first."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> bool:
        """Consume the pattern as often as availability allows; whether its first length is used up."""
        need: dict[int, int] = defaultdict(int)
        for n in pattern:
            need[n] += 1
        times = min(left.get(n, 0) // k for n, k in need.items())
        if times:
            out.append((pattern, times))
            for n, k in need.items():
                left[n] -= times * k
                if not left[n]:
                    del left[n]
        return pattern[0] not in left

    if depth:
        take((capacity,))
        for a in sorted(left, reverse=True):
            if a in left:
                take((a, capacity - a))
    lengths = sorted(left)
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if depth > 1:
        for i, x in enumerate(lengths):
            for y in lengths[i:]:
                if x + y < capacity:
                    pairs[x + y].append((x, y))
        for a in reversed(lengths):
            for x, y in reversed(pairs.get(capacity - a, ())):
                if a not in left:
                    break
                if x in left and y in left:
                    take((a, y, x))
    if depth > 2:
        # triples: a third length over the index of pair sums
        for a in reversed(lengths):
            for z in lengths:
                if a not in left or 3 * z > capacity - a:
                    break
                if z not in left:
                    continue
                for x, y in reversed(pairs.get(capacity - a - z, ())):
                    if x >= z and x in left and y in left and take((a, y, x, z)) or z not in left:
                        break
    # residuals: bins of equal content are placed together
    bins: dict[int, list[list]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            room = min((r for r, held in bins.items() if r >= n and held), default=None)
            if room is None:
                each = capacity // n
                full, rest = divmod(todo, each)
                if full:
                    bins[capacity - n * each].append([(n,) * each, full])
                if rest:
                    bins[capacity - n * rest].append([(n,) * rest, 1])
                break
            pattern, count = bins[room].pop()
            each = room // n
            full = min(count, todo // each)
            if full:
                bins[room - n * each].append([pattern + (n,) * each, full])
                todo -= full * each
                count -= full
            if count and 0 < todo < each:
                bins[room - n * todo].append([pattern + (n,) * todo, 1])
                todo = 0
                count -= 1
            if count:
                bins[room].append([pattern, count])
    out += [(pattern, count) for held in bins.values() for pattern, count in held]
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks of the intervals, and the sequence and offset where each begins."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, count in patterns:
        offset = 0
        for n in pattern:
            found[n].append((used[n], first, offset))
            used[n] += count
            offset += n
        first += count
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in found.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, specials: bool = True) -> DataFrame:
    """Pieces with the sequence that holds each and its offset there."""
    pieces = checkpointed(pieces_of(docs, path or default_vocabulary(), capacity, end_id, with_ids, specials))
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(slots(plan(hist, capacity)))
    # ranks within (length, bucket), moved on by the counts of the buckets before
    buckets = max(64, min(4096, sum(hist.values()) // 1_000_000))
    # the checkpoint fixes partitions and the order in them, and so these numbers
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inside)).join(starts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("nth") - 1)
    names = [c for c in pieces.columns]
    at = names.index("length")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            length, rank = b.column(at).to_numpy(), b.column(len(names)).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                firsts, seqs, offs = table[int(n)]
                k = np.searchsorted(firsts, rank[rows], "right") - 1
                sequence[rows] = seqs[k] + rank[rows] - firsts[k]
                offset[rows] = offs[k]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    return ranked.select(*names, "rank").mapInArrow(place, schema)
