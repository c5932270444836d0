"""Line dedup by a suffix array over line-ID sequences.

A document is the sequence of its lines' IDs (hashes). Suffixes of all sequences are
ranked by distributed prefix doubling: the rank of a suffix among those that share
their first n lines, paired with the rank of the suffix some lines on, gives ranks by
more lines. Each round counts distinct pairs with partial sums, range-sorts the pairs
that occur again, and numbers them by running counts over sorted ranges, so a line that
a third of all documents share is one pre-summed row. A suffix whose pair occurs once,
or whose document ends, is finished and leaves; doubling ends when all have left, so it
follows the longest repeated run however long it is.

Suffixes of one rank by n lines form an interval of the suffix array with longest
common prefix n or more. Of an interval its first member in corpus order (document id,
then text hash, then line) keeps its copy. Each suffix has a deepest interval in which
it is not the first: so many lines, at least, it repeats of an earlier place. Lengths
go up by one line to ``min_words`` and double from there. A repeated run is deleted
from where it comes later if it holds at least ``min_words`` words. As a line counts
one word or more, whether a run qualifies is settled at lengths up to ``min_words``,
where intervals are exact; a longer run of n lines is the union of the deepest
intervals of its suffixes, of which the last begins where the run has as many lines
left. What overlaps is one run.

Lines whose ID occurs once can't be part of a repeat and leave before any ranking.

Defined edge cases: null texts stay null and have no lines; an empty text is one
empty line; lines count at least one word; rows that repeat both id and text are one
document to the ranking and are cut alike; null ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidgraph.llm.common import checkpointed, dealt_join, fresh, shuffles_released, small_batches

MIN_WORDS = 4
_LOW = -(2**63)
PLACE = ("d", "t", "pos")


def _keyed(docs: DataFrame) -> DataFrame:
    """Text and document key (id, hash of the text)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("d"), F.xxhash64("text").alias("t"), "text")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(d, t, pos, words, r) of the lines whose ID occurs more than once; r is the ID."""
    lines = _keyed(docs).where("text is not null").select("d", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    ids = lines.select("d", "t", "pos", F.greatest(F.lit(1), F.regexp_count("line", F.lit(r"\S+"))).alias("words"), F.xxhash64("line").alias("r"))
    again = ids.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r")
    # rows that repeat both id and text count for the filter, then become one document
    return dealt_join(ids, again, ["r"], "left_semi").select("d", "t", "pos", "words", "r").distinct()


def number_pairs(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Distinct (a, b) with their counts n, numbered by how many rows sort before them, and the
    number of rows; ``first`` stays."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(pairs.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b").withColumn("part", F.spark_partition_id()))
    with shuffles_released(spark):
        counts = sorted((r[0], r[1]) for r in dealt.groupBy("part").agg(F.sum("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    # one row for each range
    before = spark.createDataFrame(starts, "part int, start long")
    longs = ["a", "b", "part", "nth", *PLACE]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in longs])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            n = b.column(2).to_numpy()
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(seen + ends - n), *b.columns[4:]], names=longs)
            seen += int(ends[-1]) if len(ends) else 0

    # each partition is one sorted range, in order
    flat = dealt.select("a", "b", "n", F.col("part").cast("long"), *(F.col(f"first.{c}").cast("long").alias(c) for c in PLACE))
    numbered = flat.mapInArrow(running, schema).join(F.broadcast(before), "part")
    return numbered.select("a", "b", (F.col("start") + F.col("nth")).alias("rank"), F.struct(*PLACE).alias("first")), total


def _place() -> Column:
    return F.struct(*(F.col(c).cast("long").alias(c) for c in PLACE))


def doubled(lines: DataFrame, min_words: int) -> Iterator[tuple[int, DataFrame]]:
    """Lengths and, of each, the suffixes (d, t, pos, r, later) whose first so many lines occur again:
    their rank, and whether an earlier place has them too. Ends where no more would follow."""
    firsts = lines.groupBy("r").agg(F.min(_place()).alias("first"))
    cur = checkpointed(dealt_join(lines.select(*PLACE, "r"), firsts, ["r"]).select(*PLACE, "r", (_place() != F.col("first")).alias("later")))
    size = 1
    while True:
        yield size, cur
        longer = size + 1 if size < min_words else 2 * size
        # the suffix so many lines on that both together have the longer prefix; a finished one is missing
        on = Window.partitionBy("d", "t").orderBy("pos").rangeBetween(longer - size, longer - size)
        paired = checkpointed(cur.select(*PLACE, F.col("r").alias("a"), F.first("r").over(on).alias("b")).where("b is not null"))
        pairs = paired.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
        ranks, total = number_pairs(pairs)
        if not total:
            return
        ranked = dealt_join(paired, ranks, ["a", "b"])
        cur = checkpointed(ranked.select(*PLACE, F.col("rank").alias("r"), (_place() != F.col("first")).alias("later")))
        size = longer


def runs_of(pos: np.ndarray, words: np.ndarray, deepest: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of the runs of one document: the union of what its suffixes repeat, as far as
    that has ``min_words`` words. ``deepest`` is 0 for a suffix that repeats nothing."""
    sums = np.concatenate([[0], np.cumsum(words)])
    at = np.flatnonzero(deepest)
    # the lines of a repeated prefix are repeated lines, so they follow each other here
    at = at[sums[at + deepest[at]] - sums[at] >= min_words]
    out: list[tuple[int, int]] = []
    for i in at.tolist():
        start, size = int(pos[i]), int(deepest[i])
        if out and start < out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + size - out[-1][0]))
        else:
            out.append((start, size))
    return out


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, start, length) of the later copies of repeated runs, in lines."""
    lines = checkpointed(repeated_lines(docs))
    zero = F.lit(0).cast("long")
    rows = lines.select(*PLACE, F.col("words").cast("long").alias("words"), zero.alias("size"))
    for size, suffixes in doubled(lines, min_words):
        rows = rows.unionByName(suffixes.where("later").select(*PLACE, zero.alias("words"), F.lit(size).cast("long").alias("size")))
    names = ["d", "t", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows_of(block: np.ndarray) -> list[tuple[int, ...]]:
            pos, firsts = np.unique(block[:, 2], return_index=True)
            # of each line one row has its words; the others the lengths of its intervals
            words, deepest = np.add.reduceat(block[:, 3], firsts), np.maximum.reduceat(block[:, 4], firsts)
            return [(block[0, 0], block[0, 1], s, n) for s, n in runs_of(pos, words, deepest, min_words)]

        def out(found: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

        for batch in batches:
            block = np.stack([c.to_numpy().astype(np.int64, copy=False) for c in batch.columns], 1)
            cuts = [0, *(np.flatnonzero((block[1:, :2] != block[:-1, :2]).any(1)) + 1), len(block)]
            found = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (held[-1][-1, :2] != block[s, :2]).any():
                    found += rows_of(np.concatenate(held))
                    held = []
                held.append(block[s:e])
            yield from out(found)
        if held:
            yield from out(rows_of(np.concatenate(held)))

    by_doc = rows.repartition("d", "t").sortWithinPartitions(*PLACE)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    return by_doc.select("d", "t", F.col("pos").cast("long"), "words", "size").mapInArrow(run, schema)


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, runs): the later copies' line runs of each document that has any."""
    runs = later_runs(docs, min_words).groupBy("d", "t")
    return runs.agg(F.collect_list(F.struct("start", "length")).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = True, report: bool = False) -> DataFrame:
    """``docs`` without the lines of later copies (``n_chars`` follows ``text``).

    Documents of which no line is left go if ``drop_emptied``. With ``report``,
    columns n_lines and n_deleted are added.
    """
    d, t, runs = (fresh(docs, n) for n in ("__d", "__t", "__runs"))
    gone = deletions(docs, min_words).toDF(d, t, runs)
    wide = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))).withColumn(t, F.xxhash64("text"))
    both = wide.join(gone, [d, t], "left").select(*docs.columns, runs)
    names, schema = docs.columns, T.StructType([*docs.schema.fields, *([T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())] if report else [])])
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep, totals, deleted = b.column(at).to_pylist(), [], [], []
            touched = False
            for i, (text, spans) in enumerate(zip(texts, b.column(len(names)).to_pylist(), strict=True)):
                if not spans or text is None:
                    keep.append(True)
                    totals.append(0 if text is None else text.count("\n") + 1)
                    deleted.append(0)
                    continue
                lines = text.split("\n")
                left = np.ones(len(lines), bool)
                for s in spans:
                    left[s["start"] : s["start"] + s["length"]] = False
                texts[i] = "\n".join(x for x, stays in zip(lines, left, strict=True) if stays)
                touched = True
                keep.append(bool(left.any()) or not drop_emptied)
                totals.append(len(lines))
                deleted.append(int((~left).sum()))
            cols = [b.column(i) for i in range(len(names))]
            if touched:
                cols[at] = pa.array(texts, cols[at].type)
                if n_at is not None:
                    counts = b.column(n_at).to_pylist()
                    cols[n_at] = pa.array([len(x) if s and x is not None else n for x, s, n in zip(texts, b.column(len(names)).to_pylist(), counts, strict=True)], cols[n_at].type)
            if report:
                cols += [pa.array(totals, pa.int64()), pa.array(deleted, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames()).filter(pa.array(keep, pa.bool_()))

    return small_batches(both).mapInArrow(cut, schema)
