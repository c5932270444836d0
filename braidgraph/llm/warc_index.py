"""WARC archives and their external index merge.

Pages become WARC records, each a gzip member of its own, written in parallel as
archive files; a record's offset is where its member starts, so a reader seeks there.
Of records with equal payloads of at least ``MIN_REVISIT`` bytes one is a response and
the others are revisits without a body. Reading an archive back parses it record by
record and sorts its captures by (URL key, timestamp, page id): a sorted run.

A bounded sample of keys gives the boundaries of ranges of about ``range_rows``
captures. Runs are cut at them into slices of at most ``SLICE`` captures, which travel
as they were sorted, packed. For each range a loser tree merges the runs, unpacking one
slice of each at a time; above ``FAN_IN`` runs the trees' outputs are merged by further
trees. The ranges in order are one capture index in global order. A range is cut by the
whole key down to the place in its archive, so a URL with a third of all captures is
merged by many tasks.

Which records are equal is decided on (page id, digest) rows: digests are counted
with partial sums, and only ids of revisits are joined back. Up to ``BROADCAST_ROWS``
of them they are sent to the pages, beyond that both sides are dealt by page.
Archives are cut by partition size and ``max_records``; a reader holds one compressed
archive at a time.

Defined edge cases: null html is an empty payload; a null url is the empty url; line
ends in urls are percent-encoded; rows that repeat a page id and payload have the
same type and record id, rows that repeat a page id only have ids of their own; a null
page id never is the response of others.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidgraph.llm.common import checkpoint_folder, checkpointed, dealt_join, small_batches

MIN_REVISIT, MAX_RECORDS = 1000, 1000
#: Revisits up to which their ids are broadcast.
BROADCAST_ROWS = 100_000
#: Captures of a range, ranges at most, sampled keys for each, captures of a slice, runs of one loser tree.
RANGE_ROWS, MAX_RANGES, SAMPLES, SLICE, FAN_IN = 20_000, 65_536, 32, 256, 256
#: Captures without a time are dated from this second on, by page id.
EPOCH = 1_704_067_200
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record_types(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that are revisits."""
    slim = pages.select("page_id", "digest").where(F.col("size") >= least)
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    revisits = dealt_join(slim, groups, ["digest"]).where("page_id is null or page_id < refers_to")
    return revisits.groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT, max_records: int = MAX_RECORDS) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) under ``path``."""
    html = F.coalesce("html", F.lit(""))
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    raw = raw.select("page_id", "url", "html", F.octet_length("html").alias("size"), F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    revisits = checkpointed(record_types(raw, least).toDF("revisit_id", "revisit_digest", "refers_to"))
    revisits = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    both = raw.join(revisits, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest")), "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(_HTTP.split("{}")[0]), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1_000_000_000))
    when = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    records = both.select(F.encode(F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")), "UTF-8").alias("record"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(r.as_py()) for r in b.column(0)], pa.binary())], names=["value"])

    # rows end in the zero byte that each member still lacks
    rows = small_batches(records).mapInArrow(compress, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", max_records).text(path)


def member(record: bytes, most: int = 8 << 20) -> bytes:
    """A record as a gzip member without its last byte, which is zero: it is the top byte of a size
    below ``most``. A longer record is several members."""
    out = []
    for at in range(0, max(1, len(record)), most):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [z.compress(record[at : at + most]), z.flush()]
    return b"".join(out)[:-1]


def members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        inflate, pos, parts = zlib.decompressobj(31), at, []
        while not inflate.eof:
            if pos >= len(data):
                raise ValueError("an archive ends within a member")
            parts.append(inflate.decompress(view[pos : pos + step]))
            pos += step
        yield at, b"".join(parts)
        at = min(pos, len(data)) - len(inflate.unused_data)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers (lower-case names), block, and offset of the member that starts it, of each record."""
    held, pos, start = b"", 0, 0
    for offset, content in members(data):
        if pos >= len(held):
            held, pos, start = content, 0, offset
        else:
            held, pos = held[pos:] + content, 0
        while pos < len(held):
            head = held.find(b"\r\n\r\n", pos)
            if head < 0:
                break
            lines = held[pos:head].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record in the member at {start}")
            fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
            end = head + 4 + int(fields["content-length"])
            if end + 4 > len(held):
                break
            if held[end : end + 4] != b"\r\n\r\n":
                raise ValueError(f"the record in the member at {start} is longer than it says")
            yield fields, held[head + 4 : end], start
            pos, start = end + 4, offset
    if pos < len(held):
        raise ValueError("an archive ends within a record")


_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\d*\.)?([^/?#:]*)(?::\d+)?([^#]*)")


def url_key(url: str) -> str:
    """Sort-friendly form: the host's labels from the last, then path and query, in lower case."""
    m = _URL.match(url)
    if not m:
        return url.lower()
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2].lower() or "/")


CAPTURES = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("captured", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())


def _page(name: str | None) -> int | None:
    own = (name or "").strip("<>").split(":")[2:3]
    return int(own[0]) if own and own[0].lstrip("-").isdigit() else None


def _digest(value: str) -> str:
    """Bare lower-case hex of a labelled digest in hex or base32."""
    value = value.partition(":")[2] or value
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def captures(run: str, data: bytes) -> list[tuple]:
    """The sorted run of one archive; a response's digest is taken from its payload and must agree."""
    out = []
    for h, block, at in records(data):
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = _digest(h["warc-payload-digest"]), h.get("warc-payload-length")
        if h["warc-type"] == "response":
            found = hashlib.sha1(payload).hexdigest()
            if found != digest:
                raise ValueError(f"{run}: payload of the record at {at} has digest {found}, not {digest}")
            size = len(payload)
        seconds = int(datetime.strptime(h["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
        url = h["warc-target-uri"]
        out.append((run, url_key(url), seconds, _page(h["warc-record-id"]), url, h["warc-type"], _page(h.get("warc-refers-to")), int(size), digest, at))
    out.sort(key=order_of)
    return out


def order_of(row: tuple) -> tuple:
    """URL key, timestamp, page id (none first), then the place in the archives."""
    return row[1], row[2], row[3] is not None, row[3] or 0, row[9], row[0]


def _batch(rows: list[tuple], more: tuple = ()) -> pa.RecordBatch:
    kinds = (*_KINDS, *(pa.int64() for _ in more))
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*CAPTURES.fieldNames(), *more])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``, each archive's in order."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run, data in zip(b.column(0), b.column(1), strict=True):
                rows = captures(run.as_py().rpartition("/")[2], data.as_py())
                for i in range(0, len(rows), 8192):
                    yield _batch(rows[i : i + 8192])

    return small_batches(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)).select("path", "content").mapInArrow(parse, CAPTURES)


class LoserTree:
    """Merges sorted sources: inner nodes hold the losers of their matches, so the next
    winner is found by replaying one path from a leaf to the root."""

    def __init__(self, sources: list[Iterator[tuple]], key):
        self.key, self.sources, self.k = key, sources, len(sources)
        self.head: list[tuple | None] = [next(s, None) for s in sources]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        kx, ky = self.key(x), self.key(y)
        return kx < ky or kx == ky and a < b

    def _enter(self, i: int) -> None:
        """First matches: a source waits at the first empty node on its way up."""
        node = (i + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = i
                return
            if self._beats(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.head[w := self.loser[0]]) is not None:
            yield row
            self.head[w] = next(self.sources[w], None)
            node = (w + self.k) // 2
            while node > 0:
                if self._beats(self.loser[node], w):
                    self.loser[node], w = w, self.loser[node]
                node //= 2
            self.loser[0] = w


def merged(runs: list[Iterator[tuple]], fan_in: int = FAN_IN) -> Iterator[tuple]:
    """The sorted ``runs`` as one, by loser trees of at most ``fan_in`` sources."""
    while len(runs) > fan_in:
        runs = [iter(LoserTree(runs[i : i + fan_in], order_of)) for i in range(0, len(runs), fan_in)]
    return iter(LoserTree(runs, order_of))


def unpacked(slices: list[bytes]) -> Iterator[tuple]:
    """Captures of consecutive slices, one of which is held at a time."""
    for s in slices:
        yield from pickle.loads(s)


def boundaries(runs: DataFrame, n: int, ranges: int) -> list[tuple]:
    """Keys that cut the captures into about equal ranges, from a bounded sample."""
    share = min(1.0, ranges * SAMPLES / max(1, n))
    drawn = runs.where(F.pmod(F.xxhash64("run", "offset"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * ranges * SAMPLES)
    keys = sorted(order_of(tuple(r)) for r in drawn.collect())
    cuts = (keys[i * len(keys) // ranges] for i in range(1, ranges) if keys)
    return sorted(set(cuts))


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """All captures with ``position``, their place (from 0) in the global order of
    URL key, timestamp and page id. ``runs`` holds each run's rows together and in order."""
    runs = checkpointed(runs)
    spark = runs.sparkSession
    n = runs.count()
    ranges = max(1, min(MAX_RANGES, max(n // range_rows, min(24, n // SLICE))))
    cuts = spark.sparkContext.broadcast(boundaries(runs, n, ranges))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = cuts.value
        run, at, seq, held = None, 0, 0, []
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, seq
            if held:
                out.append((at, run, seq, pickle.dumps(held, 5)))
                seq += 1
            held = []

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["range", "run", "seq", "slice"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = order_of(row)
                if row[0] != run:
                    close()
                    run, at = row[0], bisect_right(bounds, key)
                elif at < len(bounds) and key >= bounds[at]:
                    close()
                    at = bisect_right(bounds, key, at)
                elif len(held) == SLICE:
                    close()
                held.append(row)
            if len(out) >= SLICE:
                yield rows()
        close()
        if out:
            yield rows()

    def merge(t: pa.Table) -> pa.Table:
        of: dict[str, list[tuple[int, bytes]]] = {}
        for run, seq, data in zip(*(t.column(c).to_pylist() for c in ("run", "seq", "slice")), strict=True):
            of.setdefault(run, []).append((seq, data))
        sources = [unpacked([data for _, data in sorted(own)]) for _, own in sorted(of.items())]
        at, held, batches = t.column("range")[0].as_py(), [], []
        for nth, row in enumerate(merged(sources, fan_in)):
            held.append((*row, at, nth))
            if len(held) == 8192:
                batches.append(_batch(held, ("range", "nth")))
                held = []
        return pa.Table.from_batches([*batches, _batch(held, ("range", "nth"))])

    schema = T.StructType([*CAPTURES.fields, T.StructField("range", T.LongType()), T.StructField("nth", T.LongType())])
    sliced = runs.mapInArrow(cut, "range int, run string, seq long, slice binary")
    ordered = checkpointed(sliced.groupBy("range").applyInArrow(merge, schema))
    # a row for each range: how many captures come before it
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("range").count().collect())
    starts, total = [], 0
    for k, size in counts:
        starts.append((k, total))
        total += size
    before = spark.createDataFrame(starts, "range long, start long")
    return ordered.join(F.broadcast(before), "range").withColumn("position", F.col("start") + F.col("nth")).drop("range", "start", "nth")


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    return f"{checkpoint_folder(spark)}/archives-{uuid.uuid4().hex}"
