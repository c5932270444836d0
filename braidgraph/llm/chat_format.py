"""Chat formatting with typed content parts.

A message's content is a list of typed parts: text, image, audio or document. A
visitor flattens the parts in order into one string of escaped text and numbered
placeholders, and records for each attachment its reference, its place in the
string and the number of tokens that it will expand to. Each turn becomes one
segment

    <|turn|>ROLE\\n BODY <|end|>\\n

(without the blanks), so a conversation is the plain concatenation of its turns'
segments and formatting needs no grouping. Control strings inside texts and roles
are escaped reversibly: ``\\`` is doubled, and the first character of each control
string is replaced by ``\\l`` (for ``<``) or ``\\b`` (for ``[``), so an escaped
text holds no control string at all. The loss mask covers the text parts of
assistant turns.

Defined edge cases: null text or content is empty; sizes that are null, negative or
not finite are 0, and an attachment expands to one token at least (a document to one page's); a null role is the empty role; a
part of unknown type is kept as a placeholder of type ``other``; rows with equal
turns keep the order of role, then segment; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidgraph.llm.common import small_batches

TURN, END = "<|turn|>", "<|end|>"
#: Strings that act as control strings in this or other common templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(["\\\\", *(re.escape(c) for c in CONTROL)]))
_UNESCAPE = re.compile(r"\\([\\lbn])")
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_SEGMENT = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document|other):\d+\|>")

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else ("\\l" if m[0][0] == "<" else "\\b") + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


def sized(x: float | None) -> float:
    """A size that counts: 0 for one that is null, negative, not finite or beyond all measure."""
    return x if x is not None and 0 < x < 1e12 else 0


@dataclass
class Flattener:
    """Visits the parts of one message in order."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 1024
    pieces: list[str] = field(default_factory=list)
    at: int = 0
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = (part.get("type") or "other").lower()
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        s = escape(part.get("text") or "")
        if s:
            self.texts.append((self.at, self.at + len(s)))
        self._put(s)

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil(sized(part.get("width")) / self.patch) * math.ceil(sized(part.get("height")) / self.patch)
        self._attach("image", part, max(1, tiles))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil(sized(part.get("seconds")) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, sized(part.get("pages"))) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "offset": self.at, "n_tokens": tokens})
        self._put(f"<|{kind}:{len(self.attachments) - 1}|>")

    def _put(self, s: str) -> None:
        self.pieces.append(s)
        self.at += len(s)


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """Segment, spans of the segment under the loss mask, and attachments (offsets in the segment)."""
    head = f"{TURN}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
    f = Flattener(at=len(head))
    for p in parts:
        f.visit(p)
    return head + "".join(f.pieces) + END + "\n", f.texts if role == "assistant" else [], f.attachments


def read_segments(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string; placeholders are left out of the text."""
    return [(unescape(m[1]), unescape(_PLACE.sub("", m[2]))) for m in _SEGMENT.finditer(formatted)]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ATTACHED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType())])
SEGMENTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("loss", T.ArrayType(_SPAN)),
        T.StructField("attachments", T.ArrayType(_ATTACHED)),
        T.StructField("expanded_tokens", T.LongType()),
    ]
)
_PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PA_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64())]))


def format_turns(turns: DataFrame) -> DataFrame:
    """One segment per row of ``turns`` (conv_id, turn, role, and ``text`` or ``parts``); map-only."""
    typed = "parts" in turns.columns
    content = F.col("parts") if typed else F.col("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments, loss, attached, tokens = [], [], [], []
            for role, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                parts = [p for p in c or [] if p] if typed else [{"type": "text", "text": c}]
                s, spans, found = format_turn(role, parts)
                segments.append(s)
                loss.append([{"start": x, "end": y} for x, y in spans])
                attached.append(found)
                tokens.append(sum(a["n_tokens"] for a in found))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(segments, pa.string()), pa.array(loss, _PA_SPANS), pa.array(attached, _PA_ATTACHED), pa.array(tokens, pa.int64())], names=SEGMENTS.fieldNames())

    return small_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), content.alias("content")).mapInArrow(run, SEGMENTS)


_DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


class _Reader:
    """Reads one conversation back, segment by segment, and keeps digests only."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, spans: list[dict]) -> None:
        for role, text in read_segments(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for s in spans:
            text = unescape(segment[s["start"] : s["end"]])
            self.loss += len(text)
            self.masked.update(text.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Digests per conversation, read from the formatted segments.

    Rows are sorted by conversation and turn within partitions and streamed, so a
    conversation of any length needs one segment's memory; a digest of a
    conversation is sequential by nature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur: _Reader | None = None
        for b in batches:
            done = []
            for conv, segment, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if cur is None or cur.conv_id != conv:
                    if cur is not None:
                        done.append(cur.row())
                    cur = _Reader(conv)
                cur.add(segment, spans)
            if done:
                yield _rows(done)
        if cur is not None:
            yield _rows([cur.row()])

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return dealt.select("conv_id", "segment", "loss").mapInArrow(run, _DIGESTS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_DIGESTS.fieldNames())
