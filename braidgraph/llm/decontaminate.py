"""Benchmark decontamination with a generalised suffix automaton.

The words of benchmark items are laid end to end, each item followed by a separator
that no document holds, and a suffix automaton is built over them. Document words are
streamed through it; at each word the automaton yields the longest suffix of the text
read so far that occurs in some item. Where that length reaches the window, the last
``window`` words are an occurrence of an item window. Items shorter than the window
count as one window each; equal ones are one entry of the automaton.

The benchmark is taken in slices of about ``max_words`` item words, a longer item in
parts that overlap by a window less one word. A slice is one narrow pass, whose rows
are checkpointed before the next slice is read and broadcast, so the driver and each
task hold one automaton at a time whatever the benchmark holds. Passes carry the hits
found so far, never a join.

Defined edge cases: a null or empty text has no words and no hits; a null or
wordless item has no window; an item without id marks words but is not listed;
repeated items count once; repeated documents are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidgraph.llm.common import checkpointed, fresh, small_batches

WINDOW = 10
MAX_WORDS = 400_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; bytes above 0x7F belong to words, so UTF-8 needs no decoding."""
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton over the words of several items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        seen: list[set[int]] = [set()]
        ends: list[tuple[int, int, int]] = []
        self.ids = [i for i, _ in items]
        last = 0
        for n, (_, words) in enumerate(items):
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                while len(seen) < len(self.length):
                    seen.append(set())
                seen[last].add(n)
            if 0 < len(words) < window:
                ends.append((last, len(words), n))
            last = self._extend(last, -1 - n)
            while len(seen) < len(self.length):
                seen.append(set())
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(order):  # shorter states than a window are never asked for their items
            if self.length[self.link[v]] >= window:
                seen[self.link[v]] |= seen[v]
        # the state of the window's words that end where a state's words end
        self.at_window = [0] * len(self.length)
        # short windows by the state that holds them: each state lists sizes, of which there are fewer than ``window``
        own: dict[int, dict[int, set[int]]] = {}
        for v, size, n in ends:
            while self.length[self.link[v]] >= size:
                v = self.link[v]
            own.setdefault(v, {}).setdefault(size, set()).add(n)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        self.short_items: list[frozenset[int]] = []
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
            mine = []
            for size, numbers in own.get(v, {}).items():
                mine.append((size, len(self.short_items)))
                self.short_items.append(frozenset(numbers))
            self.short[v] = (*mine, *self.short[up]) if up > 0 else tuple(mine)
        kept = set(self.at_window)
        self.items = {v: frozenset(seen[v]) for v in kept if v}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (start, end) covered by item windows, merged, and the items' numbers."""
        codes = list(map(self.vocab.get, words))
        if not any(c is not None for c in codes):
            return [], set()
        nxt, link, length, short, at, window = self.next, self.link, self.length, self.short, self.at_window, self.window
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        brief: set[int] = set()
        found: set[int] = set()
        v = n = 0
        for i, c in enumerate(codes):
            if c is None:
                v = n = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            else:
                continue
            reach = 0
            if n >= window:
                reach = window
                states.add(at[v])
            for size, item in short[v]:
                if size <= n:
                    reach = max(reach, size)
                    brief.add(item)
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        for s in states:
            found |= self.items[s]
        for s in brief:
            found |= self.short_items[s]
        return spans, found


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Automaton]:
    """Automata over slices of the benchmark, one at a time; rows come to the driver a partition at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.encode(F.col(text_col), "UTF-8").alias("t")).where("t is not null").distinct()
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for r in rows.toLocalIterator():
        words = words_of(bytes(r.t))
        step = max(1, max_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            if part := words[at : at + step + window - 1]:
                held.append((r.i, part))
                size += len(part)
            if size >= max_words:
                yield Automaton(held, window)
                held, size = [], 0
    if held:
        yield Automaton(held, window)


def match(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, max_words: int = MAX_WORDS, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, then n_words, spans (merged word spans that item
    windows cover) and items (sorted ids of the items whose windows occur)."""
    sc = docs.sparkSession.sparkContext
    fields = [docs.schema[c] for c in keep]
    raw, spans_c, items_c, n_c = "__bytes", "__spans", "__items", "__n"
    cur = small_batches(docs).select(*keep, F.encode(F.col(text_col), "UTF-8").alias(raw))
    span_t = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField(raw, T.BinaryType()), T.StructField(n_c, T.LongType()), T.StructField(spans_c, span_t), T.StructField(items_c, T.ArrayType(T.StringType()))])
    pa_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(cur: DataFrame, shared, first: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = shared.value
            for b in batches:
                counts, all_spans, all_items = [], [], []
                texts = b.column(len(keep))
                for j in range(b.num_rows):
                    words = words_of(texts[j].as_py())
                    spans, found = a.spans(words)
                    ids = {a.ids[n] for n in found} - {None}
                    if not first:
                        spans = merged(spans + [(s["start"], s["end"]) for s in b.column(len(keep) + 2)[j].as_py()])
                        ids |= set(b.column(len(keep) + 3)[j].as_py())
                    counts.append(len(words))
                    all_spans.append([{"start": s, "end": e} for s, e in spans])
                    all_items.append(sorted(ids))
                cols = [*(b.column(i) for i in range(len(keep))), texts, pa.array(counts, pa.int64()), pa.array(all_spans, pa_span), pa.array(all_items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, raw, n_c, spans_c, items_c])

        return cur.mapInArrow(run, schema)

    shared = None
    for k, automaton in enumerate(automata(benchmark, window, max_words)):
        if shared is not None:  # rows are past the slice before, which can go
            cur = checkpointed(cur)
            shared.unpersist()
        shared = sc.broadcast(automaton)
        cur = one(cur, shared, k == 0)
    if shared is None:
        cur = one(cur, sc.broadcast(Automaton([], window)), True)
    return cur.select(*keep, raw, F.col(n_c).alias("n_words"), F.col(spans_c).alias("spans"), F.col(items_c).alias("items"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    slim = docs.select("doc_id", "text")
    m = match(slim, benchmark, ["doc_id"], window, max_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return m.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to its last."""
    where = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : where[s][0]])
        at = where[e - 1][1]
    out.append(text[at:])
    return b"".join(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with contaminated spans cut out of ``text`` (``n_chars`` follows it).

    A document of which more than ``max_coverage`` of the words are hit goes as a
    whole; clean documents stay as they are, null texts included. Cutting can bring
    an item's window together again from its two sides, so the cut text is matched
    and cut again until no slice of the benchmark hits it: with several slices, until
    a round over all of them has cut nothing.
    """
    names = docs.columns
    sc = docs.sparkSession.sparkContext
    t_at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    total_c, lost_c, round_c = (fresh(docs, c) for c in ("__total", "__lost", "__round"))
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in (total_c, lost_c, round_c))])

    def one(cur: DataFrame, shared, turn: int) -> DataFrame:
        """Cuts of one slice; rows keep their words at first, those lost, and the round that cut them last."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = shared.value
            for b in batches:
                raw = b.column(t_at).cast(pa.binary()).to_pylist()
                total, lost, when = (b.column(len(names) + i).to_pylist() for i in range(3))
                touched = []
                for j, text in enumerate(raw):
                    # a text that the round before did not cut has nothing new to find
                    if not text or when[j] < turn - 1:
                        continue
                    if not (spans := a.spans(words := words_of(text))[0]):
                        continue
                    total[j] = total[j] or len(words)
                    while spans:
                        text = cut_words(text, spans)
                        lost[j] += sum(e - s for s, e in spans)
                        spans = a.spans(words_of(text))[0]
                    raw[j], when[j] = text, turn
                    touched.append(j)
                cols = list(b.columns)
                if touched:
                    texts = [None if t is None else t.decode() for t in raw]
                    cols[t_at] = pa.array(texts, cols[t_at].type)
                    if n_at is not None:
                        counts = b.column(n_at).to_pylist()
                        for j in touched:
                            counts[j] = len(texts[j])
                        cols[n_at] = pa.array(counts, cols[n_at].type)
                    cols[len(names) :] = [pa.array(c, pa.int64()) for c in (total, lost, when)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

        return cur.mapInArrow(run, schema)

    zero = F.lit(0).cast("long")
    cur = small_batches(docs).withColumns({total_c: zero, lost_c: zero, round_c: zero})
    turn, slices = 1, 0
    while True:
        shared, slices = None, 0
        for automaton in automata(benchmark, window, max_words):
            if shared is not None:
                cur = checkpointed(cur)
                shared.unpersist()
            shared = sc.broadcast(automaton)
            cur, slices = one(cur, shared, turn), slices + 1
        if slices < 2:
            break
        cur = checkpointed(cur)
        shared.unpersist()
        if cur.where(F.col(round_c) == turn).isEmpty():
            break
        turn += 1
    kept = cur.where((F.col(lost_c) == 0) | (F.col(lost_c) <= max_coverage * F.col(total_c)))
    return kept.select(*names)
