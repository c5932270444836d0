"""BPE encoding through a lexicon that is a minimal acyclic transducer, and decoding.

1. *Counts.* Every task splits its texts into words, as byte-level BPE does before it
   merges, and counts them; the counts of all tasks are summed. A histogram of rounded
   counts says which count the ``LEXICON`` most frequent words have at least.
2. *Lexicon.* Tasks merge those words into their ids. Sorted by bytes, words and ids are
   compiled into an acyclic transducer whose transitions carry ids: common beginnings
   share states, ids move towards the start as far as all words that pass agree, and
   states with the same continuations are one. It has one file, a few arrays long,
   written to the shared folder under its content's name and added to the session's
   files, so each executor has one copy that its Python workers map into memory.
3. *Encoding.* The distinct words of a block of texts walk through the automaton side
   by side, a byte at a time; the ids met on the way are the word's. A word that leaves
   it is unseen and is merged exactly, pair by pair in the order of ranks.
4. *Decoding.* Ids are replaced by their bytes; what is not UTF-8 becomes U+FFFD.

The lexicon's bound is a parameter and decides about speed only, as unseen words get
the same ids by merging. Splitting uses Python's regular expressions; a text with a
character that these and the library's own splitter, from another Unicode version, may
class differently is split by the latter.

Defined edge cases: a null text is empty and has no ids; repeated rows are encoded each;
an empty table gives no rows; other columns take no part. Added tokens that a text
spells out take their own ids, as ``tokenizers`` does by default. Ids that the
vocabulary does not have decode to nothing. A vocabulary file of another kind than
byte-level BPE without a normaliser is an error.
"""

from __future__ import annotations

import heapq
import json
import mmap
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm.common import checkpoint_folder, checkpointed, small_batches
from braidgraph.llm.pack_exact import PATTERN, default_vocabulary

#: Words in the lexicon, at most, and bytes of the longest that may be there.
LEXICON, LONGEST = 131_072, 48
#: Words looked up together, characters split at once, and words counted before they are handed on.
BLOCK_WORDS, BLOCK_CHARS, HELD = 400_000, 1 << 20, 200_000
#: Words of up to so many bytes are merged together, so many at a time; longer ones one by one, with a heap.
WIDTHS, SIDE_BY_SIDE = (8, 12, 16, 24, 48), 50_000
NONE = (1 << 31) - 1
_ID = (1 << 32) - 1

Words = list  # of str, or of int for an added token


class Vocabulary:
    """A byte-level BPE file: merge ranks, bytes of each id, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and spec.get("normalizer") is None and (spec.get("decoder") or {}).get("type") == "ByteLevel"
        plain = plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        added = spec.get("added_tokens", ())
        if not plain or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        # the printable stand-ins of the 256 bytes (fixed by the file format)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in ids.items() if t not in self.added} | {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = [ids[c] for c in sorted(byte_of, key=byte_of.get)]
        # pair of ids -> rank of its merge, and the merged id in the lower half
        self.rules = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rules[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]
        # the same as sorted arrays, and as a table for pairs of bytes
        self.pair_keys = np.array(sorted(self.rules) or [-1], np.int64)
        self.pair_ranks = np.array([self.rules[k] >> 32 for k in sorted(self.rules)] or [NONE], np.int32)
        self.rank_ids = np.array([r & _ID for r in sorted(self.rules.values())], np.int32)
        self.byte_table = np.array(self.byte_ids, np.int32)
        self.byte_ranks = self._rank(np.repeat(self.byte_table, 256), np.tile(self.byte_table, 256)).astype(np.int32).reshape(256, 256)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.spelled = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.words = regex.compile(PATTERN)
        self.same: set[str] = set()  # characters that both splitters class alike
        self.other: set[str] = set()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has: adjacent pairs are
        merged by rank, then from the left, of words of similar length side by side."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, counts, ids
        low = 0
        for high in WIDTHS:
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for i in range(0, len(at), SIDE_BY_SIDE):
                found += self._merge_rows(at[i : i + SIDE_BY_SIDE], [words[k] for k in at[i : i + SIDE_BY_SIDE].tolist()])
            low = high
        for k in np.flatnonzero(sizes > low).tolist():
            ids = self._merge_long([self.byte_ids[b] for b in words[k]])
            found.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int32)))
        counts = np.zeros(len(words), np.int64)
        if not found:
            return np.empty(0, np.uint32), counts
        which, sizes, pool = (np.concatenate([f[i] for f in found]) for i in range(3))
        starts = np.empty(len(words), np.int64)
        starts[which], counts[which] = np.cumsum(sizes) - sizes, sizes
        some = counts > 0
        return gathered(pool, starts[some], counts[some]).astype(np.uint32), counts

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``NONE`` where there is no such merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], NONE)

    def _merge_rows(self, which: np.ndarray, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = int(n.max())
        raw = np.zeros((len(words), width), np.uint8)
        raw[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(np.arange(width) < n[:, None], self.byte_table[raw], -1)
        ranks = np.full(ids.shape, NONE, np.int32)  # of each id with the next; the last column has none
        inside = np.arange(width - 1) < n[:, None] - 1
        ranks[:, :-1] = np.where(inside, self.byte_ranks[raw[:, :-1], raw[:, 1:]], NONE)
        col = np.arange(width)
        while len(which):
            i = ranks.argmin(1)
            row = np.arange(len(which))
            least = ranks[row, i]
            done = least == NONE
            if done.any():
                yield which[done], n[done], ids[done][col[None, : ids.shape[1]] < n[done][:, None]]
                which, n, ids, ranks, i, least = (x[~done] for x in (which, n, ids, ranks, i, least))
                row = row[: len(which)]
            if not len(which):
                return
            move = np.minimum(col + (col > i[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, move, 1), np.take_along_axis(ranks, move, 1)
            n = n - 1
            ids[row, i] = self.rank_ids[least]
            ids[row, n], ranks[row, n], ranks[row, n - 1] = -1, NONE, NONE
            mine, after = ids[row, i], ids[row, np.minimum(i + 1, width - 1)]
            ranks[row, i] = np.where(i + 1 < n, self._rank(mine, after), NONE)
            inner = np.flatnonzero(i > 0)
            ranks[inner, i[inner] - 1] = self._rank(ids[inner, i[inner] - 1], mine[inner])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Of one word, with the pairs in a heap and the ids linked."""
        after, before = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)]
        todo = []

        def meet(i: int, j: int) -> None:
            if (r := self.rules.get(ids[i] << 32 | ids[j])) is not None:
                todo.append((r, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            meet(i, i + 1)
        heapq.heapify(todo)
        while todo:
            r, i, a, b = heapq.heappop(todo)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = r & _ID, -1
            after[i] = after[j]
            beside = [(before[i], i), (i, after[i])]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in beside:
                if x >= 0 and y < len(ids) and (m := self.rules.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(todo, (m, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def classed_alike(self, text: str) -> bool:
        """Whether both splitters class all of the text's characters alike."""
        if text.isascii():
            return True
        new = {c for c in set(text) if c not in self.same and c not in self.other}
        if new:
            probe = {c: f"a{c}a1{c}1.{c}. {c} x\n" for c in new}
            if self._split_alike("".join(probe.values())):
                self.same |= new
            else:
                for c, s in probe.items():
                    (self.same if self._split_alike(s) else self.other).add(c)
        return not self.other or self.other.isdisjoint(text)

    def _split_alike(self, text: str) -> bool:
        return self.words.findall(text) == _library_words(text)

    def split(self, text: str) -> Iterator[Words]:
        """The text's words, some at a time; an added token is its id."""
        at = 0
        for m in self.spelled.finditer(text) if self.spelled else ():
            yield from self._plain(text[at : m.start()])
            yield [self.added[m.group()]]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[Words]:
        if not text:
            return
        if not self.classed_alike(text):
            yield _library_words(text)
        elif len(text) <= BLOCK_CHARS:
            yield self.words.findall(text)
        else:
            found = self.words.finditer(text)
            while some := [m.group() for m in islice(found, BLOCK_WORDS)]:
                yield some


def _library_words(text: str) -> list[str]:
    from tokenizers import pre_tokenizers

    return [text[s:e] for _, (s, e) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Once per worker."""
    return Vocabulary(path)


class _State:
    __slots__ = ("arcs", "final", "left")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}  # byte -> [state or its number, ids]
        self.final, self.left = False, ()


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of the minimal transducer for distinct (word, ids) in ascending order of words."""
    numbers: dict[tuple, int] = {}
    states: list[tuple] = []

    def settled(s: _State) -> int:
        """The number of the state that continues as ``s`` does."""
        key = (s.final, s.left, tuple((b, *a) for b, a in sorted(s.arcs.items())))
        if key not in numbers:
            numbers[key] = len(states)
            states.append(key)
        return numbers[key]

    def settle(path: list[_State], word: bytes, depth: int) -> None:
        for i in range(len(word), depth, -1):
            path[i - 1].arcs[word[i - 1]][0] = settled(path.pop())

    path, last = [_State()], b""
    for word, ids in entries:
        if not word:
            continue
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(path, last, same)
        rest = tuple(ids)
        for i in range(same):  # what this word does not share with those before moves on by a state
            arc, below = path[i].arcs[word[i]], path[i + 1]
            n = 0
            while n < min(len(arc[1]), len(rest)) and arc[1][n] == rest[n]:
                n += 1
            arc[1], late, rest = arc[1][:n], arc[1][n:], rest[n:]
            if late:
                for a in below.arcs.values():
                    a[1] = late + a[1]
                if below.final:
                    below.left = late + below.left
        for i in range(same, len(word)):
            below = _State()
            path[i].arcs[word[i]] = [below, rest if i == same else ()]
            path.append(below)
        path[-1].final, last = True, word
    settle(path, last, 0)
    root = settled(path[0])

    arcs = [(s << 8 | b, to, ids) for s, (_, _, out) in enumerate(states) for b, to, ids in out]
    pool, at = [], {(): 0}

    def placed(ids: tuple) -> int:
        if ids not in at:
            at[ids] = len(pool)
            pool.extend(ids)
        return at[ids]

    out = [(placed(ids), len(ids)) for _, _, ids in arcs]
    ends = [(placed(left), len(left)) if final else (0, -1) for final, left, _ in states]
    parts = [np.array([a[0] for a in arcs], "<i8"), np.array([a[1] for a in arcs], "<i4"), np.array(out, "<i4").reshape(-1, 2), np.array(ends, "<i4").reshape(-1, 2), np.array(pool, "<u4")]
    head = np.array([root, len(arcs), len(states), len(pool)], "<i8")
    return b"".join(p.tobytes() for p in (head, *parts))


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``pool[start : start + size]`` of all, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Lexicon:
    """The automaton in a mapped file."""

    def __init__(self, data: bytes | mmap.mmap):
        self.root, arcs, states, pool = np.frombuffer(data, "<i8", 4).tolist()
        at, cols = 32, []
        for kind, n in (("<i8", arcs), ("<i4", arcs), ("<i4", 2 * arcs), ("<i4", 2 * states), ("<u4", pool)):
            cols.append(np.frombuffer(data, kind, n, at))
            at += cols[-1].nbytes
        self.keys, self.to, self.pool = cols[0], cols[1], cols[4]
        self.out, self.ends = cols[2].reshape(-1, 2), cols[3].reshape(-1, 2)
        self.states, self.arcs = states, arcs

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has; -1 where it is not in the lexicon."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, firsts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        state = np.full(len(words), self.root, np.int64)
        # (word, start, size) of the ids that are met, in the order of bytes
        met: list[tuple[np.ndarray, np.ndarray]] = []
        alive = np.flatnonzero((sizes > 0) & (sizes <= LONGEST)) if self.arcs else np.empty(0, np.int64)
        known = np.zeros(len(words), bool)
        depth = 0
        while len(alive):
            key = state[alive] << 8 | data[firsts[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), self.arcs - 1)
            ok = self.keys[arc] == key
            alive, arc = alive[ok], arc[ok]
            state[alive] = self.to[arc]
            met.append((alive, self.out[arc]))
            depth += 1
            over = sizes[alive] == depth
            done = alive[over]
            end = self.ends[state[done]]
            known[done] = end[:, 1] >= 0
            met.append((done, end))
            alive = alive[~over]
        if not met:
            return np.empty(0, np.uint32), np.full(len(words), -1)
        word, spans = np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met])
        kept = known[word] & (spans[:, 1] > 0)
        word, spans = word[kept], spans[kept].astype(np.int64)
        order = np.argsort(word, kind="stable")
        word, spans = word[order], spans[order]
        counts = np.bincount(word, weights=spans[:, 1], minlength=len(words)).astype(np.int64)
        return gathered(self.pool, spans[:, 0], spans[:, 1]), np.where(known, counts, -1)


@lru_cache(maxsize=2)
def mapped(name: str) -> Lexicon:
    """The session's lexicon file, mapped once per worker."""
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def words_to_ids(words: Words, vocab: Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after the other, and how many each word has."""
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    raw = [w.encode() if isinstance(w, str) else b"" for w in place]
    pool, counts = lexicon.lookup(raw)
    starts = np.cumsum(np.maximum(counts, 0)) - np.maximum(counts, 0)
    unseen, added = np.flatnonzero(counts < 0), [(i, w) for w, i in place.items() if isinstance(w, int)]
    more, sizes = vocab.merge([raw[i] for i in unseen.tolist()])
    starts[unseen], counts[unseen] = len(pool) + np.cumsum(sizes) - sizes, sizes
    for k, (i, _) in enumerate(added):
        starts[i], counts[i] = len(pool) + len(more) + k, 1
    pool = np.concatenate([pool, more, np.array([w for _, w in added], np.uint32)])
    codes = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    return gathered(pool, starts[codes], counts[codes]), counts[codes]


def ids_of(texts: Iterable[str], vocab: Vocabulary, lexicon: Lexicon) -> Iterator[np.ndarray]:
    """Ids of each text in turn; short texts are looked up together, long ones part by part."""
    held: Words = []
    ends: list[int] = []  # of the texts whose words are held, in words
    parts: list[np.ndarray] = []  # of the text whose beginning is encoded

    def flush() -> Iterator[np.ndarray]:
        nonlocal held, ends, parts
        ids, counts = words_to_ids(held, vocab, lexicon)
        upto = np.concatenate([[0], np.cumsum(counts)])
        first = 0
        for e in ends:
            own = ids[upto[first] : upto[e]]
            yield np.concatenate([*parts, own]) if parts else own
            parts, first = [], e
        if first < len(held):
            parts.append(ids[upto[first] :])
        held, ends = [], []

    for text in texts:
        for some in vocab.split(text):
            held += some
            if len(held) >= BLOCK_WORDS:
                yield from flush()
        ends.append(len(held))
    if ends:
        yield from flush()


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """word (binary) and n of all words of up to ``LONGEST`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = vocabulary(path), Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w.encode(), n) for w, n in seen.items() if isinstance(w, str)]
            rows = [r for r in rows if len(r[0]) <= LONGEST]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

        for b in batches:
            for value in b.column(0):
                for some in vocab.split(value.as_py() or ""):
                    seen.update(some)
                    if len(seen) >= HELD:
                        yield flush()
        yield flush()

    return small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_entries(docs: DataFrame, path: str, size: int = LEXICON, text_col: str = "text") -> list[tuple[bytes, tuple[int, ...]]]:
    """The most frequent words, ``size`` at most, with their ids, in ascending order.

    Which they are is decided by a count that all of them reach, rounded down to four
    binary digits, so the driver sees a few hundred counters and then the words.
    """
    counts = word_counts(docs, path, text_col).where("n > 1")
    shift = F.greatest(F.lit(0), F.length(F.bin("n")) - 4)
    rounded = F.expr("shiftleft(shiftright(n, s), s)")
    counts = checkpointed(counts.withColumn("s", shift.cast("int")).withColumn("about", rounded).select("word", "about"))
    least, total = None, 0
    for about, n in sorted(((r.about, r.n) for r in counts.groupBy("about").agg(F.count("*").alias("n")).collect()), reverse=True):
        if total + n > size:
            break
        least, total = about, total + n
    if least is None:
        return []

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            pool, counts = vocab.merge(b.column(0).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(pool.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["word", "ids"])

    chosen = counts.where(F.col("about") >= least).select("word").mapInArrow(merged, "word binary, ids array<int>")
    return sorted((bytes(r.word), tuple(r.ids)) for r in chosen.collect())


def shipped(spark: SparkSession, data: bytes) -> str:
    """Put a lexicon into the shared folder and add it to the session's files; its name there."""
    name = f"lexicon-{sha256(data).hexdigest()[:32]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(data)
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def encode(docs: DataFrame, path: str | None = None, size: int = LEXICON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids (binary: little-endian unsigned 32-bit integers) of each row."""
    spark, path = docs.sparkSession, path or default_vocabulary()
    name = shipped(spark, compiled(lexicon_entries(docs, path, size, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lexicon = vocabulary(path), mapped(name)
        for b in batches:
            texts = (v.as_py() or "" for v in b.column(1))
            ids = pa.array([i.astype("<u4").tobytes() for i in ids_of(texts, vocab, lexicon)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    slim = small_batches(docs).select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "text_"))
    return slim.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids binary")


def byte_table(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids, one after the other, and where each begins and how long it is."""
    held = [vocab.bytes_of.get(i, b"") for i in range(max(vocab.bytes_of, default=-1) + 2)]
    sizes = np.array([len(x) for x in held], np.int64)
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum(sizes) - sizes, sizes


def decoder(path: str) -> Callable[[bytes], str]:
    """Function from ids as bytes to the text; the last row of the table stands for unknown ids."""
    pool, starts, sizes = byte_table(vocabulary(path))

    def decoded(ids: bytes) -> str:
        i = np.minimum(np.frombuffer(ids, "<u4"), len(sizes) - 1).astype(np.int64)
        return gathered(pool, starts[i], sizes[i]).tobytes().decode("utf-8", "replace")

    return decoded


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ids and text of each row of ids."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = decoder(path)
        for b in batches:
            texts = [text_of(v.as_py() or b"") for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[id_col, ids_col, "text"])

    return small_batches(encoded).select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, `{ids_col}` binary, text string")
