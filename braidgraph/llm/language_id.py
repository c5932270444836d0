"""Language identification with a byte convolutional network.

Texts are read as UTF-8 bytes in windows of fixed length. Bytes are embedded;
filters of several widths slide over them; each filter's largest response in the
window passes a rectifier; a dense layer and a softmax give class probabilities. A
document's probabilities are the mean of its windows', weighted by their bytes.

Training runs in numpy on the driver, on windows spread evenly over a bounded
sample of labelled documents (``max_docs`` documents, ``per_doc`` windows of each,
equal shares of all languages, about ``LEAST_DOCS`` of each at least). The network that
results is small and, but for a row of weights for each language, fixed in size. For prediction, embedding and filters are
multiplied out into one table of responses for each pair of bytes, so a window needs
two look-ups a position. Every byte of every text is read.

Defined edge cases: null texts, texts without a letter, and all texts where nothing
was learned are ``und`` with score 0; rows without id are never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidgraph.llm.common import small_batches

UNKNOWN = "und"
#: A kept document's least score: its best language outweighs all others together.
LEAST = 0.5
WINDOW = 256
WIDTHS = (2, 3, 4)
MAX_DOCS, PER_DOC = 3072, 3
#: Documents drawn of a language at least, on average, however many languages there are.
LEAST_DOCS = 8
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


@dataclass
class Network:
    """Weights; ``filters[w]`` has shape (w * depth, count)."""

    labels: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all filters to the byte pair at a place, and to the pair two bytes on."""
        depth, near, far = self.embed.shape[1], [], []
        for w, f in self.filters.items():
            parts = [self.embed @ f[j * depth : (j + 1) * depth] for j in range(w)]
            parts += [np.zeros_like(parts[0])] * (4 - w)
            near.append((parts[0][:, None] + parts[1][None]).reshape(65536, -1))
            far.append((parts[2][:, None] + parts[3][None]).reshape(65536, -1))
        return np.concatenate(near, 1).astype(np.float32) + self.bias.astype(np.float32), np.concatenate(far, 1).astype(np.float32)

    def classify(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def padded(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, each padded with zeros to whole windows and at least three spare
    bytes; windows of each text; bytes of text in each window."""
    parts, counts, sizes = [], [], []
    for t in texts:
        n = max(1, -(-(len(t) + 3) // window))
        parts += [t, bytes(n * window - len(t))]
        counts.append(n)
        sizes += [max(0, min(window, len(t) - k * window)) for k in range(n)]
    parts.append(bytes(4))
    return np.frombuffer(b"".join(parts), np.uint8), np.array(counts, np.int64), np.array(sizes, np.float64)


def pool(data: np.ndarray, near: np.ndarray, far: np.ndarray, window: int = WINDOW, block: int = 16) -> np.ndarray:
    """Largest response of each filter in each window."""
    total = (len(data) - 4) // window
    pairs = data[:-1].astype(np.int32) * 256 + data[1:]
    out = np.empty((total, near.shape[1]), np.float32)
    a, b = np.empty((block * window, near.shape[1]), np.float32), np.empty((block * window, near.shape[1]), np.float32)
    for at in range(0, total, block):
        n = min(block, total - at) * window
        s = at * window
        np.take(near, pairs[s : s + n], axis=0, out=a[:n], mode="clip")
        np.take(far, pairs[s + 2 : s + 2 + n], axis=0, out=b[:n], mode="clip")
        np.add(a[:n], b[:n], out=a[:n])
        np.max(a[:n].reshape(-1, window, near.shape[1]), axis=1, out=out[at : at + n // window])
    return out


def train(samples: list[tuple[bytes, str]], window: int = WINDOW, widths: tuple[int, ...] = WIDTHS, count: int = 8, depth: int = 8, epochs: int = 6, least_steps: int = 480, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Fit a network to labelled windows with Adam; short cuts of them are learned too. Few windows are
    gone over more often than ``epochs`` times, until ``least_steps`` steps are taken."""
    rng = np.random.default_rng(seed)
    labels = sorted({y for _, y in samples})
    ys = np.array([labels.index(y) for _, y in samples])
    xs = np.zeros((len(samples), window + 3), np.uint8)
    sizes = np.array([min(len(x), window) for x, _ in samples])
    for i, (x, _) in enumerate(samples):
        xs[i, : sizes[i]] = np.frombuffer(x[:window], np.uint8)
    p: dict = {"embed": rng.normal(0, 0.3, (256, depth))}
    for w in widths:
        p[w] = rng.normal(0, (w * depth) ** -0.5, (w * depth, count))
    total = count * len(widths)
    p |= {"bias": np.zeros(total), "dense": rng.normal(0, total**-0.5, (total, len(labels))), "dense_bias": np.zeros(len(labels))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(max(epochs, -(-least_steps // max(1, len(samples) // batch)))):
        for rows in np.array_split(rng.permutation(len(samples)), max(1, len(samples) // batch)):
            if not len(rows):
                continue
            x = xs[rows].copy()
            cut = rng.random(len(rows)) < 0.25
            keep = np.where(cut, rng.integers(8, window, len(rows)), window)
            x[np.arange(window + 3)[None] >= keep[:, None]] = 0
            e = p["embed"][x]
            n = len(rows)
            pooled, where, grams = [], [], {}
            for w in widths:
                g = np.concatenate([e[:, j : j + window] for j in range(w)], 2)
                r = g.reshape(n * window, -1) @ p[w]
                r = r.reshape(n, window, count)
                at = r.argmax(1)
                pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
                where.append(at)
                grams[w] = g
            raw = np.concatenate(pooled, 1) + p["bias"]
            h = np.maximum(raw, 0)
            z = h @ p["dense"] + p["dense_bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = z / z.sum(1, keepdims=True)
            dz[np.arange(n), ys[rows]] -= 1
            dz /= n
            grad = {"dense": h.T @ dz, "dense_bias": dz.sum(0)}
            dh = (dz @ p["dense"].T) * (raw > 0)
            grad["bias"], grad["embed"] = dh.sum(0), np.zeros_like(p["embed"])
            # a filter learns only from the place of its largest response
            for k, w in enumerate(widths):
                d, at = dh[:, k * count : (k + 1) * count], where[k]
                seen = grams[w][np.arange(n)[:, None], at]
                grad[w] = np.einsum("nf,nfd->df", d, seen)
                back = d[:, :, None] * p[w].T[None]
                for j in range(w):
                    np.add.at(grad["embed"], x[np.arange(n)[:, None], at + j], back[:, :, j * depth : (j + 1) * depth])
            step += 1
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                s[name] = 0.99 * s[name] + 0.01 * g * g
                p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(labels, p["embed"], {w: p[w] for w in widths}, p["bias"], p["dense"], p["dense_bias"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, may_learn: Column, max_docs: int = MAX_DOCS, per_doc: int = PER_DOC, window: int = WINDOW) -> Network | None:
    """Train on a bounded sample of the rows of ``docs`` (doc_id, text, lang) where ``may_learn`` holds."""
    rows = docs.select("doc_id", "text", "lang").where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(LEAST_DOCS, max_docs / len(counts))
    chance = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r[0], int((1 << 30) * min(1.0, each / r[1]))))), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < chance)
    span = F.greatest(F.lit(0), F.length("text") - window)
    cuts = F.array(*(F.substring(F.col("text"), F.floor(span * (k / max(1, per_doc - 1))).cast("int") + 1, F.lit(window)) for k in range(per_doc)))
    got = drawn.select("lang", F.array_distinct(cuts).alias("cuts")).limit(2 * max(max_docs, LEAST_DOCS * len(counts))).collect()
    samples = sorted((c.encode()[:window], r["lang"]) for r in got for c in r["cuts"] if has_letter(c))
    return train(samples, window) if samples else None


def score(texts: list[str | None], net: Network | None, near: np.ndarray | None, far: np.ndarray | None, step: int = 2 << 20) -> list[tuple[str, float]]:
    """(label, score) of each text; about ``step`` bytes are held at a time."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        data, counts, weights = padded([t for _, t in held])
        p = net.classify(pool(data, near, far)) * weights[:, None]
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(p, firsts, axis=0) / np.maximum(1, np.add.reduceat(weights, firsts))[:, None]
        top = mean.argmax(1)
        for (i, _), k, row in zip(held, top, mean, strict=True):
            out[i] = (net.labels[k], float(min(1.0, max(0.0, row[k]))))
        held.clear()

    for i, t in enumerate(texts):
        if t and has_letter(t):
            held.append((i, t.encode()))
            size += len(held[-1][1])
            if size >= step:
                flush()
                size = 0
    if held:
        flush()
    return out


def predict(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, then lang_pred and score; map-only."""
    tables = net.tables() if net else (None, None)
    shared = docs.sparkSession.sparkContext.broadcast((net, *tables))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, near, far = shared.value
        for b in batches:
            found = score(b.column(len(keep)).to_pylist(), held, near, far)
            cols = [*(b.column(i) for i in range(len(keep))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return small_batches(docs).select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, learned from those not held out."""
    slim = docs.select("doc_id", "text", "lang")
    net = fit(slim, ~held_out(F.col("doc_id")))
    return predict(slim.withColumn("held_out", held_out(F.col("doc_id"))), net, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without those that have no letters or whose best language scores below ``least``;
    the language found fills in where ``lang`` is null. Where nothing was learned nothing is kept."""
    net = fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    tables = net.tables() if net else (None, None)
    shared = docs.sparkSession.sparkContext.broadcast((net, *tables))
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, near, far = shared.value
        for b in batches:
            found = score(b.column(at).to_pylist(), held, near, far)
            langs = [own if own is not None else got for own, (got, _) in zip(b.column(lang_at).to_pylist(), found, strict=True)]
            cols = [pa.array(langs, b.column(i).type) if i == lang_at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array([lang != UNKNOWN and s >= least for lang, s in found], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
