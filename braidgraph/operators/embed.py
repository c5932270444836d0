"""Corpus embedding: a deterministic hashing embedder and order-preserving rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.text import index_text
from braidgraph.operators.vectors import upsert_vectors

DIM = 384
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = DIM) -> Encoder:
    """Signed feature hashing of words, of unit length; needs no model."""
    import re

    word = re.compile(r"\w+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in word.findall(t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return encode


def embedding(make: Callable[[], Encoder], prefix: str = "", batch: int = 128):
    """Column function from text to vector; the encoder is made once per worker iterator."""

    @F.pandas_udf("array<float>")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in parts:
            texts = [prefix + (t or "") for t in s]
            rows = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield pd.Series(rows)

    return udf


def sample_positions(pos: Column, total: int, n: int) -> Column:
    """Whether a position (from 0) is among ``n`` evenly spaced ones, the ends included."""
    if n >= total:
        return F.lit(True)
    if n <= 1:
        return pos == 0
    chosen = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * F.lit((total - 1) / (n - 1))).cast("long"))
    return F.array_contains(chosen, pos.cast("long"))


def embed_corpus(rows: DataFrame, make: Callable[[], Encoder] = hashing_encoder, prefix: str = "", sample_n: int | None = None) -> DataFrame:
    """``rows`` (pos, text, ...) with ``vector``, in the order that ``pos`` keeps."""
    if sample_n is not None:
        rows = rows.where(sample_positions(F.col("pos"), rows.count(), sample_n))
    return rows.withColumn("vector", embedding(make, prefix)("text"))


def build_index(nodes: DataFrame, kinds: list[str], current: DataFrame | None = None, make: Callable[[], Encoder] = hashing_encoder, sync: bool = False) -> DataFrame:
    """Vector rows of the nodes of some kinds, put over ``current``; with ``sync`` vectors
    of nodes that are gone leave."""
    rows = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    text = index_text(F.col("kind"), F.col("name"), F.col("qualname"), F.col("module_path"), F.col("lineno"), F.col("docstring"))
    filled = lambda c: F.coalesce(c, F.lit("")).alias(c)
    new = rows.select("id", "kind", "name", filled("qualname"), filled("module_path"), text.alias("text"))
    new = new.withColumn("vector", embedding(make)("text"))
    if current is None:
        return new
    out = upsert_vectors(current, new)
    return out.join(nodes.select("id"), "id", "left_semi") if sync else out
