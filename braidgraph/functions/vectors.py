"""Vector columns, computed in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a column as rows, in double; zeros for those that are null, hold null or have another length."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    flat = rows.flatten()
    if len(rows) and not rows.null_count and not flat.null_count and (sizes == width).all():
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        own = v.as_py()
        if own is not None and len(own) == width and None not in own:
            out[i] = own
    return out


def ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id in ascending order."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; those without length stay."""
    size = np.sqrt((x**2).sum(1))
    return x / np.where(size > 0, size, 1.0)[:, None]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 1 where a vector has no length, is null or has another dimension."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, 1 - dot(a, b) / size), F.lit(1.0))


def to_int8(v: Column) -> Column:
    """Components times 127, rounded half to even and clamped to a byte."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(x.cast("double") * 127))).cast("tinyint"))


def subvectors(dim: int) -> int:
    """Largest divisor of ``dim`` that is at most ``dim // 16`` (1 at least)."""
    return max((d for d in range(1, max(1, dim // 16) + 1) if dim % d == 0), default=1)


def partitions(rows: int) -> int:
    """Number of coarse cells for an approximate index over ``rows``."""
    return max(1, min(round(rows**0.5), max(1, rows // 100)))
