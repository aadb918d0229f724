"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null or non-finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros to the longest (or to ``width``)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if not len(sizes):
        return np.zeros((0, width or 0))
    most = max(int(sizes.max()), width or 0)
    if (sizes == most).all():
        return flat.reshape(len(sizes), most)
    out = np.zeros((len(sizes), most))
    out[np.arange(most) < sizes[:, None]] = flat
    return out


def norms(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, safe from overflow and underflow of squares."""
    scale = np.abs(rows).max(1)
    return scale * np.sqrt(((rows / scale[:, None]) ** 2).sum(1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, summed in one fixed order."""
    return ((a / norms(a)[:, None]) * (b / norms(b)[:, None])).sum(1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / norms(rows)[:, None]
