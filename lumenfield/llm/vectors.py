"""Vectors of a table as NumPy matrices: which rows take part, and how their entries are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors that are there and hold neither null nor a value that is not finite."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def doubles(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"].cast("array<double>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``dims`` columns; shorter vectors count as padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out
