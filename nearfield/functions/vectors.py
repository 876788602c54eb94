"""Vector arithmetic: Column expressions for pairs, NumPy views of Arrow batches for blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclid")


def _finite(x: Column) -> Column:
    """A missing, NaN or infinite element counts as 0, here and in ``matrix``."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: _finite(x) * _finite(y))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length; unequal sizes raise."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) == F.size(b), value).when(
        F.size(a) != F.size(b), F.raise_error(F.lit("vectors must have the same length")).cast("double")
    )


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix; every row must hold ``dim`` values.

    Elements that are missing or not finite count as 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column)
    if len(column) and pc.min_max(lengths).as_py() != {"min": dim, "max": dim}:
        raise ValueError(f"expected vectors of {dim} values, found lengths {pc.unique(lengths).to_pylist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.nan_to_num(np.asarray(flat, dtype=np.float64), posinf=0.0, neginf=0.0).reshape(len(column), dim)


def arrow_vectors(rows: np.ndarray) -> pa.Array:
    """A float64 matrix as an Arrow ``list<double>`` column."""
    n, dim = rows.shape
    offsets = np.arange(0, (n + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def row_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of matching rows (``b`` may be one row).

    Sums run along each row alone, so equal rows give equal results wherever
    they stand in a block; a matrix product does not promise that.
    """
    norms = np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1))
    dots = (a * b).sum(axis=-1)
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
