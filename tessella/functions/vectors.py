"""Products and similarities of vectors: as columns, and over Arrow batches with NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, newton_steps: int | None = None) -> Column:
    """Cosine similarity; 0 for empty, mismatched or zero vectors. ``newton_steps`` approximates both roots by that many Newton steps from the value itself."""
    root = F.sqrt if newton_steps is None else lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(newton_steps)), x, lambda z, _: (z + x / z) / 2)
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    na, nb = dot(a, a), dot(b, b)
    return F.when(same & (na > 0) & (nb > 0), dot(a, b) / (root(na) * root(nb))).otherwise(F.lit(0.0))


def maxsim(query: list[list[float]], rows: Column) -> Column:
    """Late interaction: for each query row its best product with a row of the tensor, summed."""
    q = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in query])
    return F.aggregate(F.transform(q, lambda qt: F.array_max(F.transform(rows, lambda dt: dot(qt, dt)))), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have ``dim`` finite elements: their numbers and a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    ok = (sizes == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.flatnonzero(ok)
    x = flat[(offsets[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
    finite = np.isfinite(x).all(axis=1)
    return at[finite], x[finite]


def cosines(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines of all rows with all queries; 0 where either is zero."""
    scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    # einsum adds each pair up in the same order whatever else is in the batch, so equal vectors tie exactly.
    return np.divide(np.einsum("nd,qd->nq", x, queries), scale, out=np.zeros_like(scale), where=scale > 0)
