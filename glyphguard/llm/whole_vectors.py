"""Vectors as whole numbers: floor(scale * x) of each component, and exact products of such tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are held to this size either way, so that every product and square fits in 64 bits.
LIMIT = 1 << 27


def usable(vector: Column) -> Column:
    """True where a vector is there and has no null and no non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~odd, F.lit(False))


def floors(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of int64 from a list column of usable vectors; shorter ones end in zeros."""
    sizes = np.diff(np.asarray(column.offsets, np.int64))
    values = np.floor(scale * np.asarray(column.flatten(), np.float64)).clip(-LIMIT, LIMIT).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row as little-endian 32-bit numbers."""
    return [x.tobytes() for x in rows.astype("<i4")]


def unpacked(column, width: int) -> np.ndarray:
    """The rows of an Arrow or pandas column made by ``packed``."""
    rows = column.to_pylist() if isinstance(column, pa.Array | pa.ChunkedArray) else list(column)
    return np.frombuffer(b"".join(rows), "<i4").reshape(-1, width).astype(np.int64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two tables, exactly: by float arithmetic where every partial sum
    is under 2**53, else in whole numbers."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of two tables, exactly."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * inner(a, b)
