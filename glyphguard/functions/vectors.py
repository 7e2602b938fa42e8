"""Array-column vector arithmetic, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def unit_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of the two unit vectors."""
    squares = F.zip_with(l2_normalize(a), l2_normalize(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def is_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def contrastive_loss(distance: Column, label: Column, margin: float = 1.0) -> Column:
    apart = F.greatest(F.lit(margin) - distance, F.lit(0.0))
    return label * distance * distance + (1 - label) * apart * apart
