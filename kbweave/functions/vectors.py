"""Vector arithmetic on ``ARRAY<FLOAT|DOUBLE>`` columns, all in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Dot product; NULL when either side is NULL, extra tail ignored."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    """L2 norm, computed once per vector and kept as a column."""
    return F.sqrt(dot(a, a))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """dot / (|a||b|); NULL (never NaN) when a vector has zero length."""
    na = _c(norm_a) if norm_a is not None else norm(a)
    nb = _c(norm_b) if norm_b is not None else norm(b)
    return dot(a, b) / F.nullif(na * nb, F.lit(0.0))


def dim_ok(a, dim: int) -> Column:
    """Dimension constraint of the stored vector column."""
    return F.coalesce(F.size(_c(a)) == F.lit(dim), F.lit(False))

