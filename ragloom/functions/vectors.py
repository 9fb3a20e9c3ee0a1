"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are rounded so that equal vectors tie exactly, whatever order the
# sums were taken in; ties then fall to the id.
DISTANCE_PLACES = 9


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (s, v) -> s + v)"


def cosine_distance(a: str, b: str) -> Column:
    """``1 - a.b / (|a||b|)`` of two array columns; null where either has zero length."""
    return F.expr(
        f"round(1D - try_divide({_dot(a, b)}, sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})), {DISTANCE_PLACES})"
    )


def is_width(v: Column, dim: int) -> Column:
    """True for a vector that can be stored: right width, no holes."""
    # looking for a value gives null where a hole may hide it, and costs far less than a test of every number
    found = F.array_contains(v, F.lit("NaN").cast("float"))
    whole = F.when(found.isNull(), False).when(~found, True).otherwise(~F.exists(v, lambda x: x.isNull()))
    return F.coalesce((F.size(v) == dim) & whole, F.lit(False))
