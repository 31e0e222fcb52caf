"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one is null, of another length or zero."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm)
