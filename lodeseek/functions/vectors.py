"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 for vectors of different lengths or without a direction."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def clamped(similarity: Column) -> Column:
    """The score that is shown; ranking goes by the raw similarity."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))


def checked_dimension(v: Column, dimension: int) -> Column:
    wrong = F.format_string(f"expected dimension {dimension}, got %d", F.size(v))
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(wrong).cast("array<float>"))
