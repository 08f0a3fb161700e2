"""Unit vectors and cosine similarity, on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of an array column with a fixed vector; null for a zero or null vector."""
    length = math.sqrt(sum(x * x for x in query)) or 1.0
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    v = vector.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, unit, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, dot / norm)


def normalised(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))
