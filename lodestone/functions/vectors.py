"""Vector expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector divided by its length; null for a zero vector."""
    length = F.sqrt(dot(a, a))
    return F.when(length > 0, F.transform(a.cast("array<double>"), lambda x: x / length))


def softmax(scores: Column) -> Column:
    """Probabilities from log scores, shifted by the largest."""
    return F.transform(
        F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)) / F.aggregate(s, F.lit(0.0), lambda t, y: t + F.exp(y - F.array_max(s))))
    )[0]
