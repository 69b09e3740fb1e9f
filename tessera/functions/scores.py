"""Score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def minmax(score: Column, by: list[str], equal: float = 1.0) -> Column:
    """(x - min) / (max - min) within each group; ``equal`` where all are the same."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, equal).otherwise((score - low) / (high - low))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def blend(a: Column, b: Column, alpha: float) -> Column:
    return alpha * a + (1 - alpha) * b


def similarity_from_distance(distance: Column, by: list[str]) -> Column:
    return F.max(distance).over(Window.partitionBy(*by)) - distance


def f_beta(p: Column, r: Column, beta: float = 2.0) -> Column:
    bottom = beta * beta * p + r
    return F.when(bottom == 0, 0.0).otherwise((1 + beta * beta) * p * r / bottom)
