"""Numeric expressions with the rules of the metrics: nulls mean "not measured", division by zero is null, halves round to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, digits: int = 0) -> Column:
    """Scale, round halves to even, scale back."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held within bounds; null stays null (least and greatest would skip it)."""
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def true(condition: Column) -> Column:
    """A condition that is false where unknown."""
    return F.coalesce(condition, F.lit(False))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1.0).otherwise(0.0))


def measured(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def weighted_mean(x: Column, w: Column) -> Column:
    """Over rows where x is measured."""
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


def jaccard(a: Column, b: Column) -> Column:
    """1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
