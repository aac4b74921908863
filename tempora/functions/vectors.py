"""Vector expressions. Sums run in double precision, in the order of the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_TOLERANCE = 1e-5
ZERO_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def unit(v: Column) -> Column:
    """v at length one; null where it has no direction (not finite, or shorter than ZERO_NORM)."""
    size = norm(v)
    return F.when(finite(v) & (size >= ZERO_NORM), F.transform(v, lambda x: x.cast("double") / size))


def is_unit(v: Column) -> Column:
    return finite(v) & (F.abs(norm(v) - 1) < UNIT_TOLERANCE)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def fused(full: Column, crop: Column) -> Column:
    """The direction of the sum; the first alone where there is no second."""
    return F.coalesce(unit(added(full, crop)), unit(full))


def margin(v: Column, towards: Column, away: Column) -> Column:
    """How much nearer a vector is to one hypothesis than to the other."""
    return dot(v, towards) - dot(v, away)


def largest_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
