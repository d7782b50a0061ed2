"""Scalar functions on pixels, codewords and metrics, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def rounded(v: Column) -> Column:
    """Half away from zero, for values that are not negative."""
    return F.floor(v.cast("double") + 0.5).cast("int")


def squared_distance(a: Column, b: Column, length: int) -> Column:
    """Squared L2 distance of two arrays, summed from the first element to the last, without higher-order functions."""
    terms = [(a[i] - b[i]) * (a[i] - b[i]) for i in range(length)]
    return reduce(lambda x, y: x + y, terms)


def psnr(mse: Column, peak: int = 255) -> Column:
    return F.when(mse == 0, F.lit(100.0)).otherwise(10.0 * F.log10(F.lit(float(peak * peak)) / mse))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
