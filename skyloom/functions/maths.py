"""Small numeric columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), 1 at 0."""
    return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * F.when(x != 0, x)))


def safe_divide(a: Column, b: Column) -> Column:
    """As IEEE 754 divides: infinities and NaN where b is zero, never an error."""
    odd = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, odd).otherwise(a / F.when(b != 0, b))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
