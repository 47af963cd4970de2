"""Columns with their derivative in one direction: what operators compute with where a plan's exact derivative is asked for.

The functions here take columns and duals alike. What knows columns only refuses a dual with a TypeError, and the caller goes by differences.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(*parts: Column | None) -> Column | None:
    some = [x for x in parts if x is not None]
    out = some[0] if some else None
    for x in some[1:]:
        out = out + x
    return out


def _times(x: Column | None, y) -> Column | None:
    return None if x is None else x * y


@dataclass(frozen=True, eq=False)
class Dual:
    """slope: None where nothing moves, so that constants cost no expression. Of an operation on a column and a dual, the dual stands first."""

    value: Column
    slope: Column | None = None

    def __add__(self, other):
        return Dual(self.value + value(other), _sum(self.slope, moves(other)))

    def __neg__(self):
        return Dual(-self.value, _times(self.slope, -1.0))

    def __sub__(self, other):
        return Dual(self.value - value(other), _sum(self.slope, _times(moves(other), -1.0)))

    def __rsub__(self, other):
        return Dual(value(other) - self.value, _times(self.slope, -1.0))

    def __mul__(self, other):
        return Dual(self.value * value(other), _sum(_times(self.slope, value(other)), _times(moves(other), self.value)))

    def __truediv__(self, other):
        ratio = self.value / value(other)
        back = _times(moves(other), -1.0)
        return Dual(ratio, _sum(*(x if x is None else x / value(other) for x in (self.slope, _times(back, ratio)))))

    def __rtruediv__(self, other):
        return Dual(value(other)) / self

    def __pow__(self, n):
        return power(self, n)

    __radd__, __rmul__ = __add__, __mul__


@dataclass(frozen=True)
class Point:
    """A row of unknowns, of which the one at place `direction` moves."""

    value: Column
    direction: Column

    def get(self, i: Column) -> Dual:
        return Dual(F.get(self.value, i), F.when(i == self.direction, 1.0).otherwise(0.0))

    def part(self, start: int, size: int) -> Dual:
        places = F.array(*(F.lit(start + i) for i in range(size)))
        return Dual(F.slice(self.value, start + 1, size), F.transform(places, lambda j: F.when(j == self.direction, 1.0).otherwise(0.0)))


def moves(x) -> Column | None:
    return x.slope if isinstance(x, Dual) else None


def slope(x) -> Column:
    out = moves(x)
    return F.lit(0.0) if out is None else out


def value(x) -> Column:
    return x.value if isinstance(x, Dual) else x if isinstance(x, Column) else F.lit(x)


def lift(x):
    """A column as a dual that doesn't move."""
    return x if isinstance(x, Dual) else Dual(x)


def _chain(f: Callable[[Column], Column], df: Callable[[Column, Column], Column]):
    def of(x):
        if not isinstance(x, Dual):
            return f(x)
        y = f(x.value)
        return Dual(y, None if x.slope is None else df(x.value, y) * x.slope)

    return of


exp = _chain(F.exp, lambda x, y: y)
log = _chain(F.log, lambda x, y: 1 / x)
sqrt = _chain(F.sqrt, lambda x, y: 0.5 / y)
sin = _chain(F.sin, lambda x, y: F.cos(x))
cos = _chain(F.cos, lambda x, y: -F.sin(x))
tanh = _chain(F.tanh, lambda x, y: 1 - y * y)


def power(x, n):
    """x to the n. Where the exponent moves the base is above zero, or zero: then the power doesn't move with it."""
    out = F.pow(value(x), value(n))
    if not isinstance(x, Dual) and not isinstance(n, Dual):
        return out
    base, exponent = moves(x), moves(n)
    if base is not None:
        base = F.when(value(n) == 0, 0.0).otherwise(value(n) * F.pow(value(x), value(n) - 1)) * base
    if exponent is not None:
        exponent = F.when(value(x) > 0, out * F.log(value(x))).otherwise(0.0) * exponent
    return Dual(out, _sum(base, exponent))


def either(condition: Column, x, y):
    """x where the condition holds, y elsewhere."""
    out = F.when(condition, value(x)).otherwise(value(y))
    if not isinstance(x, Dual) and not isinstance(y, Dual):
        return out
    return Dual(out, None if moves(x) is None and moves(y) is None else F.when(condition, slope(x)).otherwise(slope(y)))


def coalesce(x, y):
    return either(value(x).isNotNull(), x, y)


def clip(x, low: float, high: float):
    """Within limits; NaN stays."""
    if isinstance(x, Dual):
        return Dual(clip(x.value, low, high), None if x.slope is None else F.when((x.value > low) & (x.value < high), x.slope).otherwise(0.0))
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def linear(f: Callable[[Column], Column], x):
    """f of a column that f is linear in, such as an array of coefficients."""
    return Dual(f(x.value), None if x.slope is None else f(x.slope)) if isinstance(x, Dual) else f(x)
