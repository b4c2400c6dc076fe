"""Vector, polynomial and sequence functions on ``ARRAY<DOUBLE>`` columns, all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coordinates nearer than this are the same.
EPS = 1e-13


def same_size(a: Column, b: Column, then: Column) -> Column:
    """``then``, or an error where the dimensions differ."""
    return F.when(F.size(a) == F.size(b), then).otherwise(F.raise_error(F.lit("vectors of different dimensions")))


def add(a: Column, b: Column) -> Column:
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return same_size(a, b, F.zip_with(a, b, lambda x, y: x - y))


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def scale(a: Column, k: Column | float) -> Column:
    factor = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(a, lambda x: x * factor)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return same_size(a, b, total(F.zip_with(a, b, lambda x, y: x * y)))


def length_sq(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def length(a: Column) -> Column:
    return F.sqrt(length_sq(a))


def distance_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; comparisons need no root."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_sq(a, b))


def unit(a: Column) -> Column:
    """NULL elements for the zero vector."""
    n = length(a)
    return F.transform(a, lambda x: F.try_divide(x, n))


def cross(a: Column, b: Column) -> Column:
    """Of three-dimensional vectors."""
    g = lambda v, i: F.get(v, F.lit(i))
    return F.array(*(g(a, i) * g(b, j) - g(a, j) * g(b, i) for i, j in ((1, 2), (2, 0), (0, 1))))


def angle(a: Column, b: Column) -> Column:
    """Angle between vectors; the cosine is clamped to [-1, 1]."""
    cosine = F.try_divide(dot(a, b), length(a) * length(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def zero(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * n)


def basis(n: int) -> list[Column]:
    return [F.array(*[F.lit(float(i == k)) for i in range(n)]) for k in range(n)]


def is_nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def less(a: Column, b: Column) -> Column:
    """By length, as vectors are ordered."""
    return length_sq(a) < length_sq(b)


def less_equal(a: Column, b: Column) -> Column:
    return length_sq(a) <= length_sq(b)


def component(a: Column, i: int) -> Column:
    """NULL where there is no such component."""
    return F.get(a, F.lit(i))


def nearly_equal(a: Column, b: Column, eps: float = EPS) -> Column:
    """All pairs nearer than ``eps``; the longer sequence is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.forall(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x - y) < eps), lambda ok: ok)


def close(a: Column, b: Column, atol: float, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def linspace(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + i * (hi - lo) / (n - 1))


def polynomial(coef: Column, t: Column) -> Column:
    """Value by Horner's rule; coefficients from the constant on."""
    return F.aggregate(F.reverse(coef), F.lit(0.0), lambda s, c: s * t + c)


def derivative(coef: Column) -> Column:
    return F.slice(F.transform(coef, lambda c, i: c * i), F.lit(2), F.greatest(F.size(coef) - 1, F.lit(0)))


def pretty(coef: Column) -> Column:
    """``c x^n + ...`` from the highest power down."""
    n = F.size(coef) - 1
    return F.array_join(F.transform(F.reverse(coef), lambda c, i: F.concat(c.cast("string"), F.lit(" x^"), (n - i).cast("string"))), " + ")
