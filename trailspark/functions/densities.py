"""Probability densities as column expressions.

``s`` of the folded normal is a variance. Location-scale families take their
parameters in the order shapes..., loc, scale: the standard density at
(x - loc) / scale, divided by scale, zero off the support.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded_normal(x: Column, m: Column, s: Column) -> Column:
    """|N(m, s)| at x >= 0."""
    v = F.abs(s)
    return (F.exp(-F.pow(x - m, 2) / (2 * v)) + F.exp(-F.pow(x + m, 2) / (2 * v))) / F.sqrt(2 * math.pi * v)


def folded_normal_mixture(x: Column, p: Column, m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    return p * folded_normal(x, m1, s1) + (1 - p) * folded_normal(x, m2, s2)


def _levy(y: Column) -> Column:
    return F.when(y > 0, F.exp(-1 / (2 * y)) / F.sqrt(2 * math.pi * F.pow(y, 3))).otherwise(0.0)


def standard(name: str, shapes: list[float], y: Column) -> Column:
    """Standard density of a candidate family; gamma constants are taken on the driver."""
    positive = lambda v: F.when(y > 0, v).otherwise(0.0)
    if name == "levy":
        return _levy(y)
    if name == "levy_l":
        return _levy(-y)
    if name == "foldnorm":
        (c,) = shapes
        return F.when(y >= 0, (F.exp(-F.pow(y - c, 2) / 2) + F.exp(-F.pow(y + c, 2) / 2)) / math.sqrt(2 * math.pi)).otherwise(0.0)
    if name == "halfgennorm":
        (b,) = shapes
        return F.when(y >= 0, b / math.gamma(1 / b) * F.exp(-F.pow(F.abs(y), F.lit(b)))).otherwise(0.0)
    if name == "gamma":
        (a,) = shapes
        return positive(F.exp((a - 1) * F.log(y) - y - math.lgamma(a)))
    if name == "gengamma":
        a, c = shapes
        return positive(abs(c) * F.exp((c * a - 1) * F.log(y) - F.pow(y, F.lit(c)) - math.lgamma(a)))
    if name == "invgamma":
        (a,) = shapes
        return positive(F.exp((-a - 1) * F.log(y) - 1 / y - math.lgamma(a)))
    raise ValueError(f"unknown family {name}")


def density(name: str, params: list[float], x: Column) -> Column:
    """NULL where ``x`` is."""
    *shapes, loc, scale = params
    return F.when(x.isNotNull(), standard(name, shapes, (x - loc) / scale) / scale)
