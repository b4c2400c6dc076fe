"""Hulls, smallest boxes and made-up point clouds, and a hashed order of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull in the plane, counter-clockwise, by monotone chains."""
    p = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(p) < 3:
        return np.array(p)

    def chain(seq: list) -> list:
        out: list = []
        for c in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


@dataclass(frozen=True)
class Box:
    """A rectangle: rotation of its first side, sides, centre and corners."""

    angle: float
    area: float
    width: float
    height: float
    centre: tuple[float, float]
    corners: np.ndarray


def smallest_box(points: np.ndarray) -> Box:
    """Rectangle of least area around points in the plane; one of its sides lies on a side of the hull."""
    h = hull(points)
    if len(h) == 1:
        return Box(0.0, 0.0, 0.0, 0.0, tuple(h[0]), np.repeat(h, 4, axis=0))
    sides = np.diff(np.r_[h, h[:1]], axis=0)
    best = None
    for a in sorted({round(float(np.arctan2(dy, dx) % (np.pi / 2)), 15) for dx, dy in sides}):
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        q = h @ turn.T
        lo, hi = q.min(0), q.max(0)
        area = float(np.prod(hi - lo))
        if best is None or area < best.area - 1e-12:
            corners = np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]]) @ turn
            best = Box(a, area, float(hi[0] - lo[0]), float(hi[1] - lo[1]), tuple(((lo + hi) / 2) @ turn), corners)
    return best


def rotation_onto(v: np.ndarray) -> np.ndarray:
    """Rotation that turns a vector of three onto the first axis."""
    a = v / np.linalg.norm(v)
    e = np.array([1.0, 0.0, 0.0])
    axis, c = np.cross(a, e), float(a @ e)
    if np.linalg.norm(axis) < 1e-15:
        return np.eye(3) if c > 0 else np.diag([-1.0, -1.0, 1.0])
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def diameter(points: np.ndarray) -> np.ndarray:
    """Difference of the farthest pair; the first of equals."""
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    i, j = np.unravel_index(int(d.argmax()), d.shape)
    return points[j] - points[i]


def alignment(points: np.ndarray) -> np.ndarray:
    """Rotation of a cloud: its diameter onto the first axis, then the smallest box of the rest onto the others."""
    p = np.asarray(points, float)
    v = diameter(p)
    first = rotation_onto(v) if np.linalg.norm(v) else np.eye(3)
    a = smallest_box((p @ first.T)[:, 1:]).angle
    return np.array([[1, 0, 0], [0, np.cos(a), np.sin(a)], [0, -np.sin(a), np.cos(a)]]) @ first


def sinusoid(spark: SparkSession, n: int, seed: int = 0, degree: int = 3, radius: float = 4.0) -> DataFrame:
    """``id, x, y, z``: points around a random polynomial over the first axis, each from a hash of (seed, id)."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 30)) / float(1 << 30)
    c = np.random.default_rng(seed).normal(0, 1, (2, degree + 1))
    x = u(0) * 2 - 1
    wave = lambda row: sum((F.lit(float(v)) * F.pow(x, F.lit(k)) for k, v in enumerate(row)), F.lit(0.0))
    angle = 2 * np.pi * u(1)
    r = radius * F.sqrt(u(2))
    return spark.range(n).select("id", (50 * x).alias("x"), (10 * wave(c[0]) + r * F.cos(angle)).alias("y"), (10 * wave(c[1]) + r * F.sin(angle)).alias("z"))


def uniform(low: float, high: float, *keys) -> Column:
    """A number in [low, high) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30) * (high - low) + low


def random_polynomials(spark: SparkSession, n: int, seed: int = 0, least: int = 1, most: int = 5, low: float = -20.0, high: float = 20.0) -> DataFrame:
    """``id, coef``: from ``least`` to ``most`` coefficients by rising power, each in [low, high), from a hash of (seed, id, power)."""
    size = F.floor(uniform(least, most + 1, F.lit(seed), F.lit(-1), F.col("id"))).cast("int")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), size - 1), lambda k: uniform(low, high, F.lit(seed), k, F.col("id"))).alias("coef"))


def random_normal(v: Column, length: float, *keys) -> Column:
    """A vector of this length at right angles to ``v`` (an array of two or more), in a direction from a hash of the keys; zeros for zeros."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    u = F.transform(v, lambda x, i: uniform(-1.0, 1.0, *keys, i))
    w = F.zip_with(u, v, lambda x, y: x - y * dot(u, v) / dot(v, v))
    return F.when(dot(v, v) == 0, v).otherwise(F.transform(w, lambda x: x * length / F.sqrt(dot(w, w))))


def shuffled(df: DataFrame, *key: str, seed: int = 0) -> DataFrame:
    """Rows in an order that a hash of (seed, key) gives."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)
