"""Voxel surfaces as long tables ``(t, i, j, k, v)``; a voxel is inside where its value is positive.

A grid has an origin and a voxel size for each axis: ``index = round((p - min) / size)``
for membership, while voxel centres are ``index * size + min + size / 2``. The half
voxel between the two is part of both definitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
POSITION = ("x", "y", "z")


def inside_box(low: Sequence[float], high: Sequence[float], cols: Sequence[str] = POSITION) -> Column:
    """Closed box on all axes."""
    out = F.lit(True)
    for c, a, b in zip(cols, low, high, strict=True):
        out = out & F.col(c).between(a, b)
    return out


def lookup(points: DataFrame, voxels: DataFrame, low: Sequence[float], high: Sequence[float], size: Sequence[float]) -> DataFrame:
    """``points (t, x, y, z, ..)`` with ``inside``: in the box and in a positive voxel (indices round half to even)."""
    box = inside_box(low, high)
    index = {a: F.bround((F.col(c) - lo) / s).cast("int") for a, c, lo, s in zip(AXES, POSITION, low, size, strict=True)}
    d = points.withColumns({f"_{a}": e for a, e in index.items()})
    v = voxels.where("v > 0").select(F.col("t").alias("_t"), *(F.col(a).alias(f"_{a}v") for a in AXES)).withColumn("_hit", F.lit(True))
    on = (d["t"] == v["_t"]) & (d["_i"] == v["_iv"]) & (d["_j"] == v["_jv"]) & (d["_k"] == v["_kv"])
    return d.join(v, on, "left").withColumn("inside", box & F.coalesce("_hit", F.lit(False))).select(*points.columns, "inside")


def interior_points(voxels: DataFrame, low: Sequence[float], size: Sequence[float]) -> DataFrame:
    """``t, x, y, z``: centres of positive voxels."""
    at = (((F.col(a) * s) + lo + s / 2).cast("double").alias(c) for a, c, lo, s in zip(AXES, POSITION, low, size, strict=True))
    return voxels.where("v > 0").select("t", *at)


def vertical_line_test(voxels: DataFrame, domain: str = "i", codomain: str = "j") -> DataFrame:
    """``t, is_function``: along the codomain no slice of the domain changes between outside and inside three times or more.

    Cells missing between present ones count as outside; before and after the grid is outside.
    """
    column = voxels.groupBy("t", F.col(domain).alias("dom"), F.col(codomain).alias("cod")).agg(F.bool_or(F.col("v") > 0).alias("solid"))
    w = Window.partitionBy("t", "dom").orderBy("cod")
    runs = column.where("solid").withColumn("new", F.when(F.lag("cod").over(w) == F.col("cod") - 1, 0).otherwise(1))
    # each run of solid cells is two changes; the last may touch the grid's edge, where none follows
    edge = column.groupBy("t").agg(F.min("cod").alias("first"), F.max("cod").alias("last"))
    per = runs.groupBy("t", "dom").agg(F.sum("new").alias("runs"), F.min("cod").alias("lo"), F.max("cod").alias("hi")).join(edge, "t")
    changes = 2 * F.col("runs") - F.when(F.col("lo") == F.col("first"), 1).otherwise(0) - F.when(F.col("hi") == F.col("last"), 1).otherwise(0)
    most = per.groupBy("t").agg(F.max(changes).alias("changes"))
    return voxels.select("t").distinct().join(most, "t", "left").select("t", (F.coalesce("changes", F.lit(0)) < 3).alias("is_function"))


def boxes(voxels: DataFrame) -> DataFrame:
    """Index extent at each time."""
    return voxels.groupBy("t").agg(*(f(a).alias(f"{a}_{n}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))))
