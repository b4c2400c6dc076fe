"""Greedy cover of the points of many keys, by rounds of joins.

The sequential rule takes the point with most uncovered points nearer than d (of
equals the smallest), replaces what it covers by its centre of mass, and goes on
until all are covered. Whether a point is next depends only on points that could
cover one of the same uncovered points. So in a round every uncovered point names
the first of those that could cover it, and a point that all it would cover name
is taken: it comes before whatever could change its neighbourhood. All such points
are taken together, and what they cover leaves; the result is that of the
sequential rule.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import AXES, LOCAL, same
from .graph import _cut, by_group, columns, keyed, simplify
from .joins import radius_pairs


def by_rounds(points: DataFrame, d: float, key: str) -> DataFrame:
    """``key, x, y, z`` of distinct points ``(key, id, x, y, z)``, ids in order of the points."""
    left, found = _cut(radius_pairs(points, d, [key], AXES, "id").withColumnsRenamed({"id1": "p", "id2": "m"})), []
    at = points.select(key, F.col("id").alias("m"), *AXES)
    while not left.isEmpty():
        size = left.groupBy(key, "p").agg(F.count("*").alias("size"))
        ranked = left.alias("l").join(size.alias("r"), same([key], ("p", "p"))).select(f"l.{key}", "l.p", "l.m", "r.size")
        first = ranked.groupBy(key, "m").agg(F.max(F.struct("size", (-F.col("p")).alias("p"))).alias("w")).select(key, "m", (-F.col("w.p")).alias("p"), F.col("w.size").alias("size"))
        first = _cut(first)
        taken = first.groupBy(key, "p", "size").agg(F.count("*").alias("named")).where("named = size")
        members = _cut(first.alias("l").join(taken.alias("r"), same([key], ("p", "p")), "left_semi").select(key, "p", "m"))
        found.append(_cut(members.alias("l").join(at.alias("r"), same([key], ("m", "m"))).groupBy(f"l.{key}", "l.p").agg(*[F.avg(f"r.{c}").alias(c) for c in AXES]).select(key, *AXES)))
        left = _cut(left.alias("l").join(members.alias("r"), same([key], ("m", "m")), "left_anti"))
    return reduce(DataFrame.unionByName, found) if found else points.select(key, *AXES).limit(0)


def covers(points: DataFrame, d: float = 6.0, key: str = "track_id", local: int = LOCAL) -> DataFrame:
    """``key, x, y, z``: the cover of each key's points.

    Points without a key or a coordinate are left out. Keys of at most ``local`` points
    are covered by one task each, larger ones by rounds.
    """
    p = points.where(" and ".join(f"{c} is not null" for c in (key, *AXES))).select(key, *[F.col(c).cast("double").alias(c) for c in AXES]).distinct()
    p = _cut(p.orderBy(key, *AXES)).withColumn("id", F.monotonically_increasing_id())
    size = p.groupBy(key).agg(F.count("*").alias("n"))
    small, large = (p.alias("l").join(size.where(c).alias("r"), same([key]), "left_semi") for c in (f"n <= {local}", f"n > {local}"))

    def run(t: pa.Table) -> pa.Table:
        return keyed(t, [key], dict(zip(AXES, simplify(columns(t, AXES), d).T, strict=True)))

    near = by_group(small, [key], run, f"{key} {dict(points.dtypes)[key]}, x double, y double, z double")
    return near if size.where(f"n > {local}").isEmpty() else near.unionByName(by_rounds(large, d, key))
