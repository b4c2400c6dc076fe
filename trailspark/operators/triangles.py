"""Triangles of the surface where voxel values pass zero, as joins and expressions.

Cubes between eight voxels are cut into six tetrahedra along their main diagonal,
so cubes agree on shared faces. A tetrahedron whose corners have both signs holds
one or two triangles, whose vertices lie on its edges where the values, taken as
linear, are zero. A vertex is named by its edge (lower voxel, direction), which all
cubes around share; a surface is closed where voxels around it are outside.

Voxels bring their value to the eight cubes they are a corner of, which is one
shuffle; what a case holds is a table of 120 rows made from the rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORNERS = [(n & 1, n >> 1 & 1, n >> 2 & 1) for n in range(8)]
#: Tetrahedra by corners: from 0 to 7, one axis after the other.
TETRAHEDRA = [(0, 1 << a, (1 << a) | (1 << b), 7) for a, b, _ in permutations(range(3))]


def case_rows() -> list[tuple]:
    """(tetrahedron, mask of its corners inside, three edges as pairs of corners), seen from outside in anticlockwise order."""
    out = []
    at = np.array(CORNERS, float)
    for n, tet in enumerate(TETRAHEDRA):
        for size in (1, 2, 3):
            for inside in combinations(range(4), size):
                outside = [c for c in range(4) if c not in inside]
                if size == 2:
                    (a, b), (c, d) = inside, outside
                    faces = [((a, c), (a, d), (b, d)), ((a, c), (b, d), (b, c))]
                else:
                    one, others = (inside[0], outside) if size == 1 else (outside[0], inside)
                    faces = [tuple((one, o) for o in others)]
                away = at[[tet[c] for c in outside]].mean(0) - at[[tet[c] for c in inside]].mean(0)
                for face in faces:
                    p, q, r = (at[[tet[u], tet[v]]].mean(0) for u, v in face)
                    face = face if np.cross(q - p, r - p) @ away > 0 else face[::-1]
                    edges = [sorted((tet[u], tet[v])) for u, v in face]
                    out.append((n, sum(1 << c for c in inside), *(c for e in edges for c in e)))
    return out


def triangles(voxels: DataFrame, low: Sequence[float] = (0, 0, 0), size: Sequence[float] = (1, 1, 1), around: float | None = None) -> DataFrame:
    """``t, v1, v2, v3`` of ``voxels (t, i, j, k, v)``: vertices as structs of their edge ``i, j, k, direction`` and position ``x, y, z``.

    ``around``: the value of voxels that are not there; without it cubes that lack
    a corner have no triangles. Voxels with a null value are not there. Several
    rows of one voxel count as the largest.
    """
    corner = F.explode(F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), (F.col("k") - c).alias("k"), F.lit(n).alias("n")) for n, (a, b, c) in enumerate(CORNERS)]))
    cubes = voxels.where("v is not null").select("t", F.col("v").cast("double").alias("v"), corner.alias("c")).groupBy("t", "c.i", "c.j", "c.k").agg(*[F.max(F.when(F.col("c.n") == n, F.col("v"))).alias(f"c{n}") for n in range(8)])
    corners = [f"c{n}" for n in range(8)]
    cubes = cubes.fillna(float(around), corners) if around is not None else cubes.dropna(subset=corners)
    cubes = cubes.where((F.greatest(*corners) > 0) & (F.least(*corners) <= 0)).select("t", "i", "j", "k", F.array(*corners).alias("c"))
    mask = lambda tet: sum((F.when(F.col("c")[c] > 0, 1 << n).otherwise(0) for n, c in enumerate(tet)), F.lit(0))
    tets = cubes.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("tet"), mask(tet).alias("mask")) for n, tet in enumerate(TETRAHEDRA)])).alias("s")).select("t", "i", "j", "k", "c", "s.*")
    cases = voxels.sparkSession.createDataFrame(case_rows(), "tet int, mask int, " + ", ".join(f"{x}{n} int" for n in (1, 2, 3) for x in "uv"))
    d = tets.join(F.broadcast(cases), ["tet", "mask"])

    def vertex(n: int):
        u, v = F.col(f"u{n}"), F.col(f"v{n}")
        a, b = F.col("c")[u], F.col("c")[v]
        share = a / (a - b)
        bit = lambda e, axis: F.shiftright(e, axis).bitwiseAND(1)
        index = [(F.col(c) + bit(u, axis)).alias(c) for axis, c in enumerate("ijk")]
        place = [(lo + s * (F.col(c) + bit(u, axis) + share * (bit(v, axis) - bit(u, axis)))).cast("double").alias(x) for axis, (c, x, lo, s) in enumerate(zip("ijk", "xyz", low, size, strict=True))]
        return F.struct(*index, (v - u).alias("direction"), *place).alias(f"v{n}")

    return d.select("t", *[vertex(n) for n in (1, 2, 3)])


def cross() -> list:
    """Twice the area of each triangle as a vector that points outwards."""
    e, f = ([F.col(f"{v}.{x}") - F.col(f"v1.{x}") for x in "xyz"] for v in ("v2", "v3"))
    return [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]


def vertices(faces: DataFrame) -> DataFrame:
    """``t, i, j, k, direction, x, y, z, nx, ny, nz``: each vertex once, with its unit normal (NULL where triangles cancel out)."""
    d = faces.select("t", *[c.alias(n) for c, n in zip(cross(), ("a", "b", "c"), strict=True)], F.explode(F.array("v1", "v2", "v3")).alias("p"))
    ids = ["t", "p.i", "p.j", "p.k", "p.direction"]
    s = d.groupBy(*ids).agg(*[F.first(f"p.{x}").alias(x) for x in "xyz"], *[F.sum(x).alias(x) for x in "abc"])
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return s.select("t", "i", "j", "k", "direction", "x", "y", "z", *[F.when(size > 0, F.col(x) / size).alias(f"n{y}") for x, y in zip("abc", "xyz", strict=True)])


def shape(faces: DataFrame) -> DataFrame:
    """``t, vertices, edges, faces, open_edges, euler, area, volume`` of each time; an open edge is of one triangle."""
    name = lambda v: F.struct(*[f"{v}.{c}" for c in ("i", "j", "k", "direction")])
    pair = lambda v, w: F.struct(F.least(name(v), name(w)).alias("a"), F.greatest(name(v), name(w)).alias("b"))
    points = faces.select("t", F.explode(F.array(*[name(v) for v in ("v1", "v2", "v3")])).alias("p")).distinct().groupBy("t").agg(F.count("*").alias("vertices"))
    edges = faces.select("t", F.explode(F.array(pair("v1", "v2"), pair("v2", "v3"), pair("v3", "v1"))).alias("e")).groupBy("t", "e").agg(F.count("*").alias("n"))
    edges = edges.groupBy("t").agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("open_edges"))
    c = cross()
    area = F.sqrt(sum((x * x for x in c), F.lit(0.0))) / 2
    volume = sum((F.col(f"v1.{x}") * y for x, y in zip("xyz", c, strict=True)), F.lit(0.0)) / 6
    sizes = faces.groupBy("t").agg(F.count("*").alias("faces"), F.sum(area).alias("area"), F.sum(volume).alias("volume"))
    return points.join(edges, "t").join(sizes, "t").select("t", "vertices", "edges", "faces", "open_edges", (F.col("vertices") - F.col("edges") + F.col("faces")).alias("euler"), "area", "volume")
