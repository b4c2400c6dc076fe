"""Geometric joins inside a group: radius, nearest, farthest, subtraction of sets; no group is paired whole."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import vectors as V

from .graph import spread


def radius_pairs(points: DataFrame, d: float, key: Sequence[str], cols: Sequence[str] = ("x", "y", "z"), by: str = "t") -> DataFrame:
    """Ordered pairs of a group's points nearer than ``d`` (each point with itself too), as ``<by>1, <by>2``.

    Points meet by grid cells of side ``d``: one side is repeated into its 3^k
    neighbouring cells, so the join is an equi-join and no group is paired whole. The
    size of a file says little of those rows: neither side is sent whole.
    """
    cell = lambda c: F.floor(F.col(c) / d).cast("long")
    a = points.select(*key, F.col(by).alias(f"{by}1"), *(F.col(c).alias(f"{c}1") for c in cols), *(cell(c).alias(f"_{c}") for c in cols))
    b = points.select(*key, F.col(by).alias(f"{by}2"), *(F.col(c).alias(f"{c}2") for c in cols))
    for c in cols:
        b = b.withColumn(f"_{c}", F.explode(F.array(*((F.floor(F.col(f"{c}2") / d) + o).cast("long") for o in (-1, 0, 1)))))
    sq = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in cols), F.lit(0.0))
    return a.join(b.hint("merge"), [*key, *(f"_{c}" for c in cols)]).where(sq < d * d).select(*key, f"{by}1", f"{by}2")


#: Points of a side of a tile, and rows of it that are held against the other side at once.
TILE, ROWS = 4096, 512


def centres(points: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """``key, _centre``: the mean position of each group."""
    each = points.select(*key, F.posexplode(pos).alias("_k", "_v")).groupBy(*key, "_k").agg(F.avg("_v").alias("_v"))
    return each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("_centre"))


def known(points: DataFrame, pos: str) -> DataFrame:
    """Points all of whose coordinates are known and finite, with their number in ``_dim``; others are at no distance from any."""
    whole = F.forall(pos, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return points.where(F.coalesce(whole, F.lit(False))).withColumn("_dim", F.size(pos))


def positions(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows."""
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks]).reshape(len(column), -1)


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows, added up coordinate by coordinate."""
    d2 = np.zeros(len(p))
    for k in range(p.shape[1]):
        d2 += (p[:, k] - q[:, k]) ** 2
    return d2


def products(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some rows of ``p`` at a time: the first one's number, squared distances to all of ``q`` by one product of matrices, and how far off these may be, by row."""
    middle = q.mean(0)
    p, q = p - middle, q - middle
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    slack = np.finfo(float).eps * 4 * (p.shape[1] + 8)
    for at in range(0, len(p), ROWS):
        part = slice(at, at + ROWS)
        yield at, pp[part, None] + qq - 2 * (p[part] @ q.T), slack * (pp[part] + qq.max())


def nearest(queries: DataFrame, candidates: DataFrame, key: Sequence[str], query_id: str, pos: str, cand_id: str, cand_pos: str) -> DataFrame:
    """Nearest candidate of each query in its group; ties go to the smaller candidate id.

    Queries and candidates meet in tiles of ``TILE`` by ``TILE``, so a point is sent
    once for each tile of the other side. In a tile one product of matrices gives
    all distances up to rounding; what rounding can't tell from the least is
    measured exactly. Minima over tiles are partial aggregations.
    """
    by = [*key, "_dim"]
    q = known(queries, pos).select(*by, F.col(query_id).alias("_q"), F.col(pos).alias("_p"))
    c = known(candidates, cand_pos).select(*by, F.col(cand_id).alias("_c"), F.col(cand_pos).alias("_p"))
    tiles = lambda d, n: d.groupBy(*by).agg(F.ceil(F.count("*") / TILE).cast("int").alias(n))
    size = tiles(q, "_nq").join(tiles(c, "_nc"), by)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    q = q.join(size, by).select(*by, own("_q", "_nq").alias("_i"), every("_nc").alias("_j"), "_q", F.lit(None).alias("_c"), "_p")
    c = c.join(size, by).select(*by, every("_nq").alias("_i"), own("_c", "_nc").alias("_j"), F.lit(None).alias("_q"), "_c", "_p")
    both = spread(q.unionByName(c), *by, "_i", "_j")
    out = both.select(*key, "_q", "_c").withColumn("_d2", F.lit(0.0)).schema

    def meet(t: pa.Table) -> pa.Table:
        of = pc.is_valid(t.column("_c"))
        q, c = t.filter(pc.invert(of)), t.filter(of).sort_by("_c")
        if not len(q) or not len(c):
            return pa.table({n: t.column(n).slice(0, 0) if n != "_d2" else pa.array([], pa.float64()) for n in out.names})
        p, x = positions(q.column("_p")), positions(c.column("_p"))
        best, at = np.full(len(p), np.inf), np.zeros(len(p), np.int64)
        for first, d2, off in products(p, x):
            rows, cols = np.nonzero(d2 <= (d2.min(1) + 2 * off)[:, None])
            exact = squares(p[first + rows], x[cols])
            order = np.lexsort((cols, exact, rows))
            order = order[np.r_[True, rows[order][1:] != rows[order][:-1]]]
            best[first + rows[order]], at[first + rows[order]] = exact[order], cols[order]
        return pa.table([*(q.column(k) for k in key), q.column("_q"), c.column("_c").take(pa.array(at)), pa.array(best)], names=out.names)

    found = both.groupBy(*by, "_i", "_j").applyInArrow(meet, out)
    best = found.groupBy(*key, "_q").agg(F.min(F.struct(F.col("_d2").alias("d2"), F.col("_c").alias("c"))).alias("best"))
    return best.select(*key, F.col("_q").alias(query_id), F.col("best.c").alias(cand_id), F.col("best.d2").alias("d2"))


def farthest_pair(points: DataFrame, key: Sequence[str], point_id: str, pos: str) -> DataFrame:
    """Diameter of each group: ``a, b, d2`` with a < b; ties go to the first pair. Groups of one point have none.

    The point farthest from the centre and the one farthest from it give a lower
    bound; a point of the farthest pair is at least the bound less the radius away
    from the centre. Those that are meet in tiles of ``TILE`` by ``TILE`` points, so
    no group is joined as one. A tile gives its farthest pair: one product of
    matrices finds what may be it, exact distances decide.
    """
    groups, key = list(key), [*key, "_dim"]
    p = known(points, pos).select(*key, F.col(point_id).alias("_id"), F.col(pos).alias("_p"))
    p = p.join(centres(p, key, "_p"), key).withColumn("_r", F.sqrt(V.distance_sq(F.col("_p"), F.col("_centre")))).drop("_centre")
    out = p.groupBy(*key).agg(F.max("_r").alias("_most"), F.max_by("_p", F.struct("_r", "_id")).alias("_end"))
    bound = p.join(out, key).groupBy(*key).agg(F.sqrt(F.max(V.distance_sq(F.col("_p"), F.col("_end")))).alias("_least"), F.max("_most").alias("_most"))
    left = p.join(bound, key).where(F.col("_r") >= (F.col("_least") - F.col("_most")) * (1 - 1e-9) - 1e-12).select(*key, "_id", "_p")
    tiles = left.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_n"))
    left = left.join(tiles, key).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    up, down = F.explode(F.sequence("_own", F.col("_n") - 1)), F.explode(F.sequence(F.lit(0), "_own"))
    a = left.select(*key, F.col("_own").alias("_i"), up.alias("_j"), F.lit(True).alias("_first"), "_id", "_p")
    b = left.select(*key, down.alias("_i"), F.col("_own").alias("_j"), F.lit(False).alias("_first"), "_id", "_p")
    both = spread(a.unionByName(b), *key, "_i", "_j")
    out = both.select(*groups, F.col("_id").alias("a"), F.col("_id").alias("b")).withColumn("d2", F.lit(0.0)).schema

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("_id")
        a, b = t.filter(t.column("_first")), t.filter(pc.invert(t.column("_first")))
        if not len(a) or not len(b):
            return pa.table([*(t.column(k).slice(0, 0) for k in (*groups, "_id", "_id")), pa.array([], pa.float64())], names=out.names)
        p, x = positions(a.column("_p")), positions(b.column("_p"))
        ranks = pc.rank(pa.chunked_array([*a.column("_id").chunks, *b.column("_id").chunks]), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        i, j = ranks[: len(p)], ranks[len(p) :]
        best = None
        for first, d2, off in products(p, x):
            d2[i[first : first + ROWS, None] == j] = -np.inf  # a point and itself
            most = (d2.max(1) - 2 * off).max()
            if most == -np.inf or (best is not None and (d2.max(1) + 2 * off).max() < best[0]):
                continue
            rows, cols = np.nonzero(d2 + 2 * off[:, None] >= most)
            exact = squares(p[first + rows], x[cols])
            rows, cols = rows[exact == exact.max()] + first, cols[exact == exact.max()]
            lo, hi = np.minimum(i[rows], j[cols]), np.maximum(i[rows], j[cols])
            k = np.lexsort((hi, lo))[0]
            found = (exact.max(), -lo[k], -hi[k], rows[k], cols[k])
            best = found if best is None or found > best else best
        if best is None:
            return pa.table([*(t.column(k).slice(0, 0) for k in (*groups, "_id", "_id")), pa.array([], pa.float64())], names=out.names)
        ends = [a.column("_id").slice(best[3], 1), b.column("_id").slice(best[4], 1)]
        if i[best[3]] > j[best[4]]:
            ends.reverse()
        return pa.table([*(t.column(k).slice(0, 1) for k in groups), *ends, pa.array([best[0]])], names=out.names)

    pairs = both.groupBy(*key, "_i", "_j").applyInArrow(meet, out)
    best = pairs.groupBy(*groups).agg(F.max(F.struct(F.col("d2"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("m"))
    return best.select(*groups, (-F.col("m.na")).alias("a"), (-F.col("m.nb")).alias("b"), F.col("m.d2").alias("d2"))


def unclaimed(surfaces: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surfaces (``path, ids``) with an id that no track has, and tracks (``track_id``) that no surface has."""
    ids = surfaces.select("path", F.explode("ids").alias("track_id"))
    lost = ids.join(spots.select("track_id").distinct(), "track_id", "left_anti").select("path").distinct()
    left = spots.select("track_id").distinct().join(ids.select("track_id").distinct(), "track_id", "left_anti")
    return lost, left


def off_ends(projected: DataFrame, domains: DataFrame, joints: DataFrame, eps: float = V.EPS) -> DataFrame:
    """Projections (``track_id, branch_id, param``) but those at an end of their branch that is no joint.

    ``domains``: ``track_id, branch_id, lo, hi``; ``joints``: ``track_id, branch_id, joint``.
    """
    key = ["track_id", "branch_id"]
    at_joint = joints.groupBy(*key).agg(F.collect_list("joint").alias("_joints"))
    d = projected.join(domains, key, "left").join(at_joint, key, "left")
    near = lambda c: F.abs(F.col("param") - F.col(c)) < eps
    joined = F.exists(F.coalesce("_joints", F.array().cast("array<double>")), lambda j: F.abs(F.col("param") - j) < eps)
    return d.where(~F.coalesce((near("lo") | near("hi")) & ~joined, F.lit(False))).select(*projected.columns)
