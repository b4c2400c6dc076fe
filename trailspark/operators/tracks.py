"""Tracks: time-indexed points, their pairs over lags, and what pairs measure.

A track is the rows of one key; ``t`` is an integer frame. Nothing needs a
track in one place but windows partitioned by its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("track_id",)


def dedupe(points: DataFrame, seq: str, key: Sequence[str] = KEY) -> DataFrame:
    """One row for each track and frame: the last written (largest ``seq``). Partial aggregation, no window."""
    rest = [c for c in points.columns if c not in (*key, "t", seq)]
    last = points.groupBy(*key, "t").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last"))
    return last.select(*key, "t", "last.*")


def at_time(points: DataFrame, t: int, key: Sequence[str] = KEY) -> DataFrame:
    """Each track's point at frame ``t``, NULL where it has none (exact, not as-of)."""
    rest = [c for c in points.columns if c not in (*key, "t")]
    return points.groupBy(*key).agg(*(F.max(F.when(F.col("t") == t, F.col(c))).alias(c) for c in rest))


def ordinal(key: Sequence[str] = KEY) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy("t")) - 1


def track_slice(points: DataFrame, start: int | None, stop: int | None, key: Sequence[str] = KEY) -> DataFrame:
    """Points by ordinal as a Python slice takes them, negative bounds from the end."""
    n = F.count("*").over(Window.partitionBy(*key))
    at = lambda v, default: default if v is None else F.lit(v) if v >= 0 else F.greatest(n + v, F.lit(0))
    d = points.withColumn("_i", ordinal(key)).withColumn("_lo", at(start, F.lit(0))).withColumn("_hi", at(stop, n))
    return d.where("_i >= _lo and _i < _hi").drop("_i", "_lo", "_hi")


def item(points: DataFrame, i: int, key: Sequence[str] = KEY) -> DataFrame:
    """The i-th point of each track; none where the track is shorter."""
    return track_slice(points, i, None if i == -1 else i + 1, key)


def window_sample(points: DataFrame, most: int | None, seed: int = 0, key: Sequence[str] = KEY) -> DataFrame:
    """A random run of at most ``most`` points of each track; the start is a hash of (seed, track) over [0, n - most). None: all."""
    if most is None:
        return points
    n = F.count("*").over(Window.partitionBy(*key))
    start = F.when(F.col("_n") > most, F.pmod(F.xxhash64(F.lit(seed), *key), F.col("_n") - most)).otherwise(0)
    d = points.withColumn("_i", ordinal(key)).withColumn("_n", n).withColumn("_s", start)
    return d.where((F.col("_i") >= F.col("_s")) & (F.col("_i") < F.col("_s") + most)).drop("_i", "_n", "_s")


def split_by(points: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where it holds, the rest); unknown counts as not."""
    holds = F.coalesce(predicate, F.lit(False))
    return points.where(holds), points.where(~holds)


def extents(points: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Points and duration in frames of each track."""
    return points.groupBy(*key).agg(F.count("*").alias("num_points"), (F.max("t") - F.min("t")).alias("frames"))


def pairwise(points: DataFrame, delta: int, cols: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Points of a track ``delta`` frames apart: an equi-join on the shifted frame."""
    a = points.select(*key, F.col("t").alias("t1"), *(F.col(c).alias(f"{c}1") for c in cols), (F.col("t") + delta).alias("_t"))
    b = points.select(*key, F.col("t").alias("_t"), F.col("t").alias("t2"), *(F.col(c).alias(f"{c}2") for c in cols))
    return a.join(b.hint("merge"), [*key, "_t"]).drop("_t")


#: Frames of a side of a tile of pairs.
TILE = 256


def all_lags(points: DataFrame, cols: Sequence[str], lags: int | None = None, key: Sequence[str] = KEY, tile: int = TILE) -> DataFrame:
    """Pairs of a track at every lag (up to ``lags`` frames).

    Bounded, the range join becomes an equi-join on (track, frame): each point is
    repeated once for each lag. Unbounded, frames are dealt in blocks of ``tile``
    and the join is on (track, earlier block, later block): a point goes to the
    tiles of its block, up to the track's last block and down to its first. Either
    way long tracks spread over partitions.
    """
    b = points.select(*key, F.col("t").alias("t2"), *(F.col(c).alias(f"{c}2") for c in cols))
    a = points.select(*key, F.col("t").alias("t1"), *(F.col(c).alias(f"{c}1") for c in cols))
    if lags is None:
        block = lambda c: F.floor(F.col(c) / tile).cast("long")
        ends = points.groupBy(*key).agg(F.floor(F.min("t") / tile).cast("long").alias("_first"), F.floor(F.max("t") / tile).cast("long").alias("_last"))
        a = a.join(ends, list(key)).withColumn("_i", block("t1")).withColumn("_j", F.explode(F.sequence("_i", "_last"))).drop("_first", "_last")
        b = b.join(ends, list(key)).withColumn("_j", block("t2")).withColumn("_i", F.explode(F.sequence("_first", "_j"))).drop("_first", "_last")
        return a.join(b.hint("merge"), [*key, "_i", "_j"]).where("t2 > t1").withColumn("delta", F.col("t2") - F.col("t1")).drop("_i", "_j")
    steps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(lags).cast("long")))
    a = a.withColumn("delta", steps).withColumn("t2", F.col("t1") + F.col("delta"))
    return a.join(b.hint("merge"), [*key, "t2"])


def arrivals(pairs: DataFrame, direction: str = "dir", key: Sequence[str] = KEY, arriving: str | None = None) -> DataFrame:
    """Adds ``reldir``: 1 where a pair leaves as the pair of equal lag before it arrived, -1 where not, NULL without one.

    The pair before is found by a window over frames of equal remainder, so there
    is no second join; a gap in the track shows as another end frame. A leaving
    direction of 0 equals neither sign and counts as a reversal. ``arriving``: the
    direction at a pair's end, where it is not that at its start.
    """
    w = Window.partitionBy(*key, "delta", F.pmod("t1", "delta")).orderBy("t1")
    before = F.when(F.lag("t2").over(w) == F.col("t1"), F.lag(arriving or direction).over(w))
    return pairs.withColumn("_before", before).withColumn("reldir", F.when(F.col("_before").isNull(), None).when(F.col(direction) == F.col("_before"), 1.0).otherwise(-1.0)).drop("_before")


#: Frames of a block in which near frames of a track meet.
BLOCK = 4096


def near_pairs(points: DataFrame, lags: int, cols: Sequence[str], key: Sequence[str] = KEY, block: int = BLOCK) -> DataFrame:
    """Pairs of a track up to ``lags`` frames apart, with ``dir``, the sign of the way along the first of ``cols``, and ``before``, that of the pair of equal lag that arrives where this one leaves.

    Columns of the leaving point stay, ``<col>2`` are the other's. Frames are dealt in
    blocks of ``block``, to which those within ``lags`` of an end go too; in a block a
    window collects what is near a frame. So a point is sent once, near the ends of
    blocks twice, not once for each lag, and long tracks spread over partitions.
    """
    first = cols[0]
    at = lambda c: F.floor(c / block)
    p = points.where("t is not null").withColumn("_block", F.explode(F.sequence(at(F.col("t") - lags), at(F.col("t") + lags))))
    w = Window.partitionBy(*key, "_block").orderBy("t")
    p = p.withColumn("_after", F.collect_list(F.struct("t", *cols)).over(w.rangeBetween(1, lags)))
    p = p.withColumn("_ago", F.collect_list(F.struct("t", first)).over(w.rangeBetween(-lags, -1)))
    p = p.where(F.col("_block") == at(F.col("t"))).withColumn("_next", F.explode("_after")).withColumn("delta", F.col("_next.t") - F.col("t"))
    # without gaps the place of the frame is known
    here = F.get("_ago", (F.size("_ago") - F.col("delta")).cast("int"))
    ago = F.when(here["t"] == F.col("t") - F.col("delta"), here).otherwise(F.get(F.filter("_ago", lambda q: q["t"] == F.col("t") - F.col("delta")), F.lit(0)))
    way = lambda a, b: F.signum(b - a)
    p = p.withColumns({"before": way(ago[first], F.col(first)), "dir": way(F.col(first), F.col(f"_next.{first}"))})
    return p.withColumns({"t2": F.col("_next.t"), **{f"{c}2": F.col(f"_next.{c}") for c in cols}}).withColumnRenamed("t", "t1").drop("_block", "_after", "_ago", "_next")


def displacements(points: DataFrame, lags: int | None = 12) -> DataFrame:
    """The displacement table of tracks that run along the x-line (an exact case of arc length).

    Input: ``track_id, t, x, y, z, experiment, date, spf``.
    """
    ext = points.groupBy("track_id").agg(F.count("*").alias("num_points"), ((F.max("t") - F.min("t")) * F.max("spf")).cast("double").alias("duration"))
    # sizes of files say little of the rows in them: no side is sent whole
    points = points.select("track_id", "t", "x", "y", "z", "experiment", "date", "spf").join(ext.hint("merge"), "track_id")
    if lags is None:
        pairs = all_lags(points, ["x", "y", "z", "experiment", "date", "spf", "num_points", "duration"], None)
        pairs = arrivals(pairs.withColumn("dir", F.signum(F.col("x2") - F.col("x1")))).withColumnsRenamed({f"{c}1": c for c in ("x", "y", "z", "experiment", "date", "spf", "num_points", "duration")})
    else:
        reldir = F.when(F.col("before").isNull(), None).when(F.col("dir") == F.col("before"), 1.0).otherwise(-1.0)
        pairs = near_pairs(points, lags, ["x", "y", "z"]).withColumn("reldir", reldir)
    sq = lambda c: (F.col(f"{c}2") - F.col(c)) * (F.col(f"{c}2") - F.col(c))
    return pairs.select(
        "date", "experiment", F.col("track_id").cast("string").alias("track_id"), (F.col("delta") * F.col("spf")).cast("double").alias("lag"), "num_points", "duration",
        F.abs(F.col("x2") - F.col("x")).alias("disp"), F.lit(0.0).alias("disp_err"), F.sqrt(sq("x") + sq("y") + sq("z")).alias("strt_disp"), "reldir", "t1", "t2",
    )
