"""Logical inputs made from relational tables: tracks from an event log, displacements from tracks, and others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.operators import tracks as T
from trailspark.operators.graph import sized
from trailspark.plans.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str, key: str = "long") -> DataFrame:
    """``track_id, t, x, y, z, experiment, date, spf``: a user's events in order are the frames of a track. ``key``: the type of ``track_id``."""
    # named and cast before the window, so what follows by track knows that rows lie by it
    user = F.col("user_id")
    e = table(spark, sf_dir, "events").withColumn("track_id", user.cast(key))
    frame = F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id")) - 1
    return e.select(
        "track_id",
        frame.cast("long").alias("t"),
        F.col("value").alias("x"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("y"),
        F.hour("ts").cast("double").alias("z"),
        F.concat(F.lit("exp"), (user % 4).cast("string")).alias("experiment"),
        F.element_at(F.array(F.lit("191205"), F.lit("191206"), F.lit("191203")), (user % 3 + 1).cast("int")).alias("date"),
        F.when(user % 4 < 2, 10).otherwise(30).alias("spf"),
    )


TRACKS_SQL = """
tracks AS (
  SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
    value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y, CAST(hour(ts) AS DOUBLE) AS z,
    'exp' || CAST(user_id % 4 AS VARCHAR) AS experiment,
    CASE user_id % 3 WHEN 0 THEN '191205' WHEN 1 THEN '191206' ELSE '191203' END AS date,
    CASE WHEN user_id % 4 < 2 THEN 10 ELSE 30 END AS spf
  FROM events)
"""


def displacements(spark: SparkSession, sf_dir: str, lags: int = 12) -> DataFrame:
    """The displacement table of those tracks, along the straight x-line."""
    return T.displacements(tracks(spark, sf_dir, "string"), lags)


DISPLACEMENTS_SQL = (
    TRACKS_SQL
    + """,
extent AS (SELECT track_id, count(*) AS num_points, (max(t) - min(t)) * max(spf) AS duration FROM tracks GROUP BY track_id),
pairs AS (
  SELECT a.track_id, a.date, a.experiment, a.spf, a.t AS t1, b.t AS t2, b.t - a.t AS delta, b.x - a.x AS dx,
    sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS strt_disp
  FROM tracks a JOIN tracks b ON a.track_id = b.track_id AND b.t > a.t AND b.t <= a.t + 12),
displacements AS (
  SELECT p.date, p.experiment, CAST(p.track_id AS VARCHAR) AS track_id, CAST(p.delta * p.spf AS DOUBLE) AS lag, e.num_points,
    CAST(e.duration AS DOUBLE) AS duration, abs(p.dx) AS disp, p.strt_disp, p.t1, p.t2,
    CASE WHEN q.track_id IS NULL THEN NULL WHEN sign(p.dx) = sign(q.dx) THEN 1.0 ELSE -1.0 END AS reldir
  FROM pairs p JOIN extent e ON e.track_id = p.track_id
  LEFT JOIN pairs q ON q.track_id = p.track_id AND q.delta = p.delta AND q.t2 = p.t1)
"""
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, pos, label`` with double coordinates."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("pos"), "label")


def tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a, b``: undirected edges between suppliers of consecutive lines of an order, each once with a < b."""
    li = table(spark, sf_dir, "lineitem")
    # partitions by the number of rows, so that a task sorts no more of a larger table
    parts = sized(li, li.count())
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(parts, "l_orderkey")
    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = li.select(F.col("l_suppkey").alias("s"), nxt.alias("n")).where("n is not null and s <> n")
    return e.select(F.least("s", "n").alias("a"), F.greatest("s", "n").alias("b")).repartition(parts, "a", "b").distinct()


TISSUE_SQL = """
steps AS (SELECT l_suppkey AS s, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
edges AS (SELECT DISTINCT least(s, n) AS a, greatest(s, n) AS b FROM steps WHERE n IS NOT NULL AND s <> n),
arcs AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)
"""


def voxels(spark: SparkSession, sf_dir: str, side: int = 12) -> DataFrame:
    """``t, i, j, k, v``: a grid whose cells average what falls into them."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        (F.col("l_linenumber") % 3).cast("int").alias("t"), (F.col("l_partkey") % side).cast("int").alias("i"),
        (F.col("l_suppkey") % side).cast("int").alias("j"), (F.col("l_orderkey") % side).cast("int").alias("k"),
    ).agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")) - 25 * F.count("*")).cast("double").alias("v"))


VOXELS_SQL = """
voxels AS (
  SELECT CAST(l_linenumber % 3 AS INTEGER) AS t, CAST(l_partkey % 12 AS INTEGER) AS i, CAST(l_suppkey % 12 AS INTEGER) AS j,
    CAST(l_orderkey % 12 AS INTEGER) AS k, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) - 25 * count(*) AS DOUBLE) AS v
  FROM lineitem GROUP BY 1, 2, 3, 4)
"""
