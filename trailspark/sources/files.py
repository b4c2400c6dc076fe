"""Readers of the file formats: displacement and track tables, spot and surface archives, graphs, JSON maps, directory trees.

Everything is opened by Spark's readers, so paths may be in any store they read.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import text as X
from trailspark.plans.session import ship

from .schema import DISPLACEMENT_COLUMNS, nan_to_null


def displacement_csv(spark: SparkSession, path: str) -> DataFrame:
    """A displacement file by column name (index and extra columns are left); empty fields and NaN are NULL, dates stay text."""
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    return nan_to_null(raw.select(*(F.col(f"`{h}`").cast(t).alias(c) if h in have else F.lit(None).cast(t).alias(c) for h, c, t in DISPLACEMENT_COLUMNS)))


def track_csv(spark: SparkSession, path: str, track: str = "id", time: str = "t", x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """``track_id, t, pos`` with names of the file's columns as parameters; of repeated times the last row counts.

    Rows keep their order by place in the file: partition and row within it.
    """
    raw = spark.read.option("header", True).csv(path).withColumn("_row", F.monotonically_increasing_id())
    rows = raw.select(F.col(track).alias("track_id"), F.col(time).cast("double").cast("long").alias("t"), F.array(*(F.col(c).cast("double") for c in (x, y, z))).alias("pos"), "_row")
    return rows.groupBy("track_id", "t").agg(F.max_by("pos", "_row").alias("pos"))


_SPOTS = "path string, kind string, i long, track_id long, start_i long, end_i long, t long, pos array<double>"


def spots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, spots) of spot archives: ``path, track_id, start_i, end_i`` and ``path, i, t, pos``."""
    ship(spark)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                e = z["track_edges"].reshape(-1, 2)
                yield pd.DataFrame({"path": name, "kind": "edge", "i": np.arange(len(e)), "track_id": z["track_ids"].astype("int64"), "start_i": e[:, 0].astype("int64"), "end_i": e[:, 1].astype("int64"), "t": -1, "pos": [[0.0]] * len(e)})
                n = len(z["times"])
                yield pd.DataFrame({"path": name, "kind": "spot", "i": np.arange(n), "track_id": -1, "start_i": -1, "end_i": -1, "t": z["times"].astype("int64"), "pos": z["positions"].astype(float).tolist()})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _SPOTS)
    return rows.where("kind = 'edge'").select("path", "track_id", "start_i", "end_i"), rows.where("kind = 'spot'").select("path", "i", "t", "pos")


def tracks_of_spots(edges: DataFrame, points: DataFrame, key: Iterable[str] = ("path",)) -> DataFrame:
    """``track_id, t, pos``: both ends of every edge, one point for each time; a spot without an edge is in no track."""
    key = list(key)
    ends = edges.select(*key, "track_id", F.col("start_i").alias("i")).unionByName(edges.select(*key, "track_id", F.col("end_i").alias("i")))
    return ends.distinct().join(points, [*key, "i"]).groupBy(*key, "track_id", "t").agg(F.max_by("pos", "i").alias("pos"))


def surfaces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(voxels, boxes) of surface archives: ``path, t, i, j, k, v`` and ``path, t, lo, hi, size`` (arrays by axis)."""
    ship(spark)
    spec = "path string, t long, i int, j int, k int, v double, lo array<double>, hi array<double>, size array<double>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                data = np.squeeze(z["data"])
                data = data[None] if data.ndim == 3 else data
                for t, grid in enumerate(data):
                    lo = [float(np.atleast_1d(z[f"min_{a}"])[t]) for a in "xyz"]
                    hi = [float(np.atleast_1d(z[f"max_{a}"])[t]) for a in "xyz"]
                    size = [(b - a) / max(n - 1, 1) for a, b, n in zip(lo, hi, grid.shape, strict=True)]
                    idx = np.indices(grid.shape).reshape(3, -1)
                    n = idx.shape[1]
                    yield pd.DataFrame({"path": name, "t": t, "i": idx[0], "j": idx[1], "k": idx[2], "v": grid.ravel().astype(float), "lo": [lo] * n, "hi": [hi] * n, "size": [size] * n})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, spec)
    return rows.select("path", "t", "i", "j", "k", "v"), rows.select("path", "t", "lo", "hi", "size").distinct()


def experiments(spark: SparkSession, root: str, spots_name: str = "Spots 1.npz", time_name: str = "time.time", exclude: Iterable[str] = ()) -> DataFrame:
    """``dir, date, experiment, spf, spots, surfaces``: directories with a time file, a spots file and a surface or more.

    Surfaces are the other archives whose name isn't excluded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    d = files.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).withColumn("name", F.element_at(X.parts(F.col("path")), -1))
    shut = spark.createDataFrame([(x,) for x in exclude], "name string")
    archives = d.where(F.col("name").endswith(".npz") & (F.col("name") != spots_name)).join(F.broadcast(shut), "name", "left_anti").groupBy("dir").agg(F.array_sort(F.collect_list("path")).alias("surfaces"))
    spot = d.where(F.col("name") == spots_name).select("dir", F.col("path").alias("spots"))
    steps = time_steps(spark, root, time_name).withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).select("dir", "spf")
    found = spot.join(steps, "dir").join(archives, "dir")
    where = X.experiment(F.col("spots"))
    return found.select("dir", where["date"].alias("date"), where["experiment"].alias("experiment"), "spf", "spots", "surfaces")


def time_steps(spark: SparkSession, root: str, name: str = "time.time") -> DataFrame:
    """``path, spf``: the first line of each time file as seconds per frame."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n")[0].cast("double").alias("spf"))


def base_timestep_json(spark: SparkSession, path: str) -> DataFrame:
    """``timestep, exp_id`` of a map from timesteps to lists of experiments."""
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("k", "v"))
    return each.select(F.col("k").cast("double").alias("timestep"), F.explode("v").alias("exp_id"))


def fit_json(spark: SparkSession, path: str) -> DataFrame:
    """``lag, dist, params, sse, sse_nbins`` of a fit file."""
    raw = spark.read.text(path, wholetext=True)
    lags = raw.select(F.explode(F.from_json("value", "map<string,map<string,struct<params:array<double>,sse:double,sse_nbins:int>>>")).alias("lag", "m"))
    each = lags.select(F.col("lag").cast("int").cast("double").alias("lag"), F.explode("m").alias("dist", "f"))
    return each.select("lag", "dist", "f.params", "f.sse", "f.sse_nbins")


def graph_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a network file: ``id, x, y, z, radius, type`` and ``a, b, weight`` (the ends' distance).

    Ids count from the first (least) id of the file.
    """
    lines = spark.read.text(path)
    attr = lambda n: F.regexp_extract("value", rf'\b{n}="([^"]*)"', 1)
    nodes = lines.where(F.col("value").contains("<NetworkNode ")).select(attr("id").cast("long").alias("id"), *(attr(f"{c}f").cast("double").alias(c) for c in "xyz"), attr("radius").cast("double").alias("radius"), attr("type").alias("type"))
    first = nodes.agg(F.min("id").alias("first"))
    nodes = nodes.join(F.broadcast(first)).withColumn("id", F.col("id") - F.col("first")).drop("first")
    edges = lines.where(F.col("value").contains("<NetworkSegment ")).select(attr("start").cast("long").alias("a"), attr("end").cast("long").alias("b"))
    edges = edges.join(F.broadcast(first)).select((F.col("a") - F.col("first")).alias("a"), (F.col("b") - F.col("first")).alias("b"))
    at = lambda end: nodes.select(F.col("id").alias(end), F.array("x", "y", "z").alias(f"_{end}"))
    from trailspark.functions.vectors import distance

    return nodes, edges.join(at("a"), "a").join(at("b"), "b").select("a", "b", distance(F.col("_a"), F.col("_b")).alias("weight"))
