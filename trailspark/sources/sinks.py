"""Writers of the file formats. Parquet is for intermediates; these are for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import DISPLACEMENT_COLUMNS


def displacement_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """With the original header; ``exp_id`` goes along where there is one."""
    cols = [F.col(c).cast(t).alias(h) for h, c, t in DISPLACEMENT_COLUMNS if c in df.columns]
    extra = [F.col("exp_id").alias("experiment_id")] if "exp_id" in df.columns else []
    df.select(*cols, *extra).write.mode(mode).option("header", True).csv(path)


#: Header of a table of means.
MEANS = {"lag": "timestep (s)", "mean_disp": "mean displacememt (mu m)", "mean_disp_sq": "mean-squared displacement (mu m ^2)", "mean_strt": "mean straight displacement (mu m)", "mean_strt_sq": "mean-squared straight displacement (mu m ^2)"}


def means_csv(stats: DataFrame, path: str, mode: str = "error") -> None:
    stats.select(*(F.col(c).alias(h) for c, h in MEANS.items())).orderBy(F.col(f"`{MEANS['lag']}`")).write.mode(mode).option("header", True).csv(path)


def fit_document(fits: DataFrame) -> DataFrame:
    """One row with the nested JSON of fits by lag: a few lags times a few families."""
    each = fits.where("params is not null").groupBy("lag").agg(F.map_from_entries(F.collect_list(F.struct("dist", F.struct("params", "sse", "sse_nbins")))).alias("m"))
    return each.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("lag").cast("int").cast("string"), "m")))).alias("value"))


def fit_json(fits: DataFrame, path: str, mode: str = "error") -> None:
    fit_document(fits).write.mode(mode).text(path)


def base_timestep_document(base: DataFrame) -> DataFrame:
    """One row with the JSON map of ``timestep, exp_id``."""
    each = base.groupBy("timestep").agg(F.array_sort(F.collect_set("exp_id")).alias("e"))
    return each.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("timestep").cast("double").cast("string"), "e"))))).alias("value"))


def base_timestep_json(base: DataFrame, path: str, mode: str = "error") -> None:
    base_timestep_document(base).write.mode(mode).text(path)


def positions_csv(positions: DataFrame, path: str, mode: str = "error") -> None:
    positions.where("iteration > 0").select("iteration", "cell_id", "tail_id", "head_id", "edge_loc").write.mode(mode).option("header", True).csv(path)


def coverage_csv(curve: DataFrame, path: str, mode: str = "error") -> None:
    """Of a walker simulation: ``iteration, coverage``; of a sweep: sizes and node counts."""
    if "cells" in curve.columns:
        curve = curve.select(F.col("graph_size").alias("graph size"), F.col("cells").alias("number of tcells"), "coverage")
    else:
        curve = curve.select("iteration", "coverage")
    curve.write.mode(mode).option("header", True).csv(path)


def metadata(spark, cells: int, iterations: int, movement: str, params: list[float]) -> DataFrame:
    row = spark.createDataFrame([(cells, iterations, movement, [float(p) for p in params])], "num_cells long, total_iterations long, movement string, params array<double>")
    return row.select(F.to_json(F.struct("*")).alias("value"))


def adjacency_text(lines: DataFrame, path: str, mode: str = "error") -> None:
    lines.orderBy("node").select(F.col("line").alias("value")).write.mode(mode).text(path)


def tagged(name: str, at: Column | None = None) -> Column:
    """A name with the time before it."""
    from trailspark.functions.text import time_tag

    return F.concat(time_tag(at), F.lit("_"), F.lit(name))
