"""The jobs: tracks to displacements, reduction, statistics, fits and their curves, simulation and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import text
from trailspark.operators import curves, fitting, graph, hist, quality, simulate, stats
from trailspark.sources import files, sinks

#: Lags shown and largest lag of a base timestep.
LAGS = {1: (range(1, 13), 12), 10: ((10, 20), 250)}
OTHER_LAGS = ((30, 60, 90, 120), 250)


def map_tracks(spark: SparkSession, root: str, out: str, exclude: Sequence[str] = (), most: int | None = None, exclude_ends: bool = True) -> None:
    """Displacement table of all experiments under a directory."""
    found = files.experiments(spark, root, exclude=exclude).select("date", "experiment", "spf", F.col("spots").alias("path"))
    edges, points = files.spots(spark, f"{root}/*/*/Spots 1.npz")
    tracks = files.tracks_of_spots(edges, points).join(found, "path")
    sinks.displacement_csv(curves.curve_displacements(_placed(tracks, F.concat_ws("_", F.lit("track"), "track_id")), most=most, exclude_ends=exclude_ends), out)


def map_simulated(spark: SparkSession, csv: str, out: str, most: int | None = None, exclude_ends: bool = True) -> None:
    """Displacement table of simulated cells: a second a step, no date, the file as the experiment."""
    t = files.track_csv(spark, csv, "cell_id", "iteration").withColumns({"date": F.lit("000000"), "experiment": F.lit(csv.rstrip("/").rsplit("/", 1)[-1]), "spf": F.lit(1.0)})
    sinks.displacement_csv(curves.curve_displacements(_placed(t, F.col("track_id")), most=most, exclude_ends=exclude_ends), out)


def _placed(tracks: DataFrame, name) -> DataFrame:
    return tracks.select("date", "experiment", name.cast("string").alias("track_id"), "t", *(F.col("pos")[i].alias(c) for i, c in enumerate("xyz")), "spf")


def _kept(spark: SparkSession, csv: str, base: float, timesteps: str | None, simulated: bool) -> DataFrame:
    d = files.displacement_csv(spark, csv)
    return quality.filter_simulated(d) if simulated else quality.filter_displacements(d, base, files.base_timestep_json(spark, timesteps))


def reduce_data(spark: SparkSession, csv: str, out: str, timesteps: str, base: float = 10, most: float = 120) -> None:
    sinks.displacement_csv(_kept(spark, csv, base, timesteps, False).where(F.col("lag") <= most), out)


def analyse(spark: SparkSession, csv: str, out: str, base: int, timesteps: str | None = None, simulated: bool = False) -> None:
    """Tables behind the plots: counts by lag, histograms of each lag shown, means, turning ratios, zero share, frames, and the means file."""
    d = quality.derived(_kept(spark, csv, base, timesteps, simulated)).cache()
    shown, most = LAGS.get(base, OTHER_LAGS)
    tables = {"lags": hist.ordinal_histogram(d, "lag"), "zeros": stats.zero_fraction(d), "turning": stats.turning_ratio(d, most), "frames": stats.frames(d, base)}
    for name in ("disp", "disp_sq", "strt_disp", "strt_disp_sq"):
        tables[f"mean_{name}"] = stats.means(d, "lag", name, most)
    for lag in shown:
        for name in ("disp", "strt_disp"):
            tables[f"{name}_{lag}"] = hist.numeric_histogram(d.where(F.col("lag") == lag), name)
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{out}/{name}")
    sinks.means_csv(stats.time_statistics(d), f"{out}/means{base}.csv", "overwrite")
    d.unpersist()


def fit(spark: SparkSession, csv: str, out: str, base: float = 10, most: float = 120, timesteps: str | None = None, simulated: bool = False, column: str = "disp") -> None:
    """Fits of every lag as JSON, and their curves and parameter series."""
    d = _kept(spark, csv, base, timesteps, simulated)
    samples = stats.samples_over_time(d, column, 1 if simulated else base, 12 if simulated else most).cache()
    fits = fitting.fit_by_lag(samples).cache()
    sinks.fit_json(fits, f"{out}/fits.json", "overwrite")
    fitting.density_curves(fits, samples).write.mode("overwrite").parquet(f"{out}/curves")
    fitting.parameter_series(fits).write.mode("overwrite").parquet(f"{out}/parameters")


def walk(spark: SparkSession, network: str, out: str, cells: int, iterations: int, movement: str, params: Sequence[float], seed: int = 0) -> None:
    """Positions, places in space, coverage by iteration, and metadata of walkers on a network file."""
    nodes, edges = files.graph_text(spark, network)
    positions = simulate.simulate(edges, cells, iterations, movement, tuple(params), seed).cache()
    sinks.positions_csv(positions, f"{out}/positions.csv", "overwrite")
    simulate.xyz(positions, nodes).write.mode("overwrite").parquet(f"{out}/places")
    visits = positions.select("iteration", F.explode(F.array("tail_id", "head_id")).alias("node"))
    sinks.coverage_csv(stats.coverage_curve(visits, iterations, nodes.count()), f"{out}/coverage.csv", "overwrite")
    sinks.metadata(spark, cells, iterations, movement, list(params)).write.mode("overwrite").text(f"{out}/metadata.json")
    positions.unpersist()


def sweep(spark: SparkSession, network: str, out: str, start: int, stop: int, step: int, steps: int = simulate.STEPS, seed: int = 0) -> None:
    """Nodes covered by swarms of growing size."""
    _, edges = files.graph_text(spark, network)
    sinks.coverage_csv(simulate.coverage_sweep(edges, start, stop, step, steps, seed).orderBy("cells"), out, "overwrite")


def adjacency(spark: SparkSession, network: str, out: str) -> None:
    sinks.adjacency_text(graph.adjacency_text(graph.undirected(files.graph_text(spark, network)[1])), out, "overwrite")


def check_surfaces(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Surfaces whose tracks are not among the spots, and tracks without a surface."""
    from trailspark.operators.joins import unclaimed

    paths = files.experiments(spark, root).select(F.explode("surfaces").alias("path")).withColumn("ids", text.track_ids(F.col("path")))
    edges, _ = files.spots(spark, f"{root}/*/*/Spots 1.npz")
    return unclaimed(paths, edges)
