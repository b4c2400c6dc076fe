"""Aggregates of the displacement table by lag, coverage curves and sample selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(col: str) -> Column:
    return F.when(~F.isnan(F.col(col).cast("double")), F.col(col))


def means(df: DataFrame, x: str, y: str, x_max: float | None = None) -> DataFrame:
    """Mean of ``y`` at each distinct ``x`` up to ``x_max``; unknown values are left out."""
    d = df.where(F.col(x).isNotNull())
    d = d if x_max is None else d.where(F.col(x) <= x_max)
    return d.groupBy(x).agg(F.avg(clean(y)).alias("mean"))


def time_statistics(df: DataFrame) -> DataFrame:
    """Means by lag of displacement, its square, and the straight ones: one pass."""
    cols = {"mean_disp": "disp", "mean_disp_sq": "disp_sq", "mean_strt": "strt_disp", "mean_strt_sq": "strt_disp_sq"}
    return df.groupBy("lag").agg(*(F.avg(clean(c)).alias(n) for n, c in cols.items()))


def turning_ratio(df: DataFrame, t_max: float | None = None) -> DataFrame:
    """Share of reversals among known relative directions, by lag; NULL where none is known."""
    d = df if t_max is None else df.where(F.col("lag") <= t_max)
    turned = F.count(F.when(clean("reldir") == -1, 1))
    return d.groupBy("lag").agg(F.try_divide(turned, F.count(clean("reldir"))).alias("ratio"))


def zero_fraction(df: DataFrame, col: str = "disp") -> DataFrame:
    """Zeros, rows, and the percentage to two decimals."""
    zeros, n = F.count(F.when(F.col(col) == 0, 1)), F.count(F.lit(1))
    return df.agg(zeros.alias("zeros"), n.alias("total"), F.round(F.try_divide(zeros * 100.0, n), 2).alias("percent"))


def base_timesteps(df: DataFrame) -> DataFrame:
    """``timestep, experiments``: experiments of each base timestep, in order."""
    return df.groupBy("timestep").agg(F.array_sort(F.collect_set("exp_id")).alias("experiments"))


def centre_of_mass(df: DataFrame, key: Sequence[str], cols: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return df.groupBy(*key).agg(*(F.avg(c).alias(c) for c in cols))


def samples_over_time(df: DataFrame, col: str, step: float, most: float) -> DataFrame:
    """Known values at lags step, 2 step, ... up to ``most``, stopping at the first lag without any."""
    d = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)) & (F.col("lag") <= most) & (F.col("lag") > 0) & (F.try_mod(F.col("lag"), F.lit(float(step))) == 0))
    # the lags are few: the gap check runs on distinct ones
    lags = d.select("lag").distinct().withColumn("k", F.row_number().over(Window.orderBy("lag"))).where(F.col("lag") == F.col("k") * step)
    return d.join(lags.select("lag"), "lag", "left_semi").select("lag", F.col(col).alias("value"))


def frames(df: DataFrame, base: float) -> DataFrame:
    """Frames of an animation over lags: each shows its own lag."""
    return df.where(F.try_mod(F.col("lag"), F.lit(float(base))) == 0).select(F.col("lag").alias("frame_t"), F.col("lag").alias("data_lag")).distinct()


def coverage(visits: DataFrame, node: str = "node", by: Sequence[str] = ()) -> DataFrame:
    """Distinct nodes visited (including where walkers start), by group."""
    return visits.groupBy(*by).agg(F.count_distinct(node).alias("coverage"))


def coverage_curve(visits: DataFrame, iterations: int, n_nodes: int) -> DataFrame:
    """``iteration, covered, coverage``: nodes seen up to each iteration, and their share; the start (iteration 0) doesn't count.

    A node counts in its first iteration (a partial aggregation); the running sum
    is over one row for each iteration, however many visits there are.
    """
    first = visits.where("iteration > 0").groupBy("node").agg(F.min("iteration").alias("iteration")).groupBy("iteration").agg(F.count("*").alias("new"))
    every = visits.sparkSession.range(1, iterations + 1).select(F.col("id").alias("iteration"))
    running = F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(first, "iteration", "left").select("iteration", running.alias("covered")).withColumn("coverage", F.col("covered") / n_nodes)
