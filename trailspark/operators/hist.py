"""Histograms, rounding and top-k tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_histogram(df: DataFrame, attr: str, group: Sequence[str] = ("date", "experiment")) -> DataFrame:
    """Counts of each group at every distinct known value, zeros included."""
    counts = df.where(F.col(attr).isNotNull()).groupBy(*group, attr).agg(F.count("*").alias("n"))
    # groups x values: both are distinct sets of labels, far smaller than the data
    grid = df.select(*group).distinct().join(counts.select(attr).distinct())
    return grid.join(counts, [*group, attr], "left").select(*group, attr, F.coalesce("n", F.lit(0)).alias("n"))


def stacking_order(hist: DataFrame, group: Sequence[str] = ("date", "experiment")) -> DataFrame:
    """Groups by their number of non-empty bins, most first."""
    return hist.groupBy(*group).agg(F.count(F.when(F.col("n") > 0, 1)).alias("bins")).orderBy(F.desc("bins"), *group)


def bin_index(x: Column, lo: Column, width: Column, bins: int) -> Column:
    """Index of the bin; the largest value falls into the last."""
    return F.least(F.floor((x - lo) / width), F.lit(bins - 1))


def numeric_histogram(df: DataFrame, attr: str, bins: int = 30, group: Sequence[str] = ("exp_id",)) -> DataFrame:
    """Dense counts of each group in equal bins between the extremes of all rows; no rows where the width is zero.

    Extremes are one row and go to all tasks.
    """
    d = df.where(F.col(attr).isNotNull() & ~F.isnan(F.col(attr).cast("double")))
    ends = d.agg(F.min(attr).alias("lo"), F.max(attr).alias("hi")).where("hi > lo").select("lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"))
    counts = d.join(F.broadcast(ends)).groupBy(*group, bin_index(F.col(attr), F.col("lo"), F.col("width"), bins).alias("bin")).agg(F.count("*").alias("n"))
    ticks = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    grid = d.select(*group).distinct().join(F.broadcast(ticks)).join(F.broadcast(ends))
    return grid.join(counts, [*group, "bin"], "left").select(*group, "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def density_histogram(df: DataFrame, attr: str, bins: int = 50, by: Sequence[str] = ("lag",)) -> DataFrame:
    """Densities in equal bins between the extremes of each group: count / (n width) at bin centres, zeros included."""
    d = df.where(F.col(attr).isNotNull() & ~F.isnan(F.col(attr)))
    ends = d.groupBy(*by).agg(F.min(attr).alias("lo"), F.max(attr).alias("hi"), F.count("*").alias("total")).where("hi > lo")
    ends = ends.select(*by, "lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"), "total")
    counts = d.join(ends, list(by)).groupBy(*by, bin_index(F.col(attr), F.col("lo"), F.col("width"), bins).alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("x"), (F.coalesce("n", F.lit(0)) / (F.col("total") * F.col("width"))).alias("density"))


def half_open_histogram(df: DataFrame, attr: str, bins: int) -> DataFrame:
    """Counts in bins ``(lo, hi]`` by upper edge; empty bins have no row. The least value falls into the first."""
    d = df.where(F.col(attr).isNotNull())
    ends = d.agg(F.min(attr).alias("lo"), F.max(attr).alias("hi")).where("hi > lo").select("lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"))
    k = F.least(F.greatest(F.ceil((F.col(attr) - F.col("lo")) / F.col("width")), F.lit(1)), F.lit(bins))
    return d.join(F.broadcast(ends)).groupBy(k.alias("bucket"), (F.col("lo") + k * F.col("width")).alias("upper")).agg(F.count("*").alias("n"))


def nearest_multiple(x: Column, n: Column | int, tie: Column | None = None) -> Column:
    """Nearest multiple of ``n``; an exact tie goes down, or up where ``tie`` holds (a hash, for a random choice)."""
    n = n if isinstance(n, Column) else F.lit(n)
    low = F.floor(x / n) * n
    rest = x - low
    up = rest - n / 2 > 1e-13 if tie is None else (rest - n / 2 > 1e-13) | ((F.abs(rest - n / 2) <= 1e-13) & tie)
    return F.when(up, low + n).otherwise(low)


def top_rounded(df: DataFrame, attr: str, k: int, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent rounded values (of each group); ties go to the smaller value."""
    counts = df.where(F.col(attr).isNotNull()).groupBy(*by, nearest_multiple(F.col(attr), n).alias("rounded")).agg(F.count("*").alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), "rounded").limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "rounded"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def rounding_sweep(df: DataFrame, attr: str, k: int, most: int = 10, by: Sequence[str] = ("lag",)) -> DataFrame:
    """``top_rounded`` for multiples of 1 to ``most``: values are counted once, then rounded for each multiple."""
    base = df.where(F.col(attr).isNotNull()).groupBy(*by, attr).agg(F.count("*").alias("c"))
    every = base.withColumn("multiple", F.explode(F.sequence(F.lit(1), F.lit(most))))
    counts = every.groupBy(*by, "multiple", nearest_multiple(F.col(attr), F.col("multiple")).alias("rounded")).agg(F.sum("c").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by, "multiple").orderBy(F.desc("n"), "rounded"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
