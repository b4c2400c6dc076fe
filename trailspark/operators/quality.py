"""Quality filters of the displacement table. Order matters: the track maximum is taken after dates and zeros, before the rest."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import experiment_id

#: Least track displacement (micrometres), points, seconds, seconds of simulated tracks, dates.
DISPLACEMENT, POINTS, DURATION, SIMULATED_DURATION = 30.0, 5, 60.0, 6.0
DATES = ("191205", "191206")
TRACK = ("date", "experiment", "track_id")


def on_dates(df: DataFrame, dates: Iterable[str] = DATES) -> DataFrame:
    return df.where(F.col("date").isin(*dates))


def remove_zeros(df: DataFrame, col: str = "disp") -> DataFrame:
    """Unknown displacements stay."""
    return df.where(~F.col(col).eqNullSafe(F.lit(0.0)))


def moving_tracks(df: DataFrame, threshold: float = DISPLACEMENT, key: Sequence[str] = TRACK) -> DataFrame:
    """Rows of tracks whose largest pair displacement reaches the threshold; NaN and NULL don't count.

    The maximum is a partial aggregation and comes back by a semi-join, so a
    track of many rows isn't sorted in one task. A task holds the keys of its
    tracks. Rows that lie by just the columns of ``key`` are not sent again.
    """
    top = df.groupBy(*key).agg(F.max(F.when(~F.isnan("disp"), F.col("disp"))).alias("top")).where(F.col("top") >= threshold)
    return df.join(top.select(*key).hint("shuffle_hash"), list(key), "left_semi").select(*df.columns)


def long_tracks(df: DataFrame, points: int = POINTS, duration: float = DURATION) -> DataFrame:
    return df.where((F.col("num_points") >= points) & (F.col("duration") >= duration))


def with_experiment_id(df: DataFrame) -> DataFrame:
    """Adds (or recomputes) ``exp_id``."""
    return df.withColumn("exp_id", experiment_id(F.col("date"), F.col("experiment")))


def on_base(df: DataFrame, base: float, base_timesteps: DataFrame) -> DataFrame:
    """Lags that the base divides, of experiments whose own base divides it. ``base_timesteps``: ``timestep, exp_id``, a list of experiments, which is sent whole."""
    fits = base_timesteps.where(F.try_mod(F.lit(float(base)), F.col("timestep")) == 0).select("exp_id").distinct()
    return df.where(F.try_mod(F.col("lag"), F.lit(float(base))) == 0).join(F.broadcast(fits), "exp_id", "left_semi")


def filter_displacements(df: DataFrame, base: float | None = None, base_timesteps: DataFrame | None = None, zeros: bool = True, dates: Iterable[str] = DATES, threshold: float = DISPLACEMENT, key: Sequence[str] = TRACK) -> DataFrame:
    """The whole chain for imaging data."""
    d = on_dates(df, dates)
    d = moving_tracks(d if zeros else remove_zeros(d), threshold, key)
    d = with_experiment_id(long_tracks(d))
    return d if base is None else on_base(d, base, base_timesteps)


def filter_simulated(df: DataFrame, zeros: bool = True) -> DataFrame:
    """For simulated data: no dates, no displacement threshold, a shorter duration."""
    return with_experiment_id(long_tracks(df if zeros else remove_zeros(df), duration=SIMULATED_DURATION))


def derived(df: DataFrame) -> DataFrame:
    """Squares and the signed displacement."""
    return df.withColumns({"disp_sq": F.col("disp") * F.col("disp"), "strt_disp_sq": F.col("strt_disp") * F.col("strt_disp"), "signed_disp": F.col("disp") * F.col("reldir")})


def reduced(df: DataFrame, base_timesteps: DataFrame, base: float = 10, most: float = 120, key: Sequence[str] = TRACK) -> DataFrame:
    """Filtered for one base and cut at a largest lag."""
    return filter_displacements(df, base, base_timesteps, key=key).where(F.col("lag") <= most)


def known(df: DataFrame, col: str) -> DataFrame:
    """Rows whose value is neither NULL nor NaN."""
    return df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))
