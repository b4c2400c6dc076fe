"""Path and name functions of the data directory: ``.../<date>/<experiment>/<file>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(parts(path), -1), r"\.[^.]*$", "")


def track_ids(path: Column) -> Column:
    """Digit-only parts of a surface's file name: the tracks it belongs to."""
    return F.transform(F.filter(F.split(file_stem(path), "_"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))


def experiment(path: Column) -> Column:
    """STRUCT(date, experiment) from the last two directories."""
    return F.struct(F.try_element_at(parts(path), F.lit(-3)).alias("date"), F.try_element_at(parts(path), F.lit(-2)).alias("experiment"))


def track_name(directory: Column, track: Column) -> Column:
    return F.concat(directory, F.lit("_"), track.cast("string"))


def time_tag(at: Column | None = None) -> Column:
    """Prefix of output names."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyMMdd-HHmm")


def experiment_id(date: Column, exp: Column) -> Column:
    """NULL where either part is."""
    return F.concat(date, F.lit("/"), exp)
