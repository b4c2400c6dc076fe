"""Schemas and the header of displacement files; NaN becomes NULL once, at ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header of a displacement file, our column, its type.
DISPLACEMENT_COLUMNS = [
    ("date", "date", "string"),
    ("experiment", "experiment", "string"),
    ("track_name", "track_id", "string"),
    ("time_step", "lag", "double"),
    ("num_points", "num_points", "bigint"),
    ("duration (sec)", "duration", "double"),
    ("curve_displacement (micro-m)", "disp", "double"),
    ("abs_displacement_numeric_error", "disp_err", "double"),
    ("reldir", "reldir", "double"),
    ("straight displacement (micro-m)", "strt_disp", "double"),
]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating-point column with NULL for NaN."""
    kinds = {"double", "float"}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))
