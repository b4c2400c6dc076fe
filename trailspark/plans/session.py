"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers.

    Where workers already find it (``PYTHONPATH`` names its root, as with an
    installed package) nothing is done; otherwise the sources go through Spark's
    own file distribution, once per application.
    """
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    context = spark.sparkContext
    if getattr(context, "_trailspark_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp(prefix="trailspark-")) / "trailspark_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "trailspark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(path))
    context._trailspark_shipped = True
    return spark
