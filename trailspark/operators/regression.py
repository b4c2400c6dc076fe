"""Polynomial least squares of every group at once, from power sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polynomials(points: DataFrame, key: Sequence[str], at: str, cols: Sequence[str], degree: int = 1) -> DataFrame:
    """``key, n, <col>_coef..``: coefficients by rising power of ``at``, of the polynomial that fits each column best.

    ``at`` is mapped to [-1, 1] by its extremes in the group, and powers and their
    products with the columns are partial sums, so a group is never in one place;
    the small system of each group is solved a row at a time. Groups with fewer
    distinct values of ``at`` than coefficients have NULL. Rows with a null are left out.
    """
    p = points.where(" and ".join(f"{c} is not null" for c in (at, *cols))).select(*key, F.col(at).cast("double").alias("_t"), *[F.col(c).cast("double").alias(f"_{c}") for c in cols])
    ends = p.groupBy(*key).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    u = F.when(F.col("_hi") > F.col("_lo"), (2 * F.col("_t") - F.col("_lo") - F.col("_hi")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    d = p.join(ends, list(key)).withColumn("_u", u)
    power = lambda k: F.lit(1.0) if not k else F.pow("_u", F.lit(float(k)))
    sums = [F.sum(power(k)).alias(f"_s{k}") for k in range(2 * degree + 1)] + [F.sum(power(k) * F.col(f"_{c}")).alias(f"_{c}_{k}") for c in cols for k in range(degree + 1)]
    rows = d.groupBy(*key).agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), *sums)
    kinds = dict(rows.dtypes)
    spec = ", ".join(f"{k} {kinds[k]}" for k in key) + ", n long, " + ", ".join(f"{c}_coef array<double>" for c in cols)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            lo, hi = get("_lo"), get("_hi")
            powers = np.stack([get(f"_s{k}") for k in range(2 * degree + 1)], 1)
            grid = powers[:, np.add.outer(np.arange(degree + 1), np.arange(degree + 1))]
            out = []
            for c in cols:
                sides = np.stack([get(f"_{c}_{k}") for k in range(degree + 1)], 1)
                coef = []
                for g, s, a, z in zip(grid, sides, lo, hi, strict=True):
                    if (degree and z <= a) or np.linalg.matrix_rank(g) <= degree:
                        coef.append(None)
                        continue
                    # from powers of u to powers of t
                    q = np.polynomial.Polynomial(np.linalg.solve(g, s))
                    q = q(np.polynomial.Polynomial([-(a + z) / (z - a), 2 / (z - a)])) if degree else q
                    coef.append(np.pad(q.coef, (0, degree + 1 - len(q.coef))).tolist())
                out.append(pa.array(coef, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in (*key, "n")), *out], [*key, "n", *(f"{c}_coef" for c in cols)])

    return rows.mapInArrow(solve, spec)


def lines(points: DataFrame, key: Sequence[str], at: str, col: str) -> DataFrame:
    """``key, slope, intercept``, built-in aggregates only; NULL for a group without two values of ``at``."""
    return points.groupBy(*key).agg(F.regr_slope(col, at).alias("slope"), F.regr_intercept(col, at).alias("intercept"))
