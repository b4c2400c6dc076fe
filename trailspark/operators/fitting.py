"""Distribution fits by lag: maximum likelihood with free location and scale, folded normals, and their mixture.

The fits are sums over all values of all lags at once (``likelihood``,
``mixture``); goodness of fit is the squared error against a histogram. ``s`` of
folded normals is a variance. A fit that fails has NULL parameters. Components of
a mixture come with m1 >= m2 and as (p, m1, s1, m2, s2).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import likelihood
from .mixture import fit_mixtures

BINS = 50
#: Family of each candidate, as the fit tables name them (fixed values).
STABLE = {"levy_leftskewed": "levy_l", "levy": "levy", "folded_normal": "foldnorm", "folded_cauchy": "foldnorm", "half_generic_normal": "halfgennorm"}
GAMMA = {"gamma": "gamma", "generic_gamma": "gengamma", "inverse_gamma": "invgamma"}
SPEC = "lag double, dist string, params array<double>, sse double, sse_nbins int"


def log_folded(x: np.ndarray, m: float, s: float) -> np.ndarray:
    """Log density of |N(m, s)|, safe in the tails."""
    s = abs(s) + 1e-300
    return np.logaddexp(-((x - m) ** 2) / (2 * s), -((x + m) ** 2) / (2 * s)) - 0.5 * math.log(2 * math.pi * s)


def log_density(family: str, params: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log density with parameters shapes..., loc, scale; -inf off the support or for bad parameters."""
    *shape, loc, scale = params
    if scale <= 0:
        return np.full(len(x), -np.inf)
    y = (x - loc) / scale
    y = -y if family == "levy_l" else y
    if shape and min(shape) <= 0 and family != "foldnorm":
        return np.full(len(x), -np.inf)
    ok = y >= 0 if family in ("foldnorm", "halfgennorm") else y > 0
    v = np.where(ok, y, 1.0)
    if family in ("levy", "levy_l"):
        out = -1 / (2 * v) - 0.5 * np.log(2 * math.pi * v**3)
    elif family == "foldnorm":
        c = shape[0]
        out = 0.5 * math.log(2 / math.pi) + np.logaddexp(c * v, -c * v) - math.log(2) - (v * v + c * c) / 2
    elif family == "halfgennorm":
        b = shape[0]
        out = math.log(b) - math.lgamma(1 / b) - v**b
    elif family == "gamma":
        out = (shape[0] - 1) * np.log(v) - v - math.lgamma(shape[0])
    elif family == "gengamma":
        a, c = shape
        out = math.log(abs(c)) + (c * a - 1) * np.log(v) - v**c - math.lgamma(a)
    elif family == "invgamma":
        out = (-shape[0] - 1) * np.log(v) - 1 / v - math.lgamma(shape[0])
    else:
        raise ValueError(f"unknown family {family}")
    return np.where(ok, out, -np.inf) - math.log(scale)


def mixture_density(params, x: np.ndarray) -> np.ndarray:
    p, m1, s1, m2, s2 = params
    return p * np.exp(log_folded(x, m1, s1)) + (1 - p) * np.exp(log_folded(x, m2, s2))


def density_bins(values: DataFrame, about: dict[float, dict], bins: int) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """Of each lag, centres and densities of equal bins, the last closed."""
    if not about:
        return {}
    small = likelihood.inline(values.sparkSession, [(lag, a["lo"], (a["hi"] - a["lo"]) / bins) for lag, a in about.items()], ("lag", "lo", "w"))
    bin_ = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int").alias("bin")
    counts = {lag: np.zeros(bins) for lag in about}
    for r in values.join(F.broadcast(small), "lag").groupBy("lag", bin_).agg(F.sum("n").alias("n")).collect():
        counts[r["lag"]][r["bin"]] = r["n"]
    out = {}
    for lag, n in counts.items():
        w = (about[lag]["hi"] - about[lag]["lo"]) / bins
        out[lag] = about[lag]["lo"] + (np.arange(bins) + 0.5) * w, n / (n.sum() * w)
    return out


def fit_by_lag(samples: DataFrame, candidates: dict[str, str] | None = None, bins: int = BINS, mixture: bool = True) -> DataFrame:
    """``lag, dist, params, sse, sse_nbins`` of ``samples (lag, value)``; all values of all lags, a row a lag and candidate."""
    spark, names = samples.sparkSession, {**STABLE, **GAMMA} if candidates is None else candidates
    values = likelihood.counted(samples).persist()
    try:
        every = likelihood.summaries(values)
        about = {lag: a for lag, a in every.items() if a["n"] >= 5 and a["hi"] > a["lo"] and a["sd"] > 0}
        fits = likelihood.fit_families(values, list(dict.fromkeys(names.values())), about)
        mixtures = fit_mixtures(values, about, bins) if mixture else {}
        seen = density_bins(values, about, bins)
    finally:
        values.unpersist()

    def row(lag: float, name: str, params, density) -> tuple:
        if params is None:
            return lag, name, None, None, bins
        at, y = seen[lag]
        with np.errstate(all="ignore"):
            return lag, name, params, float(((y - density(at)) ** 2).sum()), bins

    rows = [row(lag, name, p := fits.get((lag, family)), lambda at, f=family, p=p: np.exp(log_density(f, np.asarray(p), at))) for lag in every for name, family in names.items()]
    if mixture:
        rows += [row(lag, "folded_normal_mixture", p := mixtures.get(lag), lambda at, p=p: mixture_density(p, at)) for lag in every]
    return spark.createDataFrame(rows, SPEC)


def parameter_series(fits: DataFrame) -> DataFrame:
    """``dist, index, lag, value``: each parameter over lags."""
    return fits.select("dist", "lag", F.posexplode("params").alias("index", "value")).orderBy("dist", "index", "lag")


def density_curves(fits: DataFrame, samples: DataFrame, families: dict[str, str] | None = None, n: int = 100, margin: float = 0.1) -> DataFrame:
    """``lag, dist, x, density`` on ``n`` points over each lag's range, a little wider."""
    families = {**STABLE, **GAMMA} if families is None else families
    ends = samples.groupBy("lag").agg((F.min("value") - margin).alias("lo"), (F.max("value") + margin).alias("hi"))
    spec = "lag double, dist string, x double, density double"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.params is None:
                    continue
                at, p = np.linspace(r.lo, r.hi, n), np.asarray(r.params, float)
                y = mixture_density(p, at) if r.dist == "folded_normal_mixture" else np.exp(log_density(families[r.dist], p, at))
                rows += [(r.lag, r.dist, x, v) for x, v in zip(at.tolist(), y.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["lag", "dist", "x", "density"])

    return fits.join(ends, "lag").mapInPandas(run, spec)
