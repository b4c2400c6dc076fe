"""Maximum likelihood over all values of every lag, as sums that tasks add up.

The values of all lags stay where they are, as (lag, value, n). A fit is a walk of
trial points on the driver, one small state for each lag and family; in every pass
all walks name their next point together, tasks sum log-likelihood, gradient and
Hessian of their own values at these points, and one row a walk comes back. So no
lag is in one task, and a pass is one scan of the values whatever the number of
fits. The driver holds lags x families rows, and 50 bins a lag.

Nulls and NaN are left out. A lag with fewer than five values, or of one value,
has no fit. Starts and limits are those of the lag's own spread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Passes of one fit at most; as a share of the spread, how close a location comes to the outermost value.
PASSES, CLOSEST = 100, 1e-9

Walk = Generator[np.ndarray, tuple, tuple]


def counted(samples: DataFrame) -> DataFrame:
    """``lag, value, n``: distinct values with counts."""
    s = samples.select(F.col("lag").cast("double").alias("lag"), F.col("value").cast("double").alias("value"))
    return s.where("lag is not null and value is not null and not isnan(value)").groupBy("lag", "value").agg(F.count("*").cast("double").alias("n"))


def summaries(values: DataFrame) -> dict[float, dict]:
    """Of each lag: n, mean, sd, lo, hi."""
    mean = F.sum(F.col("n") * F.col("value")) / F.sum("n")
    first = values.groupBy("lag").agg(F.sum("n").alias("n"), mean.alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    spread = values.join(first.select("lag", "mean"), "lag").groupBy("lag").agg((F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2) / F.sum("n")).alias("var"))
    return {r["lag"]: {"n": r["n"], "mean": r["mean"], "lo": r["lo"], "hi": r["hi"], "sd": math.sqrt(max(r["var"], 0.0))} for r in first.join(spread, "lag").collect()}


def lockstep(walks: dict, evaluate: Callable[[dict], dict]) -> dict:
    """Runs generators that name a point and get its evaluation; those still running are evaluated together. Their results by key."""
    done = {}
    asked = {k: next(w) for k, w in walks.items()}
    while asked:
        told, following = evaluate(asked), {}
        for k in asked:
            try:
                following[k] = walks[k].send(told[k])
            except StopIteration as e:
                done[k] = e.value
        asked = following
    return done


def partial_sums(values: DataFrame, points: dict[float, list[tuple]], sums: Callable[[tuple, np.ndarray, np.ndarray], np.ndarray], width: int) -> dict:
    """``sums(point, value, n)`` over all values of a lag, by key, for its (key, point) pairs: each task sums its own values, and its sums are added."""
    keys = [k for of_lag in points.values() for k, _ in of_lag]
    number, names = {k: i for i, k in enumerate(keys)}, [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            lags, value, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for lag in np.unique(lags).tolist():
                here = lags == lag
                for key, point in points.get(lag, ()):
                    with np.errstate(all="ignore"):
                        s = sums(point, value[here], n[here])
                    k = number[key]
                    got[k] = got[k] + s if k in got else s
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), *(pa.array(c, pa.float64()) for c in np.stack(list(got.values())).T)], ["walk", *names])

    rows = values.select("lag", "value", "n").mapInArrow(run, "walk long, " + ", ".join(f"{c} double" for c in names)).groupBy("walk").agg(*[F.expr(f"sum({c})") for c in names]).collect()
    return {keys[r[0]]: np.array(r[1:], float) for r in rows}


def inline(spark: SparkSession, rows: list[tuple], columns: tuple) -> DataFrame:
    """A few rows of numbers as a local relation."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"{float(v)!r}D" for v in r) + ")" for r in rows) + f" AS t({', '.join(columns)})")


def newton(start: np.ndarray, edge: tuple[int, float, float] | None = None, passes: int = PASSES, tol: float = 1e-13) -> Walk:
    """A walk uphill by Newton steps within a radius; told (value, gradient, Hessian) of a mean. Returns (point, value, passes).

    ``edge``: an index, a limit that this coordinate stays below, and the least
    distance. A step covers nineteen twentieths of the way to it at most, and at
    the least distance the coordinate rests while it is pushed outwards.
    """
    at, value, radius, step = np.asarray(start, float), -math.inf, 1.0, None
    trial = at
    grad = hess = None
    for k in range(passes):
        v, g, h = yield trial
        if not (math.isfinite(v) and np.isfinite(g).all() and np.isfinite(h).all()):
            v = -math.inf
        if v > value:
            if step is not None and np.abs(step).max() >= 0.99 * radius:
                radius = min(2 * radius, 8.0)
            at, value, grad, hess = trial, v, g, h
        elif step is None:
            return at, -math.inf, k + 1
        else:
            radius = np.abs(step).max() / 4
        free = np.ones(len(at), bool)
        if edge is not None and edge[1] - at[edge[0]] <= 1.001 * edge[2] and grad[edge[0]] > 0:
            free[edge[0]] = False
        step = np.zeros(len(at))
        w, q = np.linalg.eigh(-hess[np.ix_(free, free)])
        step[free] = q @ ((q.T @ grad[free]) / np.maximum(np.abs(w), 1e-10))
        step *= min(1.0, radius / max(np.abs(step).max(), 1e-300))
        gain = float(grad @ step)
        if gain <= tol * max(1.0, abs(value)) or radius < 1e-10:
            return at, value, k + 1
        trial = at + step
        if edge is not None:
            i, limit, least = edge
            trial[i] = min(trial[i], limit - max(0.05 * (limit - at[i]), least))
            step = trial - at
    return at, value, passes


def curvature(f: Callable[[float], float], x: float) -> tuple[float, float, float]:
    """f, f' and f'' of a smooth function of one number above 0."""
    h = 1e-3 * x
    # five points: errors of the fourth order
    a, b, c, d, e = (f(x + k * h) for k in (-2, -1, 0, 1, 2))
    return c, (a - 8 * b + 8 * d - e) / (12 * h), (-a + 16 * b - 30 * c + 16 * d - e) / (12 * h * h)


def shape_terms(family: str, shape: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """What a log density has of its shapes alone: value, gradient, and diagonal of the Hessian."""
    if family == "levy" or family == "levy_l":
        return -0.5 * math.log(2 * math.pi), np.zeros(0), np.zeros(0)
    if family == "foldnorm":
        c = float(shape[0])
        return 0.5 * math.log(2 / math.pi) - math.log(2) - c * c / 2, np.array([-c]), np.array([-1.0])
    if family == "halfgennorm":
        v, g, h = curvature(lambda b: math.log(b) - math.lgamma(1 / b), float(shape[0]))
    else:
        v, g, h = curvature(lambda a: -math.lgamma(a), float(shape[0]))
    if family == "gengamma":
        c = float(shape[1])
        return v + math.log(c), np.array([g, 1 / c]), np.array([h, -1 / (c * c)])
    return v, np.array([g]), np.array([h])


def value_terms(family: str, shape: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rest at v > 0: q, q', q'', then for each shape its derivatives q_a, q_aa, q_a', and q_ab of two."""
    one, log = np.ones_like(v), np.log(v)
    if family in ("levy", "levy_l"):
        return -1 / (2 * v) - 1.5 * log, 1 / (2 * v * v) - 1.5 / v, -1 / v**3 + 1.5 / (v * v)
    if family == "foldnorm":
        c = shape[0]
        t = np.tanh(c * v)
        s = 1 - t * t
        return np.logaddexp(c * v, -c * v) - v * v / 2, c * t - v, c * c * s - one, v * t, v * v * s, t + c * v * s
    if family == "gamma":
        a = shape[0]
        return (a - 1) * log - v, (a - 1) / v - 1, (1 - a) / (v * v), log, 0 * one, 1 / v
    if family == "invgamma":
        a = shape[0]
        return -(a + 1) * log - 1 / v, 1 / (v * v) - (a + 1) / v, (a + 1) / (v * v) - 2 / v**3, -log, 0 * one, -1 / v
    if family == "halfgennorm":
        b = shape[0]
        p = v**b
        return -p, -b * p / v, -b * (b - 1) * p / (v * v), -p * log, -p * log * log, -(p / v) * (1 + b * log)
    if family == "gengamma":
        a, c = shape
        p = v**c
        return (c * a - 1) * log - p, (c * a - 1) / v - c * p / v, (1 - c * a) / (v * v) - c * (c - 1) * p / (v * v), c * log, 0 * one, c / v, (a - p) * log, -p * log * log, (a - p - c * p * log) / v, log
    raise ValueError(f"unknown family {family}")


#: Sums of q, q', yq', q'', yq'', yyq'', and for two shapes q_a, q_aa, q_a', yq_a'; last q_ab.
SUMS = 15


def family_sums(point: tuple, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    family, shape, loc, scale = point
    y = ((loc - x) if family == "levy_l" else (x - loc)) / scale
    out = np.zeros(SUMS)
    with np.errstate(all="ignore"):
        t = value_terms(family, shape, y)
        out[:6] = [n @ t[0], n @ t[1], n @ (y * t[1]), n @ t[2], n @ (y * t[2]), n @ (y * y * t[2])]
        for k in range(len(shape)):
            a, aa, ay = t[3 + 3 * k : 6 + 3 * k]
            out[6 + 4 * k : 10 + 4 * k] = [n @ a, n @ aa, n @ ay, n @ (y * ay)]
        if len(shape) == 2:
            out[14] = n @ t[9]
    return out


#: Number of shapes of each family.
SHAPES = {"levy_l": 0, "levy": 0, "foldnorm": 1, "halfgennorm": 1, "gamma": 1, "gengamma": 2, "invgamma": 1}


def plain(family: str, point: np.ndarray, spread: float) -> tuple[np.ndarray, float, float]:
    """(shapes, location, scale) of a walk's point: shapes as logarithms (but of the folded normal), the location up to its sign in spreads, the logarithm of the scale in spreads."""
    *shape, loc, scale = point
    shape = np.asarray(shape, float)
    return shape if family == "foldnorm" else np.exp(shape), float(-loc if family == "levy_l" else loc) * spread, math.exp(min(scale, 700.0)) * spread


def assembled(family: str, point: np.ndarray, spread: float, n: float, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood, its gradient and Hessian in a walk's coordinates."""
    shape, _, scale = plain(family, point, spread)
    k, unit = len(shape), spread / scale  # y falls by this for each spread that the location moves
    s = sums / n
    c, cg, ch = shape_terms(family, shape)
    g, h = np.zeros(k + 2), np.zeros((k + 2, k + 2))
    g[k], g[k + 1] = -unit * s[1], -1 - s[2]
    h[k, k], h[k, k + 1], h[k + 1, k + 1] = unit * unit * s[3], unit * (s[1] + s[4]), s[2] + s[5]
    for i in range(k):
        a, aa, ay, yay = s[6 + 4 * i : 10 + 4 * i]
        g[i], h[i, i], h[i, k], h[i, k + 1] = cg[i] + a, ch[i] + aa, -unit * ay, -yay
    if k == 2:
        h[0, 1] = s[14]
    if family != "foldnorm":
        h[np.arange(k), np.arange(k)] = shape * shape * h.diagonal()[:k] + shape * g[:k]
        h[:k, k:] *= shape[:, None]
        if k == 2:
            h[0, 1] *= shape[0] * shape[1]
        g[:k] *= shape
    h = np.triu(h) + np.triu(h, 1).T
    return float(c - math.log(scale) + s[0]), g, h


def fit_families(values: DataFrame, families: list[str], about: dict[float, dict]) -> dict[tuple[float, str], list[float] | None]:
    """Parameters (shapes, location, scale) by lag and family, from ``values (lag, value, n)``; None where no start has a finite likelihood."""
    walks, units = {}, {}
    for lag, a in about.items():
        spread = a["sd"]
        for family in families:
            outer = (-a["hi"] if family == "levy_l" else a["lo"]) / spread
            for run, first in enumerate((1.0, 2.0) if SHAPES[family] else (1.0,)):
                shape = [first if family == "foldnorm" else math.log(first)] * SHAPES[family]
                walks[lag, family, run] = newton(np.array([*shape, outer - 0.05, 0.0]), (SHAPES[family], outer, CLOSEST))
                units[lag, family, run] = (spread, a["n"])
    if not walks:
        return {}

    def evaluate(asked: dict) -> dict:
        points: dict[float, list] = {}
        for (lag, family, run), p in asked.items():
            points.setdefault(lag, []).append(((lag, family, run), (family, *plain(family, p, units[lag, family, run][0]))))
        told = partial_sums(values, points, family_sums, SUMS)
        with np.errstate(all="ignore"):
            return {k: assembled(k[1], p, *units[k], told[k]) for k, p in asked.items()}

    found: dict[tuple[float, str], tuple] = {}
    for (lag, family, run), (point, value, _) in lockstep(walks, evaluate).items():
        if value > found.get((lag, family), (None, -math.inf))[1]:
            shape, loc, scale = plain(family, point, units[lag, family, run][0])
            found[lag, family] = ([*map(float, shape), loc, scale], value)
    return {(lag, family): found.get((lag, family), (None,))[0] for lag in about for family in families}
