"""Mixtures of two folded normals for every lag: EM by sufficient statistics, and Newton steps.

A folded normal is a normal whose sign is hidden, so EM hides two things: which
component a value is of, and its sign. Both expectations are expressions of one
value and the lag's five parameters; the maximisation is then in closed form, and
an iteration is one aggregation of all lags that runs in built-in functions.
Squared extrapolation takes the steps that plain EM would take slowly.

Newton steps need the gradient and the observed information, twenty more sums that
tasks take of their own values; the 5 x 5 systems are solved on the driver, a row
a lag.

Parameters are (p, m1, s1, m2, s2), ``s`` variances, m1 >= m2 >= 0; equal means in the order of their variances. Variances stay
above ``LEAST`` of a lag's mean square, as the likelihood has no bound where many
values are equal.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .likelihood import Walk, inline, lockstep, newton, partial_sums

LEAST, EM_FIRST = 1e-9, 8
PARAMS = ("p", "m1", "s1", "m2", "s2")


#: Log density of |N(m, s)| at x >= 0, for m >= 0.
LOG_FOLDED = "log1p(exp(-2 * {m} * x / {s})) - (x - {m}) * (x - {m}) / (2 * {s}) - 0.5 * log(2 * pi() * {s})"


def em_sums(values: DataFrame, points: dict[float, np.ndarray]) -> dict[float, dict]:
    """By lag: n, the log-likelihood, and the expectations that the maximisation needs, at the lag's parameters (a row a lag)."""
    small = inline(values.sparkSession, [(lag, *p) for lag, p in points.items()], ("lag", *PARAMS))
    d = values.selectExpr("lag", "abs(value) AS x", "n").join(F.broadcast(small), "lag")
    d = d.selectExpr("lag", "n", "x", "log(p) + " + LOG_FOLDED.format(m="m1", s="s1") + " AS a", "log1p(-p) + " + LOG_FOLDED.format(m="m2", s="s2") + " AS b", "x * tanh(m1 * x / s1) AS x1", "x * tanh(m2 * x / s2) AS x2")
    # a member of the first component with odds exp(a - b)
    d = d.selectExpr("lag", "n", "x", "x1", "x2", "greatest(a, b) + log1p(exp(-abs(a - b))) AS l", "n / (1 + exp(b - a)) AS g", "n / (1 + exp(a - b)) AS h")
    sums = ("sum(n) AS n", "sum(n * l) AS l", "sum(g) AS g", "sum(h) AS h", "sum(g * x1) AS gx", "sum(h * x2) AS hx", "sum(g * x * x) AS gxx", "sum(h * x * x) AS hxx")
    return {r["lag"]: r.asDict() for r in d.groupBy("lag").agg(*map(F.expr, sums)).collect()}


def maximised(r: dict, floor: float) -> np.ndarray:
    """The parameters that the expected memberships and signs give."""
    m1, m2 = r["gx"] / max(r["g"], 1e-300), r["hx"] / max(r["h"], 1e-300)
    s1, s2 = r["gxx"] / max(r["g"], 1e-300) - m1 * m1, r["hxx"] / max(r["h"], 1e-300) - m2 * m2
    return np.array([min(max(r["g"] / r["n"], 1e-9), 1 - 1e-9), m1, max(s1, floor), m2, max(s2, floor)])


def within(p: np.ndarray, floor: float) -> np.ndarray:
    return np.array([min(max(p[0], 1e-9), 1 - 1e-9), abs(p[1]), max(p[2], floor), abs(p[3]), max(p[4], floor)])


def em_walk(start: np.ndarray, floor: float, tol: float, passes: int) -> Walk:
    """EM with squared extrapolation; told the sums at a point. Returns (parameters, mean log-likelihood, passes)."""
    at, k = within(start, floor), 0
    r = yield at
    k += 1
    while True:
        one = maximised(r, floor)
        if k >= passes or np.abs(one - at).max() <= tol * max(1.0, np.abs(at).max()):
            return one, r["l"] / r["n"], k
        r1 = yield one
        two = maximised(r1, floor)
        d, v = one - at, (two - one) - (one - at)
        size = np.linalg.norm(d) / max(np.linalg.norm(v), 1e-300)
        far = within(at + 2 * size * d + size * size * v, floor) if size > 1 else two
        r = yield far
        k += 2
        if not r["l"] >= r1["l"]:  # the leap went too far (or is no number): go on from where EM itself goes
            far = two
            r = yield far
            k += 1
        at = far


def newton_sums(point: tuple, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the log-likelihood, the five scores and the upper triangle of second derivatives."""
    p, m1, s1, m2, s2 = point
    x = np.abs(value)
    parts = []
    for share, m, s in ((p, m1, s1), (1 - p, m2, s2)):
        t = np.tanh(m * x / s)
        bend, away, square = 1 - t * t, x * t - m, x * x + m * m - 2 * m * x * t
        log = math.log(share) + np.log1p(np.exp(-2 * m * x / s)) - (x - m) ** 2 / (2 * s) - 0.5 * math.log(2 * math.pi * s)
        parts.append((log, away / s, square / (2 * s * s) - 0.5 / s, x * x * bend / s**2 - 1 / s, -away / s**2 - m * x * x * bend / s**3, 0.5 / s**2 - square / s**3 + (m * x) ** 2 * bend / s**4))
    (a, um1, us1, mm1, ms1, ss1), (b, um2, us2, mm2, ms2, ss2) = parts
    whole = np.logaddexp(a, b)
    g, h = np.exp(a - whole), np.exp(b - whole)
    both, sp = g * h, g / p - h / (1 - p)
    upper = (
        -sp * sp, g * um1 * (1 / p - sp), g * us1 * (1 / p - sp), -h * um2 * (1 / (1 - p) + sp), -h * us2 * (1 / (1 - p) + sp),
        g * mm1 + both * um1 * um1, g * ms1 + both * um1 * us1, -both * um1 * um2, -both * um1 * us2,
        g * ss1 + both * us1 * us1, -both * us1 * um2, -both * us1 * us2,
        h * mm2 + both * um2 * um2, h * ms2 + both * um2 * us2, h * ss2 + both * us2 * us2,
    )
    return np.array([n @ v for v in (whole, sp, g * um1, g * us1, h * um2, h * us2, *upper)])


def free(p: np.ndarray, unit: float) -> np.ndarray:
    """Coordinates without bounds: the logit of p, means in units, logarithms of variances in squared units."""
    return np.array([math.log(p[0] / (1 - p[0])), p[1] / unit, math.log(p[2] / unit**2), p[3] / unit, math.log(p[4] / unit**2)])


def bound(z: np.ndarray, unit: float) -> np.ndarray:
    e = np.exp(np.clip(z, -700, 700))
    return np.array([1 / (1 + math.exp(-min(max(z[0], -20.0), 20.0))), abs(z[1]) * unit, max(e[2], LEAST) * unit**2, abs(z[3]) * unit, max(e[4], LEAST) * unit**2])


def in_free(sums: np.ndarray, z: np.ndarray, unit: float, n: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood, gradient and Hessian in coordinates without bounds."""
    p = bound(z, unit)
    g, h = sums[1:6] / n, np.zeros((5, 5))
    h[np.triu_indices(5)] = sums[6:] / n
    h = h + np.triu(h, 1).T
    first = np.array([p[0] * (1 - p[0]), math.copysign(unit, z[1]), p[2], math.copysign(unit, z[3]), p[4]])
    second = np.array([p[0] * (1 - p[0]) * (1 - 2 * p[0]), 0.0, p[2], 0.0, p[4]])
    return float(sums[0] / n), g * first, h * np.outer(first, first) + np.diag(g * second)


def ordered(p: np.ndarray) -> list[float]:
    """The larger mean first. A mean under a hundredth of its standard deviation can't be told from 0 and is 0; equal means: the larger variance first."""
    share, *parts = map(float, p)
    m1, m2 = (0.0 if m < 0.01 * math.sqrt(s) else m for m, s in (parts[:2], parts[2:]))
    return [share, m1, parts[1], m2, parts[3]] if (m1, parts[1]) >= (m2, parts[3]) else [1 - share, m2, parts[3], m1, parts[1]]


def starts(values: DataFrame, about: dict[float, dict], bins: int) -> dict[float, np.ndarray]:
    """What the first bin holds above the second is one component, the rest the other, each by its moments.

    Each value of the first bin gives the excess its share. Where there is no
    excess, bins are tried three quarters as many; at two the lag is halved.
    """
    left, found = dict.fromkeys(about, bins), {}
    while left:
        small = inline(values.sparkSession, [(lag, about[lag]["lo"], (about[lag]["hi"] - about[lag]["lo"]) / k, k) for lag, k in left.items()], ("lag", "lo", "w", "k"))
        x, bin_ = F.col("value"), F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.col("k") - 1)
        d = values.join(F.broadcast(small), "lag").withColumn("bin", bin_).groupBy("lag").agg(
            *[F.sum(F.when(F.col("bin") == b, F.col("n") * v).otherwise(0.0)).alias(f"{name}{b}") for b in (0, 1) for name, v in (("n", F.lit(1.0)), ("x", F.abs(x)), ("xx", x * x))],
            F.sum("n").alias("n"), F.sum(F.col("n") * F.abs(x)).alias("x"), F.sum(F.col("n") * x * x).alias("xx"),
        )
        for r in d.collect():
            lag, k, excess = r["lag"], left[r["lag"]], r["n0"] - r["n1"]
            if excess >= 2 and r["n"] - excess >= 2:
                share = excess / r["n0"]
                near = [share * r["n0"], share * r["x0"], share * r["xx0"]]
                rest = [r["n"] - near[0], r["x"] - near[1], r["xx"] - near[2]]
                found[lag] = np.array([rest[0] / r["n"], *by_moments(*rest), *by_moments(*near)])
            elif k <= 2:
                m, s = by_moments(r["n"], r["x"], r["xx"])
                found[lag] = np.array([0.5, m, s, m / 4, s / 4])
            else:
                left[lag] = max(2, int(0.75 * k))
                continue
            left.pop(lag)
    return found


def by_moments(n: float, x: float, xx: float) -> tuple[float, float]:
    """(m, s) near that of a folded normal with these moments."""
    mean, square = x / n, xx / n
    m = math.sqrt(max(2 * mean * mean - square, 0.01 * square))
    return m, max(square - m * m, 0.01 * square, 1e-300)


def floors(about: dict[float, dict]) -> dict[float, float]:
    return {lag: LEAST * (a["sd"] ** 2 + a["mean"] ** 2) for lag, a in about.items()}


def fit_em(values: DataFrame, about: dict[float, dict], first: dict[float, np.ndarray], tol: float = 1e-7, passes: int = 1000) -> dict[float, tuple]:
    """(parameters, mean log-likelihood, passes) of every lag by EM alone."""
    low = floors(about)
    return lockstep({lag: em_walk(p, low[lag], tol, passes) for lag, p in first.items()}, lambda asked: em_sums(values, asked))


def fit_newton(values: DataFrame, about: dict[float, dict], first: dict[float, np.ndarray], passes: int = 200) -> dict[float, tuple]:
    """The same by Newton steps."""
    units = {lag: math.sqrt(a["sd"] ** 2 + a["mean"] ** 2) for lag, a in about.items()}

    def evaluate(asked: dict) -> dict:
        sums = partial_sums(values, {lag: [(lag, tuple(bound(z, units[lag])))] for lag, z in asked.items()}, newton_sums, 21)
        with np.errstate(all="ignore"):
            return {lag: in_free(sums[lag], z, units[lag], about[lag]["n"]) for lag, z in asked.items()}

    walks = {lag: newton(free(within(p, LEAST * units[lag] ** 2), units[lag]), passes=passes) for lag, p in first.items()}
    return {lag: (bound(z, units[lag]), value, k) for lag, (z, value, k) in lockstep(walks, evaluate).items()}


def fit_mixtures(values: DataFrame, about: dict[float, dict], bins: int) -> dict[float, list[float]]:
    """(p, m1, s1, m2, s2) of every lag: a few rounds of EM from the histogram's start, then Newton steps."""
    if not about:
        return {}
    near = fit_em(values, about, starts(values, about, bins), passes=EM_FIRST)
    return {lag: ordered(p) for lag, (p, _, _) in fit_newton(values, about, {lag: p for lag, (p, _, _) in near.items()}).items()}
