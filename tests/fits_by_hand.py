"""Fits of one lag in numpy, by simplex search: what the distributed fits are held to."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from trailspark.operators.fitting import BINS, log_density, log_folded
from trailspark.operators.likelihood import SHAPES
from trailspark.operators.mixture import ordered


def nelder_mead(f: Callable, start: np.ndarray, steps: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Simplex minimisation."""
    n = len(start)
    pts = np.tile(np.asarray(start, float), (n + 1, 1))
    for i in range(n):
        pts[i + 1, i] += 0.05 * abs(pts[0, i]) if pts[0, i] else 0.00025
    val = np.array([f(p) for p in pts])
    for _ in range(steps):
        order = np.argsort(val, kind="stable")
        pts, val = pts[order], val[order]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol) and np.abs(pts[1:] - pts[0]).max() <= 1e-7:
            break
        centre = pts[:-1].mean(0)
        go = lambda k: centre + k * (centre - pts[-1])  # noqa: B023, E731
        r = go(1.0)
        fr = f(r)
        if fr < val[0]:
            e = go(2.0)
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = go(0.5) if fr < val[-1] else go(-0.5)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [f(p) for p in pts[1:]]
    k = int(val.argmin())
    return pts[k], float(val[k])


def moments(x: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Mean and standard deviation."""
    mean = float(np.average(x, weights=count))
    return mean, math.sqrt(float(np.average((x - mean) ** 2, weights=count)))


def density_bins(x: np.ndarray, bins: int = BINS, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres and densities of equal bins, the last closed."""
    n, edges = np.histogram(x, bins, weights=count)
    w = edges[1] - edges[0]
    return (edges[:-1] + edges[1:]) / 2, n / (n.sum() * w)


def sse(x: np.ndarray, pdf: Callable, bins: int = BINS, count: np.ndarray | None = None) -> float:
    at, y = density_bins(x, bins, count)
    return float(((y - pdf(at)) ** 2).sum())


def fit_family(x: np.ndarray, family: str, count: np.ndarray | None = None) -> np.ndarray | None:
    """Maximum likelihood from a few starts; None where none is finite."""
    w = np.ones(len(x)) if count is None else count
    spread = moments(x, w)[1] or 1.0
    lo, hi = float(x.min()), float(x.max())
    loc = hi + 0.05 * spread if family == "levy_l" else lo - 0.05 * spread
    best = (None, np.inf)
    for shape in ([], ) if not SHAPES[family] else ([1.0] * SHAPES[family], [2.0] * SHAPES[family]):
        with np.errstate(all="ignore"):
            cost = lambda p: v if np.isfinite(v := -(w * log_density(family, p, x)).sum()) else 1e300
            p, v = nelder_mead(cost, np.array([*shape, loc, spread]))
        if v < min(best[1], 1e299):
            best = (p, v)
    return best[0]


def fit_folded(x: np.ndarray, weight: np.ndarray | None = None, start: tuple[float, float] | None = None) -> tuple[float, float]:
    """(m, s) of one folded normal."""
    w = np.ones(len(x)) if weight is None else weight
    mean, spread = moments(x, w) if start is None else (0.0, 0.0)
    first = start or (mean / 3, spread or 1e-3)
    (m, s), _ = nelder_mead(lambda p: -float((w * log_folded(x, p[0], p[1])).sum()) / max(w.sum(), 1e-300), np.array(first), 500)
    return abs(float(m)), abs(float(s))


def start_mixture(x: np.ndarray, bins: int = BINS, least: int = 1, count: np.ndarray | None = None) -> tuple[float, float, float, float, float]:
    """Start values: what the first bin holds above the second is one component, the rest the other.

    Each value of the first bin gives the excess its share. With fewer bins it is
    retried while there is no excess; at two bins a single component is split in half.
    """
    w = np.ones(len(x)) if count is None else count
    total = float(w.sum())
    while True:
        counts, edges = np.histogram(x, bins, weights=w)
        excess = int(counts[0] - counts[1])
        if excess >= max(least, 2) and total - excess >= 2:
            break
        if bins <= 2:
            m, s = fit_folded(x, w)
            return 0.5, m, s, m / 4, s / 4
        bins = max(2, int(0.75 * bins))
    near = np.where(x < edges[1], w, 0.0)
    near *= excess / max(near.sum(), 1e-300)
    m1, s1 = fit_folded(x, w - near)
    m2, s2 = fit_folded(x, near)
    return 1 - excess / total, m1, s1, m2, s2


def em(x: np.ndarray, start: tuple, tol: float = 1e-5, most: int = 200, count: np.ndarray | None = None) -> tuple[float, float, float, float, float]:
    """Mixture of two folded normals from start values; stops when memberships settle, or after ``most`` rounds."""
    w = np.ones(len(x)) if count is None else count
    p, m1, s1, m2, s2 = start
    old = None
    for _ in range(most):
        p = min(max(p, 1e-9), 1 - 1e-9)
        a, b = math.log(p) + log_folded(x, m1, s1), math.log1p(-p) + log_folded(x, m2, s2)
        g = np.exp(a - np.logaddexp(a, b))
        if old is not None and np.all(np.abs(g - old) <= tol + 1e-5 * np.abs(old)):
            break
        old, p = g, float(np.average(g, weights=w))
        m1, s1 = fit_folded(x, w * g, (m1, s1))
        m2, s2 = fit_folded(x, w * (1 - g), (m2, s2))
    return tuple(ordered(np.array([p, m1, s1, m2, s2])))


def fit_mixture(x: np.ndarray, bins: int = BINS, count: np.ndarray | None = None) -> tuple[float, float, float, float, float]:
    return em(x, start_mixture(x, bins, count=count), count=count)


def fit_all(x: np.ndarray, candidates: dict[str, str], bins: int = BINS, mixture: bool = True, count: np.ndarray | None = None) -> list[tuple[str, list[float] | None, float | None]]:
    """(name, parameters, SSE) of each candidate and the mixture."""
    out, done = [], {}
    enough = (len(x) if count is None else count.sum()) >= 5 and float(x.max()) > float(x.min())
    for name, family in candidates.items():
        if family not in done:
            done[family] = fit_family(x, family, count) if enough else None
        p = done[family]
        out.append((name, None, None) if p is None else (name, [float(v) for v in p], sse(x, lambda at, f=family, p=p: np.exp(log_density(f, p, at)), bins, count)))
    if mixture:
        if enough:
            p = fit_mixture(x, bins, count)
            out.append(("folded_normal_mixture", list(p), sse(x, lambda at: p[0] * np.exp(log_folded(at, p[1], p[2])) + (1 - p[0]) * np.exp(log_folded(at, p[3], p[4])), bins, count)))
        else:
            out.append(("folded_normal_mixture", None, None))
    return out
