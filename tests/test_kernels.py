"""Trees, curves, fits and walkers on literal fixtures and by properties."""

import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import fits_by_hand as hand
from tests.curves_by_hand import displacements_by_hand
from tests.shuffled import shuffled
from trailspark.operators import cover, curves, fitting, forest, graph, joins, likelihood, mixture, regression, simulate, streams32, tracks, triangles


def test_moves():
    g = simulate.Graph([(0, 1, 1), (0, 2, 1.2), (0, 3, 2), (1, 4, 1), (0, 5, 1.1)])
    got = lambda a, b, loc, d: sorted((p.tail, p.head, round(p.loc, 6), path) for p, path in g.moves(simulate.Position(a, b, loc), d))
    assert got(1, 0, 0.5, 1) == [(0, 2, 0.416667, [0]), (0, 3, 0.25, [0]), (0, 5, 0.454545, [0])]
    assert got(4, 1, 0.6, 1) == [(1, 0, 0.6, [1])]
    assert got(4, 1, 0.6, 2) == [(0, 2, 0.5, [1, 0]), (0, 3, 0.3, [1, 0]), (0, 5, 0.545455, [1, 0])]
    assert got(0, 5, 0.5, 5) == []
    assert simulate.Graph([(0, 1, 0.0), (1, 2, 0.0), (0, 2, 0.0)]).moves(simulate.Position(0, 1, 0.0), 1) == []


def test_split():
    found = graph.split_segment([0, 1, 0, 0, 0, 1, 1, 1, 0, 0, 1, 0], lambda x: x == 1)
    assert found == [[0, 1], [1, 0, 0, 0, 1], [1, 0, 0, 1], [1, 0]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=25, unique=True))
def test_spanning_trees(points):
    p = np.array(points, float)
    edges = graph.spanning_tree(p)
    assert len(edges) == len(p) - 1 and graph.Tree.of(edges).is_tree()
    # Kruskal's total
    parent = list(range(len(p)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    total = 0.0
    for d, a, b in sorted(((p[a] - p[b]) @ (p[a] - p[b]), a, b) for a in range(len(p)) for b in range(a)):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += d
    assert sum((p[a] - p[b]) @ (p[a] - p[b]) for a, b in edges) == pytest.approx(total)
    tree = graph.Tree.of(edges)
    segments = tree.segments()
    seen = [n for s in segments for n in s]
    assert {*seen} == {*tree.adj} and all(seen.count(n) == 1 for n in tree.adj if len(tree.adj[n]) <= 2)
    # split where a point is on a path already, the parts hold every edge but those between such points, each once
    owned, parts = set(), []
    for s in segments:
        parts += graph.split_segment(s, lambda x: x in owned)
        owned |= {*s}
    steps = [tuple(sorted(e)) for s in parts for e in zip(s, s[1:], strict=False)]
    assert sorted(steps) == sorted(tuple(sorted(e)) for e in edges)


def test_segments_peel_nodes():
    t = graph.Tree.of([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (2, 7), (3, 8)])
    first, second = t.segments()[:2]
    assert sorted((first, first[::-1]))[0] in ([0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 8]) and len(first) == 6 and sorted((second, second[::-1]))[0] == [7, 2, 3, 8]


def test_trees_by_rounds_equal_those_of_one_task(spark):
    rng = np.random.default_rng(0)
    rows = [(k, *map(float, p)) for k, n in ((1, 40), (None, 1), (4, 25)) for p in (rng.integers(0, 4, (n, 3)) if k == 1 else rng.normal(size=(n, 3)))] + [(4, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "track_id long, x double, y double, z double")
    near, far = (sorted(map(tuple, forest.spanning_trees(points, local=n).collect())) for n in (2000, 0))
    assert near == far and len(near) == len({r for r in rows if r[0] == 1}) - 1 + 24
    assert forest.spanning_trees(points.limit(0)).count() == 0


def test_contraction_equals_walks(spark):
    rng = np.random.default_rng(2)
    trees = {1: [(i - 1, i) for i in range(1, 25)], 2: [(0, i) for i in range(1, 12)], 3: [(int(rng.integers(0, i)), i) for i in range(1, 40)], 4: [(max(0, i - int(rng.integers(1, 4))), i) for i in range(1, 30)], 5: [(3, 9)], None: [(0, 1), (1, 2)]}
    others = {6: [(0, 1), (2, 3)], 7: [(0, 1), (1, 2), (2, 0)], 8: [(1, 1), (1, 2), (2, 1)]}
    e = spark.createDataFrame([(k, a, b) for k, t in {**trees, **others}.items() for a, b in t], "k long, a long, b long")
    for local in (2000, 0):
        got = {r.k: r.hops for r in forest.diameters(e.where("k is null or k < 6"), ["k"], local).collect()}
        assert got == {k: len(graph.Tree.of(t).longest_path()) - 1 for k, t in trees.items()}
        sizes = {r.k: (r.nodes, r.edges, r.is_tree) for r in forest.forest_sizes(e.where("a <> b"), ["k"], local).collect()}
        assert sizes == {**{k: (len(t) + 1, len(t), True) for k, t in trees.items()}, 6: (4, 2, False), 7: (3, 3, False), 8: (2, 1, True)}


def test_long_chains_are_searched_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(graph, "LAYERS", 3)
    e = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, 3)], "a long, b long")
    assert {(r.node, r.hops) for r in graph.hop_distances(e, 0).collect()} == {(k, min(k, 4 + 12 - k)) for k in range(13)}


def test_tiles_give_all_pairs(spark):
    rows = [(k, t, float(t * k)) for k in (1, 2) for t in range(-5, 23, k)]
    points = spark.createDataFrame(rows, "track_id long, t long, x double")
    want = sorted((k, t, u, u - t) for k, t, _ in rows for j, u, _ in rows if j == k and u > t)
    for tile in (4, 256):
        got = tracks.all_lags(points, ["x"], tile=tile)
        assert sorted((r.track_id, r.t1, r.t2, r.delta) for r in got.collect()) == want
        assert "_i" in got._jdf.queryExecution().optimizedPlan().toString()


def test_triangles_close_around_a_block(spark):
    block = [(0, i, j, k, 1.0 if all(1 <= c <= 3 for c in (i, j, k)) else -1.0) for i in range(5) for j in range(5) for k in range(5)]
    ring = [(1, i, j, 0, 1.0) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    two = [(2, 0, 0, 0, 2.0), (2, 5, 5, 5, 2.0), (2, 5, 5, 5, None)]
    v = spark.createDataFrame(block + ring + two, "t int, i int, j int, k int, v double")
    got = {r.t: r for r in triangles.shape(triangles.triangles(v, around=-1.0)).collect()}
    assert {t: (r.euler, r.open_edges) for t, r in got.items()} == {0: (2, 0), 1: (0, 0), 2: (4, 0)}
    assert 8 < got[0].volume < 27 and got[0].area > 24
    # without a value around it, only cubes between eight voxels count: the block is inside, the ring has none
    assert {r.t: r.euler for r in triangles.shape(triangles.triangles(v)).collect()} == {0: 2}
    # a sphere: vertices lie on it, normals point outwards
    n = 9
    ball = spark.createDataFrame([(0, i, j, k, 3.2 - math.dist((i, j, k), (4, 4, 4))) for i in range(n) for j in range(n) for k in range(n)], "t int, i int, j int, k int, v double")
    faces = triangles.triangles(ball, (-4, -4, -4))
    (r,) = triangles.shape(faces).collect()
    assert (r.euler, r.open_edges) == (2, 0) and r.volume == pytest.approx(4 / 3 * math.pi * 3.2**3, rel=0.06)
    for p in triangles.vertices(faces).collect():
        assert math.hypot(p.x, p.y, p.z) == pytest.approx(3.2, abs=0.1) and (p.x * p.nx + p.y * p.ny + p.z * p.nz) / 3.2 > 0.8


def test_polynomials_by_sums(spark):
    rng = np.random.default_rng(4)
    data = {k: (t := rng.uniform(-50, 900, 60), 3 + 0.5 * t - 0.01 * k * t**2 + rng.normal(0, 1, 60)) for k in (1, 2)} | {3: (np.array([1.0, 1.0]), np.array([2.0, 4.0]))}
    df = spark.createDataFrame([(k, float(t), float(x), float(-x)) for k, (ts, xs) in data.items() for t, x in zip(ts, xs, strict=True)] + [(1, None, 1.0, 1.0)], "k long, t double, x double, y double")
    got = {r.k: r for r in regression.polynomials(df, ["k"], "t", ["x", "y"], 3).collect()}
    assert got[3].x_coef is None and got[3].n == 2
    for k in (1, 2):
        want = curves.least_squares(np.stack([data[k][0], data[k][1]], 1), 0, 3).coef[1]
        assert got[k].x_coef == pytest.approx(list(want), rel=1e-6) and got[k].y_coef == pytest.approx([-v for v in want], rel=1e-6)


def test_simplify_covers():
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 40, (200, 3))
    q = graph.simplify(p, 6.0)
    assert len(q) < len(p) and all(((q - x) ** 2).sum(1).min() < 12.0**2 for x in p)
    assert len(graph.simplify(np.zeros((5, 3)))) == 1


def test_covers_by_rounds_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(8)
    data = {1: rng.uniform(0, 20, (50, 3)), 2: rng.integers(0, 9, (40, 3)).astype(float), 3: np.zeros((4, 3))}
    df = spark.createDataFrame([(k, *map(float, p)) for k, ps in data.items() for p in ps] + [(3, None, 1.0, 1.0)], "track_id long, x double, y double, z double").repartition(3)
    near, far = (sorted(map(tuple, cover.covers(df, 6.0, local=n).collect())) for n in (2000, 0))
    assert [r[0] for r in near] == [r[0] for r in far] and np.allclose(near, far, rtol=0, atol=1e-9)
    for k, ps in data.items():
        assert np.allclose(sorted(map(tuple, graph.simplify(ps, 6.0))), [r[1:] for r in near if r[0] == k], rtol=0, atol=1e-9)


def test_longest_path():
    t = graph.Tree.of([(0, 1), (1, 2), (2, 3), (1, 9)])
    assert sorted((t.longest_path()[0], t.longest_path()[-1])) in ([0, 3], [3, 9])
    assert t.path(0, 3) == [0, 1, 2, 3] and not graph.Tree.of([(0, 1), (2, 3)]).is_tree()


def three_curves():
    f = curves.Curve([curves.Poly(np.array([[0, 1, 0], [1, 0, -1]], float), -2, 0), curves.Poly(np.array([[0, 1], [1, -1]], float), 0, 1)])
    g = curves.Curve([curves.Poly(np.array([[0, 1], [0, 1]], float), 0.5, 1), curves.Poly(np.array([[0, 0, 1], [0, 1, 0]], float), 1, 2)])
    h = curves.Curve([curves.Poly(np.array([[-2, 0], [0, 1]], float), -2.5, -2), curves.Poly(np.array([[0, 1, 0, 0], [1, 3, 3, 1]], float), -2, -1)])
    return curves.Branching({0: f, 1: g, 2: h}, {(0, 1): 0.5, (1, 0): 0.5, (0, 2): -1.0, (2, 0): -1.0})


def test_branches():
    b = three_curves()
    length, err = b.length((0, 1.0), (1, 1.0))
    assert length == pytest.approx(math.sqrt(2)) and err < 1e-6
    assert b.length((1, 1.0), (0, 1.0))[0] == pytest.approx(length)
    assert b.directions((0, 1.0), (1, 1.0)) == (-1, 1)
    assert b.directions((0, 0.5), (0, 0.5)) == (0, 0)
    assert b.is_end((0, 1.0)) and not b.is_end((1, 0.5)) and not b.is_end((0, 0.3))
    assert b.is_tree() and b.route(2, 1) == [2, 0, 1]
    k, t = b.closest((0.25, 0.75))
    assert k == 0 and t == pytest.approx(0.25)


def test_curve_parts():
    c = curves.spline(np.array([[0, 0, 0], [1, 2, 0], [3, 3, 1], [4, 1, 2], [6, 0, 2]], float))
    assert c.length()[0] == pytest.approx(c.length(1, 0)[0])
    s = c.length(0, 0.6)[0]
    assert c.at_length(s) == pytest.approx(0.6, abs=1e-9)
    for k, u in enumerate(curves.chord_parameters(np.array([[0, 0, 0], [1, 2, 0], [3, 3, 1], [4, 1, 2], [6, 0, 2]], float))):
        assert np.allclose(c(u), [[0, 0, 0], [1, 2, 0], [3, 3, 1], [4, 1, 2], [6, 0, 2]][k])
    d2, t = c.closest((2, 2, 2))
    grid = np.linspace(0, 1, 20001)
    assert d2 == pytest.approx(min(((c(x) - (2, 2, 2)) ** 2).sum() for x in grid[::20]), abs=1e-3)
    line = curves.spline(np.array([[0, 0, 0], [3, 4, 0]], float))
    assert line.length()[0] == pytest.approx(5) and line.length()[1] < 1e-9
    longer = line.connect((3, 10, 0), True, 1.0)
    assert longer.length()[0] == pytest.approx(11) and line.connect((0, -2, 0), False, 0.5).length()[0] == pytest.approx(7)
    with pytest.raises(ValueError, match="outside"):
        line(1.5)
    assert line.integral(lambda p: np.ones(p.shape[-1]))[0] == pytest.approx(5)
    b = curves.from_bspline([0, 0, 0, 0, 0.5, 1, 1, 1, 1], np.array([[0, 1, 2, 3, 4], [0, 1, 0, 1, 0.0]]), 3)
    assert len(b.pieces) == 2 and np.allclose(b(0.0), [0, 0]) and np.allclose(b(1.0), [4, 0])
    assert np.allclose(b.pieces[0](0.5), b.pieces[1](0.5))
    smooth = curves.spline(np.random.default_rng(0).normal(0, 1, (30, 3)) + np.linspace(0, 50, 30)[:, None], smooth=True)
    assert smooth.length()[0] < 120
    fit = curves.least_squares(np.stack([np.linspace(0, 1, 20), np.linspace(0, 1, 20) ** 2, np.ones(20)], 1), 0, 2)
    assert np.allclose(fit(0.5), [0.5, 0.25, 1]) and fit.degree == 2
    ts, d = curves.Poly(np.array([[0, 1, 0], [0, 0, 1]], float), -1, 1).closest((0, 1))
    assert len(ts) == 2 and d == pytest.approx(0.75)


def test_displacements_along_branches_equal_those_pair_by_pair(spark):
    rng = np.random.default_rng(6)
    data = {"y": [(3.0 * t, 0.0, 0.0) for t in range(12)] + [(15.0, 3.0 * t, 1.0) for t in range(1, 9)] + [(24.0, -4.0 * t, 0.0) for t in range(1, 6)], "walk": np.cumsum(rng.normal(0, 4, (35, 3)), 0).tolist(), "one": [(1.0, 1.0, 1.0)]}
    data["y"] = (np.array(data["y"]) + rng.normal(0, 0.2, (len(data["y"]), 3))).tolist()
    rows = [("191205", "e", k, t + (t > 7), *map(float, p), 10) for k, ps in data.items() for t, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "date string, experiment string, track_id string, t long, x double, y double, z double, spf int").repartition(3)
    for ends in (True, False):
        got = curves.curve_displacements(df, exclude_ends=ends).collect()
        want = {k: displacements_by_hand({t + (t > 7): p for t, p in enumerate(ps)}, 10.0, exclude_ends=ends) for k, ps in data.items()}
        order = lambda r: (r[0], round(r[2], 6), round(r[1], 6))
        for k in data:
            mine = sorted(((r.lag, r.disp, r.strt_disp, r.reldir) for r in got if r.track_id == k), key=order)
            for a, b in zip(mine, sorted(want[k], key=order), strict=True):
                assert a[:3] == pytest.approx(b[:3], rel=1e-6, abs=1e-6) and a[3] == b[3]
        assert len({r.track_id for r in got}) == 2 and len(curves.branching(np.array(data["y"], float)).branches) > 1


def test_nearest_and_farthest_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    groups = {1: rng.normal(size=(60, 2)), 2: rng.integers(0, 3, (25, 3)).astype(float), 3: np.ones((1, 2)), 4: np.zeros((5, 2))}
    rows = [(g, 100 * g + k, p.tolist()) for g, ps in groups.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "g long, id long, pos array<double>").repartition(3)
    monkeypatch.setattr(joins, "TILE", 7)
    d2 = lambda p, q: float(((np.array(p) - np.array(q)) ** 2).sum())
    far = {r.g: (r.d2, r.a, r.b) for r in joins.farthest_pair(df, ["g"], "id", "pos").collect()}
    assert set(far) == {1, 2, 4}
    for g in far:
        own = [r for r in rows if r[0] == g]
        want = max((d2(p, q), -a, -b) for _, a, p in own for _, b, q in own if a < b)
        assert far[g] == (pytest.approx(want[0]), -want[1], -want[2])
    queries = df.withColumn("pos", F.transform("pos", lambda x: x * 1.3 + 0.1)).withColumn("id", F.col("id") + 5000)
    got = {r.qid: (r.d2, r.id) for r in joins.nearest(queries.select("g", F.col("id").alias("qid"), F.col("pos").alias("qpos")), df.where("id % 3 <> 1"), ["g"], "qid", "qpos", "id", "pos").collect()}
    assert len(got) == len(rows)
    for g, i, p in rows:
        want = min((d2([x * 1.3 + 0.1 for x in p], q), j) for h, j, q in rows if h == g and j % 3 != 1)
        assert got[i + 5000][0] == pytest.approx(want[0], abs=1e-12) and (got[i + 5000][1] == want[1] or g in (2, 4))


def test_smoothed_splines():
    rng = np.random.default_rng(11)
    for n in (6, 30, 300):
        t = np.linspace(0, 12, n)
        p = np.stack([6 * t, 9 * np.sin(t), 4 * np.cos(t / 2)], 1) + rng.normal(0, 0.55, (n, 3))
        c = curves.spline(p, smooth=True)
        u = curves.chord_parameters(p)
        rss = sum(((c(x) - q) ** 2).sum() for x, q in zip(u, p, strict=True))
        target = n - math.sqrt(2 * n)
        assert rss <= target * (1 + 1e-6) and (len(c.pieces) == 1 or rss >= 0.99 * target) and len(c.pieces) <= n - 3
        for a, b in zip(c.pieces, c.pieces[1:], strict=False):  # two derivatives go on
            for f, g in ((a, b), (a.deriv(), b.deriv()), (a.deriv().deriv(), b.deriv().deriv())):
                assert f(a.hi) == pytest.approx(g(a.hi), rel=1e-4, abs=1e-3 * 50)
    # a cubic comes back as it is
    s = np.linspace(0, 1, 40)
    fit = curves.KnotSpline(s, np.stack([s**3 - s, 2 - s * s], 1), np.array([0.25, 0.6]))
    c, rest = fit.solved()
    assert rest.sum() < 1e-16 and fit.curve(c)(0.4) == pytest.approx([0.4**3 - 0.4, 2 - 0.16], abs=1e-7)
    # banded systems equal dense ones
    bands = np.c_[rng.uniform(8, 9, 200), rng.normal(size=(200, 4))]
    dense = sum((np.diag(bands[: 200 - d, d], d) + (np.diag(bands[: 200 - d, d], -d) if d else 0) for d in range(5)), np.zeros((200, 200))) + 8 * np.eye(200)
    bands[:, 0] += 8
    assert curves.banded(bands, np.ones((200, 2))) == pytest.approx(np.linalg.solve(dense, np.ones((200, 2))), rel=1e-9)


def test_displacements_along_a_line(spark):
    rows = [("191205", "e", "a", t, 3.0 * t, 4.0 * t, 0.0, 10) for t in range(6)] + [("191205", "e", "b", 0, 1.0, 1.0, 1.0, 10)]
    df = spark.createDataFrame(rows, "date string, experiment string, track_id string, t long, x double, y double, z double, spf int")
    got = curves.curve_displacements(df, radius=None, exclude_ends=False).collect()
    assert len(got) == 15 and all(r.disp == pytest.approx(r.lag / 2) == pytest.approx(r.strt_disp) for r in got)
    assert all(r.reldir in (None, 1.0) for r in got) and {r.num_points for r in got} == {6}
    assert curves.project_tracks(df, None, True).count() == 4
    assert curves.curve_displacements(df, radius=None, exclude_ends=False, most=3).groupBy("track_id").count().first()["count"] == 3


def folded(seed, n, m, s):
    return np.abs(np.random.default_rng(seed).normal(m, s, n))


def test_folded_normal_is_recovered():
    m, s = hand.fit_folded(folded(42, 10_000, 0.4, 0.2))
    assert m == pytest.approx(0.4, abs=0.02) and s == pytest.approx(0.04, abs=0.004)


def test_mixture_is_recovered():
    x = np.r_[folded(1, 6000, 0.5, 0.2), folded(2, 4000, 0.02, 0.02)]
    p, m1, s1, m2, s2 = hand.fit_mixture(x)
    assert p == pytest.approx(0.6, abs=0.03) and m1 == pytest.approx(0.5, abs=0.03) and s1 == pytest.approx(0.04, abs=0.01) and s2 < 0.003


def test_families_are_recovered():
    rng = np.random.default_rng(5)
    shape, loc, scale = hand.fit_family(rng.gamma(3, 2, 4000), "gamma")
    assert shape * scale + loc == pytest.approx(6, abs=0.2)
    assert hand.fit_all(np.zeros(3), fitting.STABLE)[0][1] is None


def test_fits_by_lag(spark):
    s = spark.createDataFrame([(10.0 * k, float(v)) for k in (1, 2) for v in folded(k, 400, 2, 1)], "lag double, value double")
    fits = fitting.fit_by_lag(s, {"folded_normal": "foldnorm", "gamma": "gamma"}).cache()
    assert {(r.lag, r.dist) for r in fits.collect()} == {(k, d) for k in (10, 20) for d in ("folded_normal", "gamma", "folded_normal_mixture")}
    assert fits.where("sse is null or sse > 1").count() == 0
    assert fitting.parameter_series(fits).count() == 2 * (3 + 3 + 5)
    c = fitting.density_curves(fits, s)
    assert c.count() == 600 and c.where("density < 0").count() == 0


def test_fits_take_all_values(spark):
    from trailspark.operators import stats
    from trailspark.plans.queries import QUERIES
    from trailspark.sources import tables

    at = "/root/testdata/sf0.01"
    s = stats.samples_over_time(tables.displacements(spark, at), "disp", 30, 60).toPandas()
    for r in QUERIES["fit_mixture"](spark, at).collect():
        x = s["value"][s["lag"] == r.lag].to_numpy()
        loglik = lambda p: float(np.log(fitting.mixture_density(p, x)).sum())
        # the simplex search stops about a hundredth before the optimum; from the optimum it goes nowhere
        (_, params, _), = hand.fit_all(x, {})
        assert len(x) > 2000 and r.params == pytest.approx(params, rel=2e-2, abs=0.05) and loglik(r.params) > loglik(params) - 1e-6
        assert list(hand.em(x, r.params)) == pytest.approx(r.params, rel=1e-3, abs=0.05) and r.sse == pytest.approx(hand.sse(x, lambda at, p=r.params: fitting.mixture_density(p, at)), rel=1e-3)
    many, x = spark.range(120_000).selectExpr("10d AS lag", "sqrt(id % 40) AS value"), np.sqrt(np.arange(120_000) % 40)
    (got,) = fitting.fit_by_lag(many, {"gamma": "gamma"}, mixture=False).collect()
    (_, params, error), = hand.fit_all(x, {"gamma": "gamma"}, mixture=False)
    # no inner optimum: both only approach a normal along a curved ridge, Newton steps more slowly
    assert fitting.log_density("gamma", np.asarray(got.params), x).mean() == pytest.approx(fitting.log_density("gamma", np.asarray(params), x).mean(), abs=2e-3) and got.sse == pytest.approx(error, rel=2e-2)


def test_distributed_fits_equal_the_kernels(spark):
    rng = np.random.default_rng(7)
    lags = {10.0: rng.gamma(3, 2, 1500), 20.0: 1.5 + 1 / rng.gamma(4, 1, 1500), 30.0: np.abs(rng.normal(3, 1, 1500)), 40.0: 2 + rng.gamma(2.5, 1, 1500) ** 0.7}
    s = spark.createDataFrame([(k, float(v)) for k, x in lags.items() for v in x], "lag double, value double").repartition(7)
    got = {(r.lag, r.dist): r for r in fitting.fit_by_lag(s, mixture=False).collect()}
    loglik = lambda f, p, x: float(fitting.log_density(f, np.asarray(p), x).sum())
    for lag, x in lags.items():
        for name, family in {**fitting.STABLE, **fitting.GAMMA}.items():
            want, r = hand.fit_family(x, family), got[lag, name]
            # as likely as the simplex search's, and the same wherever that has an inner optimum
            assert loglik(family, r.params, x) >= loglik(family, want, x) - 1e-4 * len(x)  # an optimum at infinity is only approached
            if abs(loglik(family, r.params, x) - loglik(family, want, x)) < 1e-7 * len(x) and family not in ("foldnorm", "gengamma"):
                assert r.params == pytest.approx(list(want), rel=1e-3, abs=1e-3)
    assert got[10.0, "gamma"].params == pytest.approx(list(hand.fit_family(lags[10.0], "gamma")), rel=1e-3, abs=1e-3)


def test_gradients_and_second_derivatives():
    rng = np.random.default_rng(3)
    x = rng.gamma(3, 2, 60)
    for family, shape in (("levy", []), ("levy_l", []), ("foldnorm", [0.7]), ("halfgennorm", [1.3]), ("gamma", [2.2]), ("gengamma", [1.4, 1.7]), ("invgamma", [2.5])):
        start = [v if family == "foldnorm" else math.log(v) for v in shape]
        at = np.array([*start, -x.max() - 1 if family == "levy_l" else x.min() - 1, 0.4])

        def of(p, family=family):
            return likelihood.assembled(family, p, 1.0, len(x), likelihood.family_sums((family, *likelihood.plain(family, p, 1.0)), x, np.ones(len(x))))

        value, g, h = of(at)
        s, loc, scale = likelihood.plain(family, at, 1.0)
        assert value == pytest.approx(float(fitting.log_density(family, np.array([*s, loc, scale]), x).mean()), rel=1e-9)
        for k in range(len(at)):
            e = np.eye(len(at))[k] * 1e-5
            assert g[k] == pytest.approx((of(at + e)[0] - of(at - e)[0]) / 2e-5, rel=1e-4, abs=1e-7)
            assert h[k] == pytest.approx((of(at + e)[1] - of(at - e)[1]) / 2e-5, rel=1e-4, abs=1e-5)
    z = np.array([0.3, 0.9, -1.0, 0.2, -3.0])

    def mixed(z):
        return mixture.in_free(mixture.newton_sums(tuple(mixture.bound(z, 2.0)), x / 4, np.ones(len(x))), z, 2.0, len(x))

    for k in range(5):
        e = np.eye(5)[k] * 1e-5
        assert mixed(z)[1][k] == pytest.approx((mixed(z + e)[0] - mixed(z - e)[0]) / 2e-5, rel=1e-4, abs=1e-6)
        assert mixed(z)[2][k] == pytest.approx((mixed(z + e)[1] - mixed(z - e)[1]) / 2e-5, rel=1e-4, abs=1e-4)


def test_newton_reaches_the_optimum_of_em_in_fewer_passes(spark):
    """The demos of the two-component fit: 4000 values of known components, three lags at once."""
    data = {}
    for lag, (p, m1, s1, m2, s2) in {10.0: (0.6, 0.5, 0.2, 0.02, 0.02), 20.0: (0.3, 0.4, 0.3, 0.08, 0.03), 30.0: (0.7, 0.25, 0.15, 0.03, 0.01)}.items():
        n = round(4000 * p)
        data[lag] = np.r_[folded(int(lag), n, m1, s1), folded(int(lag) + 1, 4000 - n, m2, s2)]
    values = likelihood.counted(spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "lag double, value double")).persist()
    about = likelihood.summaries(values)
    first = mixture.starts(values, about, 50)
    em, newton = mixture.fit_em(values, about, first, 1e-9), mixture.fit_newton(values, about, {lag: p for lag, (p, _, _) in mixture.fit_em(values, about, first, passes=8).items()})
    for lag, x in data.items():
        assert newton[lag][1] == pytest.approx(em[lag][1], rel=1e-7) and newton[lag][2] + 8 < em[lag][2]
        assert mixture.ordered(newton[lag][0]) == pytest.approx(mixture.ordered(em[lag][0]), rel=2e-3, abs=2e-3)
        assert newton[lag][1] >= float(np.log(fitting.mixture_density(hand.fit_mixture(x), x)).mean()) - 1e-7
        assert list(hand.em(x, mixture.ordered(newton[lag][0]))) == pytest.approx(mixture.ordered(newton[lag][0]), rel=2e-3, abs=1e-3)


def test_fits_of_odd_lags(spark):
    rows = [(1.0, 2.0)] * 9 + [(2.0, 1.0), (2.0, 2.0)] + [(3.0, None), (3.0, float("nan"))] + [(None, 1.0)] + [(4.0, float(v)) for v in (0, 0, 0, 1, 2, 3, 4)]
    got = {(r.lag, r.dist): r.params for r in fitting.fit_by_lag(spark.createDataFrame(rows, "lag double, value double"), {"gamma": "gamma"}).collect()}
    assert {k for k, p in got.items() if p is None} == {(k, d) for k in (1.0, 2.0) for d in ("gamma", "folded_normal_mixture")}
    assert {k for k, _ in got} == {1.0, 2.0, 4.0}
    assert fitting.fit_by_lag(spark.createDataFrame([], "lag double, value double")).count() == 0


def test_kernel_queries_take_whole_tracks(spark, sf_dir):
    from trailspark.plans.queries import QUERIES
    from trailspark.sources import tables

    t = tables.tracks(spark, sf_dir)
    sizes = {r.track_id: (r.points, r.n, r.last * r.spf) for r in t.groupBy("track_id").agg(F.count_distinct("x", "y", "z").alias("points"), F.count("*").alias("n"), F.max("t").alias("last"), F.max("spf").alias("spf")).collect()}
    assert max(n for _, n, _ in sizes.values()) > 40
    assert {r.track_id: r["count"] + 1 for r in QUERIES["mst"](spark, sf_dir).groupBy("track_id").count().collect()} == {k: p for k, (p, _, _) in sizes.items()}
    for name in ("simplify_points", "project_track"):
        assert {r.track_id for r in QUERIES[name](spark, sf_dir).select("track_id").distinct().collect()} <= set(sizes)
    lags = QUERIES["curve_displacements"](spark, sf_dir).groupBy("track_id").agg(F.max("lag").alias("lag")).collect()
    assert {int(r.track_id) for r in lags} <= set(sizes) and max(r.lag / sizes[int(r.track_id)][2] for r in lags) > 0.6


def test_registered_walk_has_all_steps(monkeypatch):
    from trailspark.plans import queries

    seen = []
    monkeypatch.setattr(queries.tables, "tissue", lambda *_: None)
    monkeypatch.setattr(simulate, "walk_visits", lambda edges, cells, steps, *_: seen.append(steps) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.QUERIES["walk_coverage"](None, "")
    assert seen == [simulate.STEPS]


def test_walkers(spark):
    path = spark.createDataFrame([(0, 1, 1.0)], "a long, b long, weight double")
    for mover, params in (("brownian", (0.3,)), ("simple_forward", (0.3, 0.2)), ("normal", (0.2, 0.5, 0.1)), ("normal_mixture", (0.2, 0.5, 0.5, 0.1, 0.2, 0.1))):
        w = simulate.simulate(path, 6, 12, mover, params).cache()
        assert w.count() == 6 * 13 and w.where("edge_loc < 0 or edge_loc > 1").count() == 0
        again = simulate.simulate(path, 6, 12, mover, params).repartition(3)
        assert again.exceptAll(w).isEmpty()
    assert simulate.walk_visits(path, 3, 10).count() == 6
    with pytest.raises(ValueError, match="too many"):
        simulate.simulate(path, 1, 1, most=1)
    sweep = simulate.coverage_sweep(path.unionByName(spark.createDataFrame([(1, 2, 1.0)], path.schema)), 1, 5, 2, steps=50)
    got = {r.cells: r.coverage for r in sweep.collect()}
    assert got == {1: 3, 3: 3, 5: 3}
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "id long, x double, y double, z double")
    placed = simulate.xyz(simulate.simulate(path, 2, 3), nodes)
    assert placed.where("x < 0 or x > 2").count() == 0 and placed.count() == 8


def test_hops(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (7, 8)], "a long, b long")
    assert {(r.node, r.hops) for r in graph.hop_distances(e, 0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    f = forest.forest_sizes(e.select(F.lit(1).alias("track_id"), "a", "b"), ["track_id"]).first()
    assert (f.nodes, f.edges, f.is_tree) == (6, 4, False)


def test_random_streams_equal_the_published_first_draws():
    # fixed values: the first numbers of the generator's demo, seed 42, sequence 54
    want = [0xA15C02B7, 0x7B47F409, 0xBA1D3330, 0x83D2F293, 0xBFA4784B, 0xCBED606E]
    s, i = streams32.seeded(np.array([42]), np.array([54]))
    out, after = streams32.draws(s, i, 6)
    assert out[0].tolist() == want
    assert streams32.ahead(s, i, np.array([6])).tolist() == after.tolist()
    assert streams32.draws(streams32.ahead(s, i, np.array([4])), i, 2)[0][0].tolist() == want[4:]
    state, seen = int(s[0]), []
    for _ in range(200):
        x, state = streams32.bounded(state, int(i[0]), 6)
        seen.append(x)
    assert set(seen) == set(range(6)) and seen[:6] == [w % 6 for w in want]


def test_random_streams_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(streams32, "CHUNK", 7)
    df = spark.createDataFrame([(1, 42, 54), (2, None, -3)], "stream long, seed long, sequence long")
    got = {}
    for r in streams32.streams(df, 20).collect():
        got.setdefault(r.stream, {})[r.draw] = r.value
    for k, seed, seq in ((1, 42, 54), (2, 0, -3)):
        s, i = streams32.seeded(np.array([seed]), np.array([seq]))
        assert [got[k][d] for d in range(20)] == streams32.draws(s, i, 20)[0][0].tolist()
    assert streams32.streams(df, 0).count() == 0


def test_simplify_equals_comparing_all_points():
    rng = np.random.default_rng(8)
    for n in (1, 40, 300):
        pts = rng.uniform(-20, 20, (n, 3))
        every = np.unique(pts, axis=0)
        near = ((every[:, None] - every[None]) ** 2).sum(2) < 36
        left, want = np.ones(len(every), bool), []
        while left.any():
            members = near[int((near & left).sum(1).argmax())] & left
            want.append(every[members].mean(0))
            left &= ~members
        assert np.allclose(graph.simplify(pts, 6.0), np.array(want))


def test_nodes_are_numbered_in_order(spark):
    nodes = spark.range(0, 500, 3).select((F.col("id") * 7 % 1000).alias("node")).distinct().repartition(5)
    got = sorted((r.idx, r.node) for r in graph.numbered(nodes).collect())
    assert [i for i, _ in got] == list(range(len(got))) and [n for _, n in got] == sorted(n for _, n in got)


def test_an_edge_of_gaps(spark):
    """Gaps in tracks, thin graphs and far nodes, which the whole tables do not have."""
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (10, 11), (2, 4)], "a long, b long")
    assert {tuple(r) for r in graph.hop_distances(e, 0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)}
    assert {tuple(r) for r in graph.branch_points(graph.undirected(e)).collect()} == {(2, 3)}
    p = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 3, 0.5), (1, 4, 2.0), (1, 5, 2.0)], "track_id long, t long, x double")
    pairs = tracks.all_lags(p, ["x"]).withColumn("dir", F.signum(F.col("x2") - F.col("x1")))
    got = {(r.t1, r.delta): r.reldir for r in tracks.arrivals(pairs).collect()}
    assert got[(1, 2)] is None and got[(3, 1)] is None and got[(4, 1)] == -1.0 and got[(3, 2)] == -1.0


def test_pairs_of_many_dimensions_are_sent_once_a_tile(spark):
    """In many dimensions no bound by a centre holds: points go once to each tile of the other side, whatever their distances."""
    rng = np.random.default_rng(31)
    p = rng.normal(size=(600, 32)) + 1e6
    df = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(p)], "g long, id long, pos array<double>").repartition(3).cache()
    odd = spark.createDataFrame([(1, 900, [math.nan] * 32), (1, 901, None), (1, 902, [0.0]), (1, 903, [None] * 32)], df.schema)
    d2 = ((p[:, None] - p) ** 2).sum(2)
    sides = df.unionByName(odd), df.where("id % 2 = 1").unionByName(odd.where("id <> 902")).select("g", F.col("id").alias("c"), F.col("pos").alias("cpos"))
    found = []
    rows, _ = shuffled(spark, lambda: found.extend(joins.nearest(*sides, ["g"], "id", "pos", "c", "cpos").collect()))
    assert {r.id: r.c for r in found} == {k: int(d2[k, 1::2].argmin()) * 2 + 1 for k in range(600)}
    assert rows < 4000
    far = joins.farthest_pair(df.unionByName(odd), ["g"], "id", "pos").collect()
    a, b = divmod(int(d2.argmax()), 600)
    assert [(r.a, r.b) for r in far] == [(a, b)]


def test_walks_by_rounds_equal_walks_on_a_broadcast(spark, monkeypatch):
    """Graphs beyond the bound are walked whole, with the same rows."""
    rng = np.random.default_rng(41)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (110, 2)).tolist() if a != b} | {(100, 101), (101, 102)})
    e = spark.createDataFrame([(a, b, 0.4 + (a + b) % 3) for a, b in pairs], "a long, b long, weight double").cache()
    runs = {
        "brownian": lambda: simulate.simulate(e, 8, 10),
        "mixture": lambda: simulate.simulate(e, 8, 10, "normal_mixture", (0.1, 0.4, 1.0, 0.5, 0.2, 0.1)),
        "visits": lambda: simulate.walk_visits(e, 8, 40),
    }
    want = {k: sorted(map(tuple, run().collect())) for k, run in runs.items()}
    monkeypatch.setattr(simulate, "BROADCAST_ARCS", 10)
    monkeypatch.setattr(simulate, "AHEAD", 3)
    assert {k: sorted(map(tuple, run().collect())) for k, run in runs.items()} == want


def test_ways_are_counted_as_moves_lists_them():
    """The k-th way is the k-th move, with twin edges, edges without length and loops; counting holds no list of places."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 8, (2, 14)), rng.choice([0.5, 1.0, 1.7, 3.0], 14), strict=True)] + [(20, 21, 0.0), (21, 22, 1.0), (22, 20, 2.0)]
    g = simulate.Graph(edges)
    for a, b in list(g.weight):
        for d in (0.3, 1.0, 2.6):
            at = simulate.Position(a, b, 0.25)
            found = [p for p, _ in g.moves(at, d, 6)]
            assert [g.way(at, d, k, 6) for k in range(g.ways(at, d, 6))] == found
    hub = simulate.Graph([(a, b, 1.0) for a in range(100) for b in range(a)])
    tracemalloc.start()
    n = hub.ways(simulate.Position(0, 1, 0.5), 2.6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(hub.moves(simulate.Position(0, 1, 0.5), 2.6)) > 900_000 and peak < 3_000_000


def test_large_graphs_are_sent_once_for_some_walkers(spark, monkeypatch):
    """A graph beyond the bound passes each task of walkers once, however many steps they take, and is kept in a file there."""
    n = 400
    rng = np.random.default_rng(6)
    e = spark.createDataFrame(sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (4000, 2)).tolist() if a != b}), "a long, b long").repartition(4).cache()
    arcs = 2 * e.count()
    want = sorted(map(tuple, simulate.walk_visits(e, 6, 300).collect()))
    monkeypatch.setattr(simulate, "BROADCAST_ARCS", 10)
    found = []
    rows, size = shuffled(spark, lambda: found.extend(simulate.walk_visits(e, 6, 300).collect()))
    assert sorted(map(tuple, found)) == want
    assert rows <= arcs + 2 * n + 8 and size < 40 * arcs


def test_joints_are_measured_at_once(monkeypatch):
    """The ways between branches take one set of lengths for all joints, and pieces are laid out once; both as one by one."""
    rng = np.random.default_rng(8)
    curve = curves.branching(np.cumsum(rng.normal(0, 4, (90, 3)), 0))
    one_by_one = {(k, o): curve.branches[k].arc(t) for (k, o), t in curve.joints.items()}
    assert len(one_by_one) > 8 and curve.joint_arcs().keys() == one_by_one.keys()
    assert np.allclose(list(curve.joint_arcs().values()), list(one_by_one.values()), rtol=1e-10, atol=1e-10)
    for c in curve.branches.values():
        laid = c.stack()
        c._stack = None
        assert all(np.allclose(a, b) for a, b in zip(c.stack(), laid, strict=True))
    monkeypatch.setattr(curves.Poly, "integral", lambda *_: pytest.fail("a joint measured alone"))
    assert len(curve.routes()) == len(curve.branches) * (len(curve.branches) - 1)
