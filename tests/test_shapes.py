import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from trailspark.operators import shapes


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=30), st.floats(0, 1.5))
def test_smallest_box(points, turn):
    r = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    p = np.array(points, float) @ r.T
    box = shapes.smallest_box(p)
    # no rotation on a fine grid does better, and all points are inside
    for a in np.linspace(0, np.pi / 2, 91):
        q = p @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        assert box.area <= np.prod(np.ptp(q, axis=0)) + 1e-6
    q = p @ np.array([[np.cos(box.angle), -np.sin(box.angle)], [np.sin(box.angle), np.cos(box.angle)]])
    assert np.ptp(q[:, 0]) == pytest.approx(box.width, abs=1e-9) and np.ptp(q[:, 1]) == pytest.approx(box.height, abs=1e-9)


def test_alignment():
    rng = np.random.default_rng(0)
    flat = np.stack([rng.uniform(-20, 20, 200), rng.uniform(-3, 3, 200), rng.uniform(-0.1, 0.1, 200)], 1)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    m = shapes.alignment(flat @ turn.T)
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    size = np.ptp(flat @ turn.T @ m.T, axis=0)
    assert size[0] > 35 and sorted(size)[0] < 1.5
    assert np.allclose(shapes.rotation_onto(np.array([-2.0, 0, 0])) @ [-2, 0, 0], [2, 0, 0])


def test_clouds_and_orders(spark):
    a = shapes.sinusoid(spark, 50, 3).collect()
    assert a == shapes.sinusoid(spark, 50, 3).collect() and a != shapes.sinusoid(spark, 50, 4).collect()
    ids = [r.id for r in shapes.shuffled(spark.range(30), "id", seed=1).collect()]
    assert sorted(ids) == list(range(30)) != ids == [r.id for r in shapes.shuffled(spark.range(30).repartition(5), "id", seed=1).collect()]


def test_random_polynomials_and_normals(spark):
    from trailspark.operators import curves, shapes

    got = shapes.random_polynomials(spark, 300, 3, 1, 4, -2.0, 2.0).collect()
    assert {len(r.coef) for r in got} == {1, 2, 3, 4} and all(-2 <= c < 2 for r in got for c in r.coef)
    assert got == shapes.random_polynomials(spark, 300, 3, 1, 4, -2.0, 2.0).collect()
    v = spark.createDataFrame([(1, [1.0, 2.0, -2.0]), (2, [0.0, 3.0]), (3, [0.0, 0.0, 0.0])], "id long, v array<double>")
    n = {r.id: (r.v, r.n) for r in v.select("id", "v", shapes.random_normal(F.col("v"), 0.5, F.col("id")).alias("n")).collect()}
    assert all(abs(sum(a * b for a, b in zip(*n[k], strict=True))) < 1e-12 and abs(sum(b * b for b in n[k][1]) - 0.25) < 1e-12 for k in (1, 2)) and n[3][1] == [0, 0, 0]
    p = curves.Poly.of([([1.0], -5, 2), ([0.0, 1.0], 0, 3)])
    assert (p.lo, p.hi, p(1.5).tolist()) == (0, 2, [1.0, 1.5])
    assert curves.Poly.of([([0.0, 2.0], -1, 1)], 0)(0.5).tolist() == [0.5, 1.0]
    with pytest.raises(ValueError, match="in common"):
        curves.Poly.of([([1.0], 0, 1), ([1.0], 2, 3)])
