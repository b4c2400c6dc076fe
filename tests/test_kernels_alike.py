"""Kernels of one group: quicker ways give the rows of the plain ones, and groups stay dealt over many tasks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailspark.operators import curves, graph, quality
from trailspark.plans import queries
from trailspark.sources import tables


@pytest.mark.parametrize("whole", [True, False])
def test_dense_groups_equal_sparse_ones(monkeypatch, whole):
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 80):
        p = np.unique(rng.integers(0, 9, (n, 3)).astype(float) if whole else rng.normal(0, 6, (n, 3)), axis=0)
        near, tree = graph.simplify(p, 3.0), graph.spanning_tree(p)
        with monkeypatch.context() as m:
            m.setattr(graph, "DENSE", 0)
            assert np.array_equal(near, graph.simplify(p, 3.0))
            assert tree == graph.spanning_tree(p)


def test_cells_left_out_hold_no_nearest_place():
    rng = np.random.default_rng(4)
    curve = curves.spline(np.cumsum(rng.normal(0, 4, (40, 3)), 0), smooth=True)
    points = np.cumsum(rng.normal(0, 4, (60, 3)), 0)
    d2, t = curves.cubic_minima(*curve.stack(), points)
    fine = np.array([curve(x) for x in np.linspace(curve.lo, curve.hi, 4000)])
    brute = ((points[:, None] - fine[None]) ** 2).sum(2).min(1)
    assert (d2.min(1) <= brute + 1e-9).all()
    for k, p in enumerate(points):  # many at once as one by one
        assert curve.closest(p) == (d2[k].min(), t[k][d2[k] <= d2[k].min() + curves.EPS].min())


def test_groups_that_lie_by_key_are_dealt_again(spark):
    rows = spark.range(400).withColumn("k", F.col("id") % 20).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert graph.spread(rows, "k").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_layers_are_those_of_one_partition_or_many(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2)) if a != b})
    e = spark.createDataFrame(pairs, "a long, b long")
    near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in range(60)}
    want, layer, h = {0: 0}, {0}, 0
    while layer:
        h += 1
        layer = {m for n in layer for m in near[n]} - set(want)
        want |= dict.fromkeys(layer, h)
    for most in (8, graph.ARCS):
        assert {r.node: r.hops for r in graph.hop_distances(e, 0, most).collect()} == want


def test_partitions_follow_the_rows(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(1)
    assert (graph.sized(df, 0), graph.sized(df, 10, 10), graph.sized(df, 10 * n + 1, 10)) == (n, n, n + 1)


def test_filters_send_points_not_pairs(spark, sf_dir):
    """Rows of pairs stay where their track is, however large the files look."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("filter_short_tracks", "base_timestep_filter", "reduce_data", "filter_displacements"):
            plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(track_id" in plan and "hashpartitioning(date" not in plan and "SortMergeJoin [exp_id" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    d = tables.displacements(spark, sf_dir)
    by_id, by_all = (sorted(map(str, quality.moving_tracks(d, 300, k).collect())) for k in (("track_id",), quality.TRACK))
    assert by_id == by_all and 0 < len(by_id) < d.count()
