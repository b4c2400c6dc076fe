"""Column functions, filters and histograms on edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from trailspark.functions import densities, text, vectors
from trailspark.operators import hist, joins, quality, stats, surfaces, tracks
from trailspark.sources.schema import nan_to_null

NAN = float("nan")


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_vectors(spark):
    a, b = vec(1, 2, 2), vec(0, 3, 4)
    assert one(spark, vectors.dot(a, b)) == 14 and one(spark, vectors.length(a)) == 3
    assert one(spark, vectors.cross(vec(1, 0, 0), vec(0, 1, 0))) == [0, 0, 1]
    assert one(spark, vectors.angle(a, vectors.scale(a, 3))) == pytest.approx(0, abs=1e-7)
    assert one(spark, vectors.unit(vectors.zero(2))) == [None, None]
    assert one(spark, vectors.component(a, 7)) is None
    assert one(spark, vectors.nearly_equal(a, vec(1, 2))) and not one(spark, vectors.nearly_equal(a, vec(1, 2.1)))
    assert one(spark, vectors.linspace(F.lit(0.0), F.lit(1.0), 5)) == [0, 0.25, 0.5, 0.75, 1]
    assert one(spark, vectors.polynomial(vec(1, 2, 3), F.lit(2.0))) == 17
    assert one(spark, vectors.derivative(vec(1, 2, 3))) == [2, 6]
    assert one(spark, vectors.pretty(F.array(F.lit(1), F.lit(2)))) == "2 x^1 + 1 x^0"
    assert not one(spark, vectors.is_nonzero(vectors.zero(3))) and one(spark, vectors.less_equal(a, b))
    assert [one(spark, v) for v in vectors.basis(2)] == [[1, 0], [0, 1]]
    with pytest.raises(Exception, match="different dimensions"):
        one(spark, vectors.dot(a, vec(1)))


def test_text(spark):
    p = F.lit("/data/191205/mouse1/12_x_7.npz")
    assert one(spark, text.track_ids(p)) == [12, 7]
    assert one(spark, text.experiment(p)).asDict() == {"date": "191205", "experiment": "mouse1"}
    assert one(spark, text.experiment_id(F.lit("191205"), F.lit(None).cast("string"))) is None
    assert one(spark, text.track_name(F.lit("d"), F.lit(3))) == "d_3"


@pytest.mark.parametrize(("name", "params"), [("levy", [0, 1]), ("levy_l", [0, 1]), ("foldnorm", [1.5, 0, 2]), ("halfgennorm", [1.3, 0, 2]), ("gamma", [2.5, 1, 2]), ("gengamma", [1.2, 1.5, 0, 2]), ("invgamma", [3, 0, 2])])
def test_densities_integrate_to_one(spark, name, params):
    sign = -1 if name == "levy_l" else 1
    u = (F.col("id") + 0.5) / 200000
    # x = u / (1 - u) maps (0, 1) to the half line
    x = sign * u / (1 - u)
    total = spark.range(200000).select((densities.density(name, [float(p) for p in params], x) / ((1 - u) * (1 - u)) / 200000).alias("d")).agg(F.sum("d")).first()[0]
    assert total == pytest.approx(1, abs=0.01)


def test_filters_on_unknown_values(spark):
    df = spark.createDataFrame(
        [("191205", "e", "a", 10.0, 5, 60.0, 30.0), ("191205", "e", "a", 20.0, 5, 60.0, NAN), ("191205", "e", "b", 10.0, 4, 60.0, 29.9), ("191206", "e", "c", 10.0, 5, 59.9, 99.0), ("190101", "e", "d", 10.0, 9, 99.0, 99.0), ("191206", "e", "f", 10.0, 9, 99.0, None), ("191206", "e", "g", 15.0, 9, 99.0, 0.0), ("191206", "e", "g", None, 9, 99.0, 40.0)],
        "date string, experiment string, track_id string, lag double, num_points long, duration double, disp double",
    )
    d = nan_to_null(df)
    key = lambda x: sorted(((r.track_id, r.lag or 0) for r in x.collect()))
    assert key(quality.moving_tracks(df)) == key(quality.moving_tracks(d)) == [("a", 10), ("a", 20), ("c", 10), ("d", 10), ("g", 0), ("g", 15)]
    assert quality.remove_zeros(d).count() == 7
    kept = quality.filter_displacements(d)
    assert key(kept) == [("a", 10), ("a", 20), ("g", 0), ("g", 15)]
    assert kept.columns == quality.with_experiment_id(kept).columns
    base = spark.createDataFrame([(10.0, "191205/e"), (30.0, "191206/e")], "timestep double, exp_id string")
    assert key(quality.filter_displacements(d, 10, base)) == [("a", 10), ("a", 20)]
    assert quality.filter_displacements(d.where("date = 'none'")).count() == 0
    assert key(quality.filter_simulated(d, zeros=False)) == [("a", 10), ("a", 20), ("c", 10), ("d", 10), ("f", 10), ("g", 0)]
    assert quality.known(df, "disp").count() == 6


def test_statistics_on_unknown_values(spark):
    df = spark.createDataFrame([(10.0, 1.0, 1.0), (10.0, NAN, -1.0), (10.0, 3.0, None), (20.0, 5.0, NAN), (40.0, 1.0, -1.0)], "lag double, disp double, reldir double")
    assert {r.lag: r.mean for r in stats.means(df, "lag", "disp").collect()} == {10: 2, 20: 5, 40: 1}
    assert {r.lag: r.ratio for r in stats.turning_ratio(df).collect()} == {10: 0.5, 20: None, 40: 1}
    assert sorted({r.lag for r in stats.samples_over_time(df, "disp", 10, 120).collect()}) == [10, 20]
    assert stats.zero_fraction(df.limit(0)).first().asDict() == {"zeros": 0, "total": 0, "percent": None}


def test_histograms_keep_the_right_edge(spark):
    for top in (1500.0, 5000.0):
        df = spark.createDataFrame([("g", x) for x in (0.0, top / 3, top, None)], "exp_id string, x double")
        h = hist.numeric_histogram(df, "x", 30).orderBy("bin").collect()
        assert len(h) == 30 and h[-1].n == 1 and sum(r.n for r in h) == 3
    flat = spark.createDataFrame([("g", 2.0)] * 3, "exp_id string, x double")
    assert hist.numeric_histogram(flat, "x").count() == 0
    d = hist.density_histogram(spark.range(1000).select(F.lit(1.0).alias("lag"), F.col("id").cast("double").alias("x")), "x", 10)
    assert d.agg(F.sum("density")).first()[0] * 99.9 == pytest.approx(1)
    tops = spark.createDataFrame([(2.5,), (2.6,), (7.5,)], "x double")
    assert [(r.rounded, r.n) for r in hist.top_rounded(tops, "x", 5, 5).collect()] == [(5, 2), (0, 1)]


def test_tracks(spark):
    pts = spark.createDataFrame([(1, 3, 1.0, 0), (1, 0, 9.0, 1), (1, 0, 0.0, 2), (1, 1, 0.0, 3), (2, 5, 1.0, 4)], "track_id long, t long, x double, seq long")
    d = tracks.dedupe(pts, "seq").cache()
    assert sorted((r.track_id, r.t, r.x) for r in d.collect()) == [(1, 0, 0.0), (1, 1, 0.0), (1, 3, 1.0), (2, 5, 1.0)]
    pair = lambda k: sorted((r.t1, r.t2) for r in tracks.pairwise(d, k, ["x"]).collect())
    assert (pair(1), pair(2), pair(3)) == ([(0, 1)], [(1, 3)], [(0, 3)])
    for lags in (None, 3):
        assert sorted((r.t1, r.t2, r.delta) for r in tracks.all_lags(d, ["x"], lags).collect()) == [(0, 1, 1), (0, 3, 3), (1, 3, 2)]
    assert sorted((r.track_id, r.t) for r in tracks.track_slice(d, -2, None).collect()) == [(1, 1), (1, 3), (2, 5)]
    assert [(r.track_id, r.t) for r in tracks.item(d, -1).orderBy("track_id").collect()] == [(1, 3), (2, 5)]
    assert tracks.window_sample(d, 2).groupBy("track_id").count().agg(F.max("count")).first()[0] == 2
    assert tracks.window_sample(d, None).count() == 4
    assert {r.track_id: r.x for r in tracks.at_time(d, 3).collect()} == {1: 1.0, 2: None}


def test_joins(spark):
    pts = spark.createDataFrame([(1, k, float(k), 0.0, 0.0) for k in range(5)] + [(2, 0, 0.5, 0.0, 0.0)], "track_id long, t long, x double, y double, z double")
    got = sorted((r.t1, r.t2) for r in joins.radius_pairs(pts, 1.5, ["track_id"]).where("track_id = 1").collect())
    assert got == [(a, b) for a in range(5) for b in range(5) if abs(a - b) < 1.5]


def test_voxels(spark):
    block = [(0, i, j, k, 1.0 if 1 <= min(i, j, k) and max(i, j, k) <= 3 else -1.0) for i in range(5) for j in range(5) for k in range(5)]
    u = [(1, i, j, 0, 1.0 if i in (1, 3) or j == 3 and 1 <= i <= 3 else -1.0) for i in range(5) for j in range(5)]
    v = spark.createDataFrame(block + u, "t int, i int, j int, k int, v double")
    assert surfaces.interior_points(v.where("t = 0"), (0, 0, 0), (1, 1, 1)).count() == 27
    along = {r.t: r.is_function for r in surfaces.vertical_line_test(v, "j", "i").collect()}
    assert along == {0: True, 1: False}
    p = spark.createDataFrame([(0, 2.0, 2.0, 2.0), (0, 0.4, 2.0, 2.0), (0, 9.0, 2.0, 2.0)], "t int, x double, y double, z double")
    assert [r.inside for r in surfaces.lookup(p, v, (0, 0, 0), (4, 4, 4), (1, 1, 1)).orderBy("x").collect()] == [False, True, False]



def test_near_pairs_equal_pairs_at_every_lag(spark):
    """Across blocks, with gaps and with more lags than a block has frames."""
    rows = [(k, t, float((t * t * (k + 3)) % 17 - 8)) for k in range(3) for t in range(40) if (t * 7 + k) % 5 or k == 0]
    d = spark.createDataFrame(rows, "track_id long, t long, x double")
    pairs = tracks.arrivals(tracks.all_lags(d, ["x"], 6).withColumn("dir", F.signum(F.col("x2") - F.col("x1"))))
    want = sorted((r.track_id, r.t1, r.t2, r.delta, r.x1, r.x2, r.reldir or 0) for r in pairs.collect())
    for block in (4, 16, 4096):
        near = tracks.near_pairs(d, 6, ["x"], block=block)
        near = near.withColumn("reldir", F.when(F.col("before").isNotNull(), F.when(F.col("before") == F.col("dir"), 1.0).otherwise(-1.0)))
        assert sorted((r.track_id, r.t1, r.t2, r.delta, r.x, r.x2, r.reldir or 0) for r in near.collect()) == want


def test_displacements_send_a_point_a_few_times(spark, sf_dir):
    """Not once for each lag; and no side is sent whole for its small file."""
    from tests.shuffled import shuffled
    from trailspark.sources import tables

    d = tables.displacements(spark, sf_dir)
    n = tables.table(spark, sf_dir, "events").count()
    rows, _ = shuffled(spark, lambda: d.write.format("noop").mode("overwrite").save())
    assert n <= rows < 4 * n
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["filter_simulated", "displacement_table"])
def test_queries_of_pairs_send_rows_in_proportion(spark, sf_dir, tmp_path, name):
    """Twice a point at most, whatever the number of copies, and no pair."""
    from tests.shuffled import shuffled
    from trailspark.plans.queries import QUERIES
    from trailspark.sources import tables

    e = tables.table(spark, sf_dir, "events")
    n, users = e.agg(F.count("*"), F.max("user_id") + 1).first()
    for copies in (1, 4):
        d = e.crossJoin(spark.range(copies).select(F.col("id").alias("k"))).withColumns({"user_id": F.col("user_id") + F.col("k") * users, "event_id": F.col("event_id") + F.col("k") * n}).drop("k")
        d.write.parquet(str(tmp_path / str(copies) / "events.parquet"))
        rows, _ = shuffled(spark, lambda: QUERIES[name](spark, str(tmp_path / str(copies))).write.format("noop").mode("overwrite").save())
        assert n * copies <= rows <= 2 * n * copies


def test_pairs_of_tracks_are_not_broadcast(spark, sf_dir):
    """A small file may hold many rows, which radius joins repeat 27 times."""
    from trailspark.sources import tables

    t = tables.tracks(spark, sf_dir)
    for d in (joins.radius_pairs(t, 6.0, ["track_id"]), tracks.pairwise(t, 3, ["x"]), tracks.all_lags(t, ["x"], 3)):
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()


def test_candidate_pdfs_equal_sql_off_the_supports(spark, tmp_path):
    """Large tables have values beyond 799, where one family ends, and unknown ones."""
    import duckdb

    from trailspark.plans.queries import QUERIES, SQL

    values = [0.0, 560.21, 798.99, 799.0, 799.01, 900.0, 1e5, None, math.nan]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["candidate_pdfs"] + " ORDER BY event_id").fetchall()
    got = [tuple(r) for r in QUERIES["candidate_pdfs"](spark, str(tmp_path)).orderBy("event_id").collect()]
    assert list(map(str, got)) == list(map(str, want))
