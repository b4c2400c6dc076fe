"""Readers, writers and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.operators import fitting, graph, stats
from trailspark.sources import files, sinks
from trailspark.streaming import streams

HEAD = "date,experiment,track_name,time_step,num_points,duration (sec),curve_displacement (micro-m),abs_displacement_numeric_error,reldir,straight displacement (micro-m)"


def test_displacement_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text(f",{HEAD}\n0,010203,m,t1,10.0,5,60.0,1.5,0.0,,1.0\n1,010203,m,t1,20.0,5,60.0,NaN,0.0,-1.0,2.0\n")
    d = files.displacement_csv(spark, str(tmp_path / "in.csv"))
    rows = d.orderBy("lag").collect()
    assert rows[0].date == "010203" and rows[0].reldir is None and rows[1].disp is None and "_c0" not in d.columns
    sinks.displacement_csv(d, str(tmp_path / "out"))
    assert files.displacement_csv(spark, str(tmp_path / "out")).exceptAll(d).isEmpty()


def test_track_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("cell_id,iteration,x,y,z\n1,0,0,0,0\n1,0,5,5,5\n1,1.0,2,2,2\n")
    got = files.track_csv(spark, str(tmp_path / "t.csv"), "cell_id", "iteration").orderBy("t").collect()
    assert [(r.track_id, r.t, r.pos) for r in got] == [("1", 0, [5, 5, 5]), ("1", 1, [2, 2, 2])]


def test_archives(spark, tmp_path):
    d = tmp_path / "191205" / "mouse1"
    d.mkdir(parents=True)
    (d / "time.time").write_text("10.5\nrest\n")
    np.savez(d / "Spots 1.npz", track_ids=np.array([7, 7]), track_edges=np.array([[0, 1], [1, 2]]), times=np.array([0, 1, 3, 9]), positions=np.arange(12.0).reshape(4, 3))
    np.savez(d / "7_8.npz", data=np.ones((1, 1, 2, 3, 2)), **{f"{e}_{a}": np.array([v]) for a in "xyz" for e, v in (("min", 0.0), ("max", 4.0))})
    np.savez(d / "shut.npz", data=np.zeros(1))
    (tmp_path / "191206" / "none").mkdir(parents=True)
    (tmp_path / "191206" / "none" / "time.time").write_text("1")
    e, s = files.spots(spark, str(d / "Spots 1.npz"))
    got = files.tracks_of_spots(e, s).orderBy("t").collect()
    assert [(r.track_id, r.t, r.pos[0]) for r in got] == [(7, 0, 0.0), (7, 1, 3.0), (7, 3, 6.0)]
    v, b = files.surfaces(spark, str(d / "7_8.npz"))
    assert v.count() == 12 and b.first()["size"] == [4.0, 2.0, 4.0]
    x = files.experiments(spark, str(tmp_path), exclude=["shut.npz"]).collect()
    assert len(x) == 1 and (x[0].date, x[0].experiment, x[0].spf, len(x[0].surfaces)) == ("191205", "mouse1", 10.5, 1)


def test_graph_text(spark, tmp_path):
    (tmp_path / "g.mxf").write_text(
        '<Model nodeNumber="3" modelToMicrometer="1.0">\n' + "".join(f'<NetworkNode id="{i}" xf="{3 * (i - 5)}" yf="{4 * (i - 5)}" zf="0" radius="1" type="2" />\n' for i in (5, 6, 7)) + '<NetworkSegment start="5" end="6" />\n<NetworkSegment start="6" end="7" />\n'
    )
    n, e = files.graph_text(spark, str(tmp_path / "g.mxf"))
    assert sorted((r.id, r.x) for r in n.collect()) == [(0, 0.0), (1, 3.0), (2, 6.0)]
    assert sorted((r.a, r.b, r.weight) for r in e.collect()) == [(0, 1, 5.0), (1, 2, 5.0)]
    sinks.adjacency_text(graph.adjacency_text(graph.undirected(e)).coalesce(1), str(tmp_path / "adj"))
    assert [r.value for r in spark.read.text(str(tmp_path / "adj")).orderBy("value").collect()] == ["0 1", "1 0 2", "2 1"]


def test_json(spark, tmp_path):
    base = spark.createDataFrame([(10.0, "d/a"), (10.0, "d/b"), (30.0, "d/c")], "timestep double, exp_id string")
    sinks.base_timestep_json(base, str(tmp_path / "b"))
    assert files.base_timestep_json(spark, str(tmp_path / "b")).exceptAll(base).isEmpty()
    fits = spark.createDataFrame([(10.0, "levy", [0.0, 1.0], 0.5, 50), (10.0, "gamma", None, None, 50), (20.0, "levy", [0.0, 2.0], 0.25, 50)], fitting.SPEC)
    sinks.fit_json(fits, str(tmp_path / "f"))
    back = files.fit_json(spark, str(tmp_path / "f"))
    assert sorted((r.lag, r.dist, tuple(r.params), r.sse, r.sse_nbins) for r in back.collect()) == [(10.0, "levy", (0.0, 1.0), 0.5, 50), (20.0, "levy", (0.0, 2.0), 0.25, 50)]
    assert json.loads(sinks.metadata(spark, 3, 4, "brownian", [1]).first().value) == {"num_cells": 3, "total_iterations": 4, "movement": "brownian", "params": [1.0]}


def test_tables(spark, tmp_path):
    s = spark.createDataFrame([(10.0, 1.0, 2.0, 3.0, 4.0)], "lag double, mean_disp double, mean_disp_sq double, mean_strt double, mean_strt_sq double")
    sinks.means_csv(s, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == list(sinks.MEANS.values())
    v = spark.createDataFrame([(0, 9), (1, 1), (1, 2), (3, 1), (3, 3)], "iteration long, node long")
    c = stats.coverage_curve(v, 4, 4)
    assert [(r.covered, r.coverage) for r in c.orderBy("iteration").collect()] == [(2, 0.5), (2, 0.5), (3, 0.75), (3, 0.75)]
    sinks.coverage_csv(c, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "cp"))
    rows = [(1, t, float(t), 0.0, 0.0) for t in (0, 1, 2, 5)] + [(2, 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "track_id long, t long, x double, y double, z double").withColumn("ts", F.timestamp_seconds(F.col("t") * 60 + 1_000_000_020)).withColumn("lag", F.lit(1.0)).withColumn("disp", F.col("x"))
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    pairs = run(streams.arriving_displacements(src, 3), "pairs", "append")
    assert sorted((r.track_id, r.t1, r.t2, r.disp) for r in pairs.collect()) == [(1, 0, 1, 1.0), (1, 0, 2, 2.0), (1, 1, 2, 1.0), (1, 2, 5, 3.0)]
    # frame 1 of track 1 is written again five minutes later; the last row only moves the watermark
    again = spark.createDataFrame([(1, 0, 0.0, 0), (1, 1, 1.0, 60), (1, 1, 7.0, 360), (2, 0, 5.0, 0), (9, 9, 0.0, 90_000)], "track_id long, t long, x double, s long").select("track_id", "t", "x", F.timestamp_seconds(F.col("s") + 1_000_000_020).alias("ts"))
    again.write.parquet(str(tmp_path / "again"))
    once = run(streams.deduplicated(spark.readStream.schema(again.schema).parquet(str(tmp_path / "again"))), "once", "append")
    assert sorted((r.track_id, r.t, r.x) for r in once.collect()) == [(1, 0, 0.0), (1, 1, 7.0), (2, 0, 5.0)]
    means = run(streams.window_means(src, size="2 minutes"), "means", "complete")
    assert means.agg(F.sum("n")).first()[0] == 5


def test_names(spark):
    assert spark.range(1).select(sinks.tagged("x.csv", F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0] == "240102-0304_x.csv"


@pytest.mark.parametrize("n", [0, 3])
def test_empty_tables(spark, n):
    d = spark.createDataFrame([], "lag double, disp double, reldir double")
    assert stats.means(d, "lag", "disp").count() == 0 and stats.turning_ratio(d).count() == 0
    assert stats.samples_over_time(d, "disp", 10, 10 * n).count() == 0
