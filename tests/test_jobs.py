"""The jobs end to end on small made-up data."""

import json

import numpy as np
import pytest

from trailspark.__main__ import main, parser
from trailspark.plans import jobs
from trailspark.sources import files


@pytest.fixture(scope="module")
def network(tmp_path_factory):
    p = tmp_path_factory.mktemp("net") / "g.mxf"
    ids = range(3, 9)
    p.write_text('<Model nodeNumber="6">\n' + "".join(f'<NetworkNode id="{i}" xf="{4 * i}" yf="{i % 2}" zf="0" radius="1" type="1" />\n' for i in ids) + "".join(f'<NetworkSegment start="{i}" end="{i + 1}" />\n' for i in range(3, 8)))
    return str(p)


def test_imaging_to_fits(spark, tmp_path):
    rng = np.random.default_rng(0)
    for date, exp in (("191205", "m1"), ("191206", "m2")):
        d = tmp_path / "data" / date / exp
        d.mkdir(parents=True)
        (d / "time.time").write_text("10\n")
        n, k = 12, 4
        pos = np.concatenate([np.cumsum(np.c_[rng.uniform(4, 9, n), rng.normal(0, 1, (n, 2))], axis=0) for _ in range(k)])
        e = np.array([[i, i + 1] for i in range(n * k - 1) if i % n != n - 1])
        np.savez(d / "Spots 1.npz", track_ids=e[:, 0] // n, track_edges=e, times=np.tile(np.arange(n), k), positions=pos)
        np.savez(d / "1.npz", data=np.ones((2, 2, 2)))
    jobs.map_tracks(spark, str(tmp_path / "data"), str(tmp_path / "d.csv"))
    d = files.displacement_csv(spark, str(tmp_path / "d.csv"))
    assert {(r.date, r.experiment) for r in d.select("date", "experiment").distinct().collect()} == {("191205", "m1"), ("191206", "m2")}
    assert d.where("disp < strt_disp - 1e-6 and strt_disp < 0").count() == 0 and d.where("lag % 10 <> 0").count() == 0
    (tmp_path / "b.json").write_text(json.dumps({"10.0": ["191205/m1", "191206/m2"]}))
    b = str(tmp_path / "b.json")
    jobs.reduce_data(spark, str(tmp_path / "d.csv"), str(tmp_path / "r.csv"), b)
    jobs.analyse(spark, str(tmp_path / "r.csv"), str(tmp_path / "a"), 10, b)
    means = spark.read.option("header", True).csv(str(tmp_path / "a" / "means10.csv"))
    assert means.count() >= 5 and spark.read.parquet(str(tmp_path / "a" / "disp_10")).count() > 0
    jobs.fit(spark, str(tmp_path / "r.csv"), str(tmp_path / "f"), 10, 20, b)
    assert {r.lag for r in files.fit_json(spark, str(tmp_path / "f" / "fits.json")).select("lag").distinct().collect()} == {10, 20}
    assert spark.read.parquet(str(tmp_path / "f" / "curves")).where("density >= 0").count() > 0
    lost, left = jobs.check_surfaces(spark, str(tmp_path / "data"))
    assert lost.count() == 0 and sorted(r.track_id for r in left.collect()) == [0, 2, 3]


def test_simulation_to_displacements(spark, tmp_path, network):
    jobs.walk(spark, network, str(tmp_path / "w"), 3, 8, "normal", [0.1, 2.0, 0.5])
    assert spark.read.option("header", True).csv(str(tmp_path / "w" / "positions.csv")).count() == 24
    cover = spark.read.option("header", True).csv(str(tmp_path / "w" / "coverage.csv"))
    assert cover.count() == 8 and cover.where("cast(coverage as double) > 1").count() == 0
    assert json.loads(spark.read.text(str(tmp_path / "w" / "metadata.json")).first().value)["movement"] == "normal"
    spark.read.parquet(str(tmp_path / "w" / "places")).select("cell_id", "iteration", "x", "y", "z").write.option("header", True).csv(str(tmp_path / "sim.csv"))
    jobs.map_simulated(spark, str(tmp_path / "sim.csv"), str(tmp_path / "sd.csv"), exclude_ends=False)
    assert {r.date for r in files.displacement_csv(spark, str(tmp_path / "sd.csv")).select("date").distinct().collect()} == {"000000"}
    main(["sweep", network, str(tmp_path / "s.csv"), "1", "5", "2", "--steps", "60"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "s.csv")).collect()
    assert [r["number of tcells"] for r in rows] == ["1", "3", "5"] and {r["graph size"] for r in rows} == {"6"}
    jobs.adjacency(spark, network, str(tmp_path / "adj"))
    assert spark.read.text(str(tmp_path / "adj")).count() == 6


def test_options():
    o = parser().parse_args(["walk", "n", "o", "3", "4", "normal", "--params", "0.1", "2"])
    assert (o.cells, o.params, o.seed) == (3, [0.1, 2.0], 0)
    o = parser().parse_args(["analyse", "i", "o", "10", "--simulated"])
    assert o.simulated is True and o.base == 10 and o.timesteps is None
