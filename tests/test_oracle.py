"""Every query with SQL against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from trailspark.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) if isinstance(v, float) else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_kernels_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_are_pushed_to_the_scan(spark, sf_dir):
    from trailspark.operators import quality

    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "date")
    plan = quality.on_dates(df, ["click"]).select("value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan or "EqualTo(event_type" in plan
    assert "props" not in plan
