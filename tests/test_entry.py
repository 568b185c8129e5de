"""The driver's contract, and every tracking query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from floetrack import queries


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    return sorted(tuple(fixed(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    df = queries.queries()[name](spark, small)
    rel = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), rel.columns)


def test_polar_inverse_past_the_pole(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate([0.0, 100.0, 492.64, 492.65, 531.2, 560.21, None, -600.0] * 50)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    rel = duckdb.sql(queries.oracle_sql()["polar_inverse"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'"))
    df = queries.queries()["polar_inverse"](spark, str(tmp_path))
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), rel.columns)


def test_polar_inverse_at_the_pole(spark):
    from pyspark.sql import functions as F

    from floetrack.functions import geo

    rows = spark.createDataFrame([(0.0, 0.0, 33.0), (None, None, 33.0), (float("nan"), 1.0, 33.0)], "x double, y double, m double")
    lon, lat = geo.polar_inverse(F.col("x"), F.col("y"), F.col("m"))
    got = rows.select(lon.alias("lon"), lat.alias("lat")).collect()
    assert [r.lon for r in got] == [33.0] * 3 and got[0].lat == 90.0 and got[1].lat is None and got[2].lat != got[2].lat
