"""The grid from SQL: against the joined grid, short cases, and bounds on memory and arguments."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import table_functions as tf
from millrace.operators.series import Series, fill_gaps

S = Series(keys=("key",), ts="ds", value="y")


def grid(spark, rows, step, schema="key string, ds bigint, y double", **options):
    got = tf.regular_grid(spark.createDataFrame(rows, schema), S, step, **options)
    return sorted(map(tuple, got.collect()), key=repr)


def test_fills(spark):
    rows = [("a", 10, 1.0), ("a", 16, 4.0), ("a", 18, None), ("a", 22, float("nan")), ("a", 23, 9.0), ("b", None, 1.0)]
    at = range(10, 23, 2)
    assert grid(spark, rows, "2s") == [("a", t, y) for t, y in zip(at, (1.0, None, None, 4.0, None, None, None), strict=True)]
    assert grid(spark, rows, "2s", fill="previous") == [("a", t, y) for t, y in zip(at, (1.0, 1.0, 1.0, 4.0, 4.0, 4.0, 4.0), strict=True)]
    assert grid(spark, rows, "2s", fill="linear") == [("a", t, y) for t, y in zip(at, (1.0, 2.0, 3.0, 4.0, None, None, None), strict=True)]


def test_ties_and_null_keys(spark):
    rows = [(None, 0, None), (None, 0, 5.0), (None, 0, 3.0), (None, 2, 7.0), ("a", 4, None)]
    assert grid(spark, rows, "1s", fill="linear") == sorted([(None, 0, 3.0), (None, 1, 5.0), (None, 2, 7.0), ("a", 4, None)], key=repr)
    assert grid(spark, [], "1s") == []


def test_months_stay_cut(spark):
    rows = [("a", dt.date(2024, 1, 31), 1.0), ("a", dt.date(2024, 4, 29), 4.0)]
    want = [("a", dt.date(2024, m, d), y) for m, d, y in ((1, 31, 1.0), (2, 29, 2.0), (3, 29, 3.0), (4, 29, 4.0))]
    assert grid(spark, rows, "1mo", "key string, ds date, y double", fill="linear") == want


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_as_joined(spark, sf, kind):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("key"), F.date_trunc("minute", "ts").alias("ds"), "value", F.lit(1).alias("other"))
    e = e.groupBy("key", "ds").agg(F.min("value").alias("y"), F.max("other").alias("other"))
    want = fill_gaps(e, S, "1m").select("key", "ds", "y")
    got = tf.regular_grid(e.withColumn("ds", F.col("ds").cast(kind)), S, "1m").withColumn("ds", F.col("ds").cast("timestamp"))
    assert got.count() == want.count() > 1000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_change_of_clocks(spark):
    """Hours go on evenly where clocks change; days by months keep the zone's hour."""
    df = spark.sql("select 'a' as key, timestamp'2024-10-26 22:30:00Z' + make_interval(0, 0, 0, 0, h) as ds, 1.0d as y from values (0), (5) v(h)")
    got = tf.regular_grid(df, S, "1h").selectExpr("unix_seconds(ds) as t").collect()
    assert [r["t"] - got[0]["t"] for r in sorted(got)] == [3600 * k for k in range(6)]
    df = spark.sql("select 'a' as key, ds, 1.0d as y from values (timestamp'2024-10-15 10:00:00Z'), (timestamp'2024-12-15 11:00:00Z') v(ds)")
    got = tf.regular_grid(df, S, "1mo", zone="Europe/Berlin").selectExpr("cast(ds as string) as t").collect()
    assert sorted(r["t"] for r in got) == ["2024-10-15 10:00:00", "2024-11-15 11:00:00", "2024-12-15 11:00:00"]


def test_long_gap(spark):
    """Two rows 300,000 steps apart: rows leave one by one."""
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 300_000, 3.0)], "key string, ds bigint, y double")
    out = tf.regular_grid(df, S, "1s", fill="linear").agg(F.count("y"), F.max("ds"), F.sum("y")).first()
    assert out[:2] == (300_001, 300_000) and abs(out[2] - 450_001.5) < 1e-3


def test_arguments_are_checked(spark):
    tf.register(spark)
    spark.sql("select 'a' as key, date'2024-01-01' as ds, 1 as y, 'x' as z").createOrReplaceTempView("grid_input")
    good = {"keys": "array('key')", "time": "'ds'", "value": "'y'", "step": "'1d'"}
    run = lambda x: spark.sql(f"select * from regular_grid(TABLE(grid_input), {', '.join(f'{k} => {v}' for k, v in x.items())})")
    assert run(good).schema.simpleString() == "struct<key:string,ds:date,y:double>"
    for change in ({"step": "'1h'"}, {"step": "'x'"}, {"fill": "'cubic'"}, {"value": "'z'"}, {"time": "'none'"}, {"keys": "array('ds')"}, {"zone": "'Nowhere'"}):
        with pytest.raises(Exception, match="regular_grid|TABLE_VALUED|UDTF|ANALYZE"):
            run(good | change)
