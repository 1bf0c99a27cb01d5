"""Long forms on disk: round trips, filters, appends, errors, streams."""

import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from millrace.sources import tables
from millrace.streaming import online

ROWS = [('a "quoted", name', "mean", 0.1), (" blanks ", "mean", -1e-300), ("|", "max", math.inf), ("", "max", math.nan), (None, "max", None), ("x=y/z%", "a/b=c d", 5e-324), ("é\t", None, 1.7976931348623157e308), ("twice", "mean", 1.0), ("twice", "mean", 1.0)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "series_type string, feature_name string, value double").selectExpr("*", "1 as other")


def shown(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip_appends_and_streams(spark, tmp_path, fmt):
    path = str(tmp_path / "long")
    tables.write_long(frame(spark), path, "features", fmt)
    back = tables.read_long(spark, path, "features", fmt)
    assert back.columns == ["series_type", "feature_name", "value"]
    want = [(k or (None if fmt == "csv" else k), f, v) for k, f, v in ROWS]
    assert shown(back) == shown(frame(spark, want).drop("other"))
    with pytest.raises(PySparkException):
        tables.write_long(frame(spark), path, "features", fmt)
    tables.write_long(frame(spark, [("later", "median", 3.0)]), path, "features", fmt, "append")
    assert shown(online.drained(tables.stream_long(spark, path, "features", fmt, files=2), "test")) == shown(tables.read_long(spark, path, "features", fmt)) and tables.read_long(spark, path, "features", fmt).count() == len(ROWS) + 1


def test_filters_leave_out_folders_and_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "long")
    tables.write_long(frame(spark), path, "features")
    got = tables.read_long(spark, path, "features").where("feature_name = 'mean' and series_type = 'twice'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(feature_name" in plan and "EqualTo(series_type,twice)" in plan
    assert got.count() == 2


def test_broken_files_and_names(spark, tmp_path):
    with pytest.raises(PySparkException, match="line break"):
        tables.write_long(frame(spark, [("two\nlines", "mean", 1.0)]), str(tmp_path / "a"), "features")
    tables.write_long(frame(spark, [("two\nlines", "mean", 1.0)]), str(tmp_path / "b"), "features", "parquet")
    assert tables.read_long(spark, str(tmp_path / "b"), "features", "parquet").first()["series_type"] == "two\nlines"
    folder = tmp_path / "c" / "feature_name=mean"
    folder.mkdir(parents=True)
    (folder / "x.csv").write_text("series_type,value\na,one\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        tables.read_long(spark, str(tmp_path / "c"), "features").collect()
    (folder / "x.csv").write_text("value,series_type\n1,a\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        tables.read_long(spark, str(tmp_path / "c"), "features").collect()


def test_an_empty_frame_can_be_read_back(spark, tmp_path):
    path = str(tmp_path / "none")
    tables.write_long(frame(spark).limit(0), path, "features")
    assert tables.read_long(spark, path, "features").collect() == []
