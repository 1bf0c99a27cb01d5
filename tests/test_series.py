"""Spark operators on small hand-made series: isolation of keys, order, gaps, edges."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import features
from millrace.kernels.registry import MODELS
from millrace.operators import detect, evaluate, forecast, series, transforms
from millrace.operators.series import Series
from millrace.sources import tables

S = Series(("key",), "ds", "y")


def days(n, start=dt.datetime(2024, 1, 1)):
    return [start + dt.timedelta(days=k) for k in range(n)]


def frame(spark, data):
    """Rows of several series, shuffled."""
    rows = [(k, d, float(v) if v is not None else None) for k, ys in data.items() for d, v in zip(days(len(ys)), ys, strict=True)]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "key string, ds timestamp, y double")


def test_frequency_strings():
    assert series.parse_frequency("30m").seconds == 1800 and series.parse_frequency("2 weeks").seconds == 14 * 86400
    assert series.parse_frequency("1q").months == 3 and series.parse_frequency("1y").months == 12 and series.parse_frequency(5).seconds == 5
    for bad in ("h", "0d", "1x", "", -1):
        with pytest.raises(ValueError):
            series.parse_frequency(bad)


def test_months_stay_cut(spark):
    rows = [("a", dt.datetime(2024, 1, 31), 1.0), ("a", dt.datetime(2024, 5, 31), 2.0), ("a", dt.datetime(2024, 3, 29), 3.0)]
    got = series.fill_gaps(spark.createDataFrame(rows, "key string, ds timestamp, y double"), S, "1mo").orderBy("ds").collect()
    assert [r["ds"].day for r in got] == [31, 29, 29, 29, 29] and [r["y"] for r in got] == [1.0, None, 3.0, None, None]


def test_missing_and_infinite(spark):
    df = frame(spark, {"a": [1, None, float("nan"), 4, float("inf")], "b": [2.0]})
    assert {r["key"]: r["has_missing"] for r in series.has_missing(df, S).collect()} == {"a": True, "b": False}
    ys = lambda d, k="a": [r["y"] for r in d.where(F.col("key") == k).orderBy("ds").collect()]
    assert ys(series.sanitize(df, S, "drop")) == [1, 4] and ys(series.sanitize(df, S, "fill", 9)) == [1, 9, 9, 4, 9]
    assert ys(series.sanitize(df, S, "forward")) == [1, 1, 1, 4, 4]
    assert ys(series.interpolate(df, S)) == [1, 2, 3, 4, None] and ys(series.interpolate(df, S, True)) == [1, 2, 3, 4, 4]
    with pytest.raises(Exception, match="missing value"):
        series.sanitize(df, S, "error").collect()
    x = features.features(frame(spark, {"n": [None, None], "o": [3.0]}), S, ["mean", "variance", "kurtosis", "mean_change", "number_peaks"]).orderBy("key").collect()
    assert [x[0]["mean"], x[0]["variance"], x[0]["kurtosis"]] == [None] * 3 and (x[1]["mean"], x[1]["variance"], x[1]["mean_change"]) == (3.0, 0.0, None)


def test_features_by_numpy(spark):
    rng = np.random.default_rng(1)
    data = {k: rng.integers(0, 6, n).astype(float) for k, n in (("a", 50), ("b", 37))}
    wanted = ["abs_energy", "skewness", "kurtosis", "mean_second_derivative_central", "cid_ce", ("quantile", {"q": 0.3}), ("number_peaks", {"support": 2}), "longest_strike_above_mean", "longest_strike_below_mean",
              ("autocorrelation", {"lag": 2}), ("c3", {"lag": 2}), "last_location_of_maximum", "first_location_of_minimum", "binned_entropy", "permutation_entropy", ("agg_linear_trend", {"chunk_len": 5, "f": "max"}),
              "ratio_value_number_to_time_series_length", "sum_of_reoccurring_values", ("change_quantiles", {"ql": 0.0, "qh": 0.8}), ("time_reversal_asymmetry_statistic", {"lag": 2}), "has_duplicate"]
    for r in features.features(frame(spark, data), S, wanted).collect():
        y = data[r["key"]]
        n, mu, sd = len(y), y.mean(), y.std()
        z = (y - mu) / sd
        run = lambda f: max([len(s) for s in "".join("1" if v else "0" for v in f).split("0")])
        counts = np.unique(y, return_counts=True)
        chunks = np.array([y[i:i + 5].max() for i in range(0, n, 5)])
        lo, hi = np.quantile(y, [0.0, 0.8])
        inside = [b - a for a, b in zip(y[:-1], y[1:], strict=True) if lo <= a <= hi and lo <= b <= hi]
        orders = [tuple(np.argsort(y[i:i + 3], kind="stable")) for i in range(n - 2)]
        p = np.unique(orders, axis=0, return_counts=True)[1] / len(orders)
        h = np.histogram(y, 10)[0] / n
        want = {
            "abs_energy": (y**2).sum(), "skewness": n / ((n - 1) * (n - 2)) * (z**3).sum(), "kurtosis": n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (z**4).sum() - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)),
            "mean_second_derivative_central": ((y[2:] - 2 * y[1:-1] + y[:-2]) / 2).mean(), "cid_ce": np.sqrt((np.diff(z) ** 2).sum()), "quantile__q_0_3": np.quantile(y, 0.3),
            "number_peaks__support_2": sum(y[i] > max(y[i - 2:i].max(), y[i + 1:i + 3].max()) for i in range(2, n - 2)), "longest_strike_above_mean": run(y > mu), "longest_strike_below_mean": run(y < mu),
            "autocorrelation__lag_2": ((y[2:] - mu) * (y[:-2] - mu)).sum() / ((n - 2) * sd**2), "c3__lag_2": (y[:-4] * y[2:-2] * y[4:]).mean(), "last_location_of_maximum": 1 - np.argmax(y[::-1]) / n,
            "first_location_of_minimum": np.argmin(y) / n, "binned_entropy": -(h[h > 0] * np.log(h[h > 0])).sum(), "permutation_entropy": -(p * np.log(p)).sum(), "agg_linear_trend__chunk_len_5__f_max": np.polyfit(np.arange(len(chunks)), chunks, 1)[0],
            "ratio_value_number_to_time_series_length": len(counts[0]) / n, "sum_of_reoccurring_values": counts[0][counts[1] > 1].sum(), "change_quantiles__ql_0_0__qh_0_8": np.mean(inside),
            "time_reversal_asymmetry_statistic__lag_2": (y[4:] ** 2 * y[2:-2] - y[2:-2] * y[:-4] ** 2).mean(), "has_duplicate": True}
        for k, v in want.items():
            assert float(r[k]) == pytest.approx(float(v), abs=1e-9), k
    assert len(features.FEATURES) == 69


def test_scaling_round_trip(spark):
    df = frame(spark, {"a": [1, 2, 3, 10], "c": [5, 5, 5]})
    for m in transforms.SCALERS:
        p = transforms.scale_parameters(df, S, m)
        back = transforms.apply_scale(transforms.apply_scale(df, S, p), S, p, inverse=True)
        assert sorted(r["y"] for r in back.collect()) == pytest.approx([1, 2, 3, 5, 5, 5, 10])
    assert [r["y"] for r in transforms.scale(df, S, "standardize").where("key = 'c'").collect()] == [0, 0, 0]
    z = df.select(transforms.boxcox(F.col("y") - 2, 0.0).alias("z")).where("z is not null").count()
    assert z == 5


def test_forecast_shape_and_status(spark):
    df = frame(spark, {"a": list(range(1, 31)), "b": [1, 2], "n": [None] * 30})
    f = forecast.forecast(df, S, ["naive", "seasonal_naive", "holt"], 3, period=7)
    got = {(r["key"], r["model"], r["h"]): r for r in f.collect()}
    assert got[("a", "naive", 2)]["yhat"] == 30 and got[("a", "naive", 1)]["ds"] == dt.datetime(2024, 1, 31)
    assert got[("a", "seasonal_naive", 3)]["yhat"] == 26 and got[("a", "holt", 3)]["yhat"] == pytest.approx(33, rel=1e-3)
    assert got[("b", "seasonal_naive", None)]["status"] == "insufficient_data" and got[("n", "naive", None)]["status"] == "missing_values"
    assert forecast.forecast(df, S, ["naive"], 0).count() == 0
    e = forecast.ensemble(f, S, "mean").where("key = 'a' and h = 1").first()
    assert e["models"] == 3 and e["yhat"] == pytest.approx((30 + 24 + 31) / 3, rel=1e-3)
    assert len(MODELS) == 31  # thirty models; Croston under two names


def test_interval_coverage(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, {f"s{k}": 100 + np.cumsum(rng.normal(0, 1, 60)) for k in range(40)})
    train = series.slice_rows(df, S, 0, 50)
    f = forecast.forecast(train, S, ["naive"], 10).join(df.select("key", "ds", F.col("y").alias("actual")), ["key", "ds"])
    assert f.select(F.avg(F.when(F.col("actual").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0))).first()[0] > 0.85


def test_bootstrap_bounds(spark):
    rng = np.random.default_rng(3)
    b = evaluate.bootstrap_forecast(frame(spark, {"a": 50 + rng.normal(0, 2, 60)}), S, "ses", 4, 60).collect()
    assert len(b) == 4 and all(r["lo"] <= r["hi"] for r in b)


def test_detection(spark):
    y = [float(v) for v in np.tile([1, 5, 9, 5], 20)]
    df = frame(spark, {"a": y, "b": [*([1.0, 2.0, 3.0] * 10), 100.0]})
    assert detect.detect_seasonality(df, S, 2, 20).where("key = 'a'").first()["period"] == 4
    assert [r["y"] for r in detect.outliers(df, S).where("is_outlier").collect()] == [100.0]
    parts = detect.decompose(df.where("key = 'a'"), S, 4)
    assert detect.strengths(parts, S).first()["seasonal_strength"] > 0.95
    seg = detect.pelt(frame(spark, {"a": [0.0] * 20 + [9.0] * 20}), S, "l2", 5.0)
    assert [(r["start"], r["end"]) for r in seg.orderBy("segment").collect()] == [(0, 20), (20, 40)]
    points = series.prepare(frame(spark, {"a": [0.0] * 20 + [9.0] * 20}), S)
    assert detect.segment_for_index(seg, points, S).groupBy("segment").count().count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "wave.csv").write_text("timestamp,value\n2020-01-01,1.5\n2020-01-31,2.5\n")
    got = tables.read_series_csv(spark, str(tmp_path)).orderBy("ds").collect()
    assert [(r["series_id"], r["y"]) for r in got] == [("wave", 1.5), ("wave", 2.5)]
    f = forecast.forecast(frame(spark, {"a": [1, 2, 3]}), S, ["naive"], 2)
    tables.write_table(tables.long_forecasts(f, S), str(tmp_path / "f.csv"), "csv")
    assert tables.read_table(spark, str(tmp_path / "f.csv")).columns == ["series_type", "model", "step", "forecast"]
    assert tables.long_intervals(f, S).count() == 2
    assert tables.long_features(features.features(frame(spark, {"a": [1, 2, 3]}), S, ["mean", "maximum"]), S).count() == 2


def test_streams(spark, tmp_path):
    from millrace.streaming import online

    df = frame(spark, {"a": [1, 2, 3, 4], "b": [5, 6]})
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.running_ewm(stream, S, 0.5).writeStream.format("memory").queryName("ewm").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["key"], r["ds"]): r["ewm_mean"] for r in spark.table("ewm").collect()}
    want = {(r["key"], r["ds"]): r["ewm_mean"] for r in transforms.ewm(df, S, 0.5).collect()}
    assert got == pytest.approx(want)
    q = online.resample(stream, S, "2 days", "1 day").writeStream.format("memory").queryName("res").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert online.resample(df, S, "2 days").count() == 5 and spark.table("res").count() >= 1
