"""Portmanteau and stationarity statistics against NumPy, in one sort and in blocks."""

import numpy as np
import pytest

from millrace.functions import stats_tests
from millrace.operators.series import Series

S = Series(keys=("key",), ts="t", value="y")


def data():
    rng = np.random.default_rng(3)
    return {"noise": rng.normal(size=300), "walk": rng.normal(size=157).cumsum() + 1e6, "flat": np.full(30, 7.0), "short": np.array([1.0, 2.0]), "four": np.array([1.0, 3.0, 2.0, 5.0])}


def frame(spark, extra=()):
    return spark.createDataFrame([(k, i, float(v)) for k, y in data().items() for i, v in enumerate(y)] + list(extra), "key string, t int, y double")


def products(y, lags):
    d = y - y.mean()
    return d @ d, [d[k:] @ d[:-k] for k in range(1, lags + 1)]


@pytest.mark.parametrize("rows", [None, 16, 4096])
def test_portmanteau(spark, rows):
    # missing values are passed over
    df = frame(spark, [("noise", 1000, None), ("noise", 1001, float("nan"))])
    lb = {r["key"]: r for r in stats_tests.ljung_box(df, S, rows=rows).collect()}
    bp = {r["key"]: r for r in stats_tests.box_pierce(df, S, 20, rows=rows).collect()}
    for key, y in data().items():
        n = len(y)
        if n < 3:
            assert lb[key]["statistic"] is None and bp[key]["lags"] is None
            continue
        lags = min(max(1, min(10, n // 5)), n - 1)
        c0, p = products(y, lags)
        assert lb[key]["lags"] == lags
        assert lb[key]["statistic"] == pytest.approx(0.0 if c0 == 0 else n * (n + 2) * sum((x / c0) ** 2 / (n - k) for k, x in enumerate(p, 1)), rel=1e-6)
        lags = min(20, n - 1)
        c0, p = products(y, lags)
        assert bp[key]["lags"] == lags and bp[key]["statistic"] == pytest.approx(0.0 if c0 == 0 else n * sum((x / c0) ** 2 for x in p), rel=1e-6)


@pytest.mark.parametrize("rows,lags", [(None, None), (16, None), (16, 3), (None, 40)])
def test_kpss(spark, rows, lags):
    got = {r["key"]: r for r in stats_tests.kpss_test(frame(spark), S, lags, rows=rows).collect()}
    for key, y in data().items():
        n = len(y)
        if n < 4:
            assert got[key]["statistic"] is None and got[key]["is_stationary"] is False
            continue
        use = max(1, min(lags or int(4 * (n / 100) ** 0.25), n // 2))
        c0, p = products(y, use)
        var = c0 / n + sum(2 * (1 - k / (use + 1)) * x / n for k, x in enumerate(p, 1))
        assert got[key]["lags"] == use
        if c0 == 0:
            assert got[key]["statistic"] is None
        else:
            assert got[key]["statistic"] == pytest.approx((np.cumsum(y - y.mean()) ** 2).sum() / n ** 2 / var, rel=1e-6)


def test_empty_frames(spark):
    empty = frame(spark).limit(0)
    assert stats_tests.ljung_box(empty, S).collect() == stats_tests.kpss_test(empty, S).collect() == stats_tests.kpss_test(empty, S, rows=16).collect() == []


def test_no_series_is_an_array(spark):
    for rows in (None, 16):
        plan = stats_tests.ljung_box(frame(spark), S, rows=rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan
