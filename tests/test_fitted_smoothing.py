"""Smoothing fitted by composed chunks, against the recursion and the kernel."""

import datetime as dt
import random

import numpy as np
import pytest

from millrace.kernels import smoothing as kernel
from millrace.kernels.numeric import interval_z
from millrace.operators import smoothing
from millrace.operators.series import Series

S = Series(keys=("key",), ts="ds", value="y")
SCHEMA = "key string, ds bigint, y double, i int, alpha string"


def fitted(spark, table, **options):
    return smoothing.fit_ses(spark.createDataFrame(table, SCHEMA), S, 3, **options).orderBy("key", "h").collect()


def walk(n, rate, seed):
    rng, level, out = random.Random(seed), 10.0, []
    for _ in range(n):
        e = rng.gauss(0, 1)
        out.append(level + e)
        level += rate * e
    return out


@pytest.mark.parametrize("rows, fan", [(2, 2), (7, 3), (1024, 512)])
def test_chunks_compose(spark, monkeypatch, rows, fan):
    """Several levels of the tree, missing values, a null key; other columns clash by name."""
    monkeypatch.setattr(smoothing, "FAN", fan)
    data = {"a": walk(60, 0.3, 1), None: walk(41, 0.9, 2), "b": [5.0], "c": [2.0, 2.0, 2.0], "d": []}
    table = [(k, t * 2, v, 0, "x") for k, y in data.items() for t, v in enumerate(y)]
    table += [("a", 31, None, 0, "x"), ("a", 33, float("nan"), 0, "x"), ("d", 0, None, 0, "x")]
    random.Random(3).shuffle(table)
    got = {}
    for r in fitted(spark, table, rows=rows):
        got.setdefault(r["key"], []).append(r)
    assert set(got) == {"a", None, "b", "c"}
    for k, path in got.items():
        y, alpha = data[k], path[0]["alpha"]
        assert [r["h"] for r in path] == [1, 2, 3] and path[0]["n"] == len(y)
        assert path[0]["sse"] == pytest.approx(kernel.ses_sse(y, alpha), rel=1e-12, abs=1e-12)
        fit = kernel.ses(np.array(y), 3, alpha)
        assert [r["yhat"] for r in path] == pytest.approx(fit.point.tolist(), rel=1e-12)
        half = interval_z(0.95) * np.sqrt(fit.variance)
        assert [r["hi"] - r["yhat"] for r in path] == pytest.approx(half.tolist(), rel=1e-9, abs=1e-12)
        best = kernel.ses(np.array(y), 3)
        assert path[0]["sse"] <= kernel.ses_sse(y, best.info["alpha"]) * (1 + 1e-7) + 1e-12


def test_least_of_a_fine_scan(spark):
    y = walk(300, 0.55, 9)
    got = fitted(spark, [("a", t, v, 0, "x") for t, v in enumerate(y)], rows=50)[0]
    scan = np.linspace(smoothing.LOW, smoothing.HIGH, 4001)
    sums = [kernel.ses_sse(y, a) for a in scan]
    assert got["sse"] <= min(sums) * (1 + 1e-9) and abs(got["alpha"] - scan[int(np.argmin(sums))]) < 5e-4


def test_no_rows_and_no_keys(spark):
    assert fitted(spark, []) == []
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=t), v) for t, v in enumerate(walk(30, 0.4, 5))], "ds timestamp, y double")
    got = smoothing.fit_ses(df, Series(keys=(), ts="ds", value="y"), 1, rows=8).collect()
    assert len(got) == 1 and got[0]["sse"] == pytest.approx(kernel.ses_sse(walk(30, 0.4, 5), got[0]["alpha"]))


def test_bad_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    for bad in ({"points": 2}, {"rounds": 0}):
        with pytest.raises(ValueError):
            smoothing.fit_ses(df, S, 3, **bad)
