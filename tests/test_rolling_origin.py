"""Folds as window expressions against a fit of every fold."""

import random

import pytest

from millrace.operators import evaluate
from millrace.operators.forecast import specs
from millrace.operators.series import Series

S = Series()


@pytest.mark.parametrize("expanding", [True, False])
@pytest.mark.parametrize("window,horizon,step,period", [(10, 3, 2, 4), (3, 9, 1, 5), (1, 1, 4, None)])
def test_windows_equal_fits(spark, expanding, window, horizon, step, period):
    rng = random.Random(1)
    rows = [(k, i * 5, None if k == "c" and i == 17 else round(rng.uniform(-3, 9), 3)) for k, n in (("a", 40), ("b", 13), ("c", 30), ("d", 2), (None, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, ds long, y double")

    def found(models):
        out = evaluate.cross_validate(df, S, models, window, horizon, step, expanding, period)
        return {(r["key"], r["model"], r["fold"], r["h"]): (r["status"], r["yhat"]) for r in out.collect()}

    names = list(evaluate.WINDOWED)
    got, want = found(names), found(specs(names, period))
    assert got.keys() == want.keys() and len(got) > 50
    for k, (status, v) in want.items():
        assert got[k][0] == status and (v is None or v != v) == (got[k][1] is None) and (got[k][1] is None or abs(got[k][1] - v) < 1e-9), k


def test_no_python_and_mixed_models(spark):
    rows = [("a", i, float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, ds long, y double")
    plan = evaluate.cross_validate(df, S, ["naive", "seasonal_naive"], 20, 2, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Sort [") == 1
    mixed = evaluate.cross_validate(df, S, ["ses", "naive"], 20, 2, 3)
    assert {r["model"] for r in mixed.select("model").distinct().collect()} == {"ses", "naive"}
    assert evaluate.cross_validate(df.where("false"), S, "naive", 20, 2).count() == 0
