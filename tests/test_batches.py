"""Forecasts of many series at once against those of each."""

import numpy as np
import pytest

from millrace.kernels import registry
from millrace.kernels.registry import MODELS
from millrace.operators import forecast
from millrace.operators.series import Series
from millrace.plans.base import DEMAND, demand

S = Series(keys=("k",), ts="t", value="y")
NAMES = ("croston", "croston_sba", "tsb", "adida", "imapa")


def series():
    rng = np.random.default_rng(3)
    out = {f"s{j}": rng.integers(1, 50, n) * (rng.random(n) < p) * 1.0 for j, (n, p) in enumerate((n, p) for n in (1, 2, 3, 4, 5, 30, 84) for p in (0.0, 0.05, 0.3, 1.0))}
    return out | {"below": rng.normal(size=40), "late": np.eye(1, 20, 19)[0] * 4, "ends": np.eye(1, 20, 0)[0] + np.eye(1, 20, 19)[0]}


def test_batches_are_the_kernels(spark, monkeypatch):
    data = series()
    rows = [(k, f"2024-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}", float(v)) for k, y in data.items() for i, v in enumerate(y)] + [(None, "2024-01-01", 1.0)] * 5 + [("gap", f"2024-01-{i + 1:02d}", None if i == 3 else 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, t string, y double").repartition(3)
    calls = []
    monkeypatch.setattr(forecast, "_grouped", lambda *a, **kw: calls.append(a))
    got = {}
    for x in forecast.forecast(df, S, list(NAMES), 3).collect():
        got.setdefault((x["k"], x["model"]), []).append(x)
    assert not calls and len(got) == (len(data) + 2) * len(NAMES)
    for k, y in data.items():
        for m in NAMES:
            want, have = registry.run(MODELS[m], np.asarray(y, float), 3), sorted(got[k, m], key=lambda x: x["h"] or 0)
            assert {x["status"] for x in have} == {want.status}, (k, m)
            if want.fit is None:
                assert len(have) == 1 and have[0]["yhat"] is None and have[0]["ds"] is None
            else:
                for c, v in (("yhat", want.fit.point), ("lo", want.lower), ("hi", want.upper)):
                    assert [x[c] for x in have] == pytest.approx(v.tolist(), abs=1e-9), (k, m, c)
    assert {x["status"] for m in NAMES for x in got["gap", m]} == {"missing_values"}
    assert [str(x["ds"])[:10] for x in sorted(got["s20", "tsb"], key=lambda x: x["h"])] == ["2024-02-03", "2024-02-04", "2024-02-05"]


def test_other_models_stand_beside_batches(spark):
    df = spark.createDataFrame([("a", f"2024-01-{i + 1:02d}", float(i % 3)) for i in range(12)], "k string, t string, y double")
    got = forecast.forecast(df, S, ["tsb", "naive"], 2).collect()
    assert sorted((x["model"], x["h"]) for x in got) == [("naive", 1), ("naive", 2), ("tsb", 1), ("tsb", 2)]


def test_demand_takes_one_exchange_and_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "2024-03-02", 5.0), (1, "2024-03-30", 2.0), (1, "2024-05-01", 1.0), (2, "2024-01-31", 4.0), (3, "2024-07-01", None), (4, None, 2.0), (4, "2024-01-05", 3.0), (5, None, 1.0)]
    spark.createDataFrame(rows, "l_partkey long, d string, l_quantity double").selectExpr("l_partkey", "cast(d as timestamp_ntz) as l_shipdate", "l_quantity").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = demand(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(tuple(x) for x in df.selectExpr("key", "unix_timestamp(cast(ds as timestamp))", "y").collect()) == sorted(con.execute(f"select key, epoch(ds)::bigint, y from ({DEMAND}) d").fetchall())
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
