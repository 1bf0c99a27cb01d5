"""Entropies by cells against brute force."""

import math

import numpy as np
import pytest

from millrace.functions import features
from millrace.operators import entropy
from millrace.operators.series import Series
from millrace.plans import registry

S = Series(keys=("k",), ts="t", value="y")


def brute(y, m, r):
    """(sample, approximate) entropy by comparing all templates."""
    n = len(y)

    def matches(k, count):
        t = np.array([y[i:i + k] for i in range(count)])
        return (np.abs(t[:, None] - t[None]).max(2) <= r).sum(1)

    sample = approximate = None
    if n >= m + 2:
        b, a = matches(m, n - m).sum() - (n - m), (matches(m + 1, n - m - 1).sum() - (n - m - 1)) if n > m + 1 else 0
        sample = -math.log(a / b) if a > 0 and b > 0 else None
    if n >= m + 1:
        phi = [np.log(matches(k, n - k + 1) / (n - k + 1)).mean() for k in (m, m + 1)]
        approximate = phi[0] - phi[1]
    return sample, approximate


def series():
    rng = np.random.default_rng(5)
    return {"counts": rng.integers(0, 5, 90).astype(float), "walk": rng.normal(size=150).cumsum(), "flat": np.full(20, 3.0), "edge": np.arange(40) * 0.5, "grid": rng.integers(-4, 5, 80) * 0.1,
            "huge": rng.normal(size=50) * 1e300, "tiny": rng.normal(size=50) * 1e-300, "signs": np.array([0.0, -0.0, 0.0, -0.0, 1.0] * 6), "far": 1e15 + rng.integers(0, 6, 60), "two": np.array([1.0, 1.0]),
            "three": np.array([1.0, 1.5, 1.0]), "four": np.array([1.0, 1.0, 1.0, 1.0]), "one": np.array([2.0])}


@pytest.mark.parametrize("m,r,piece,rows", [(2, 0.5, 1024, None), (1, 1.0, 3, 16), (3, 0.0, 1, None), (2, 0.1, 7, 16)])
def test_entropies_are_those_of_brute_force(spark, m, r, piece, rows):
    data = series()
    df = spark.createDataFrame([(k, i, float(v)) for k, y in data.items() for i, v in enumerate(y)], "k string, t int, y double")
    got = {x["k"]: x for x in entropy.entropies(df, S, m, r, piece, rows).collect()}
    assert set(got) == set(data)
    for k, y in data.items():
        for name, want in zip(("sample_entropy", "approximate_entropy"), brute(y, m, r)):
            assert got[k][name] == (None if want is None else pytest.approx(want, abs=1e-9)), (k, name)


def test_missing_values_null_keys_and_empty_frames(spark):
    rows = [(None, i, float(i % 3)) for i in range(20)] + [("gap", i, None if i == 7 else float(i % 3)) for i in range(20)] + [("nan", i, math.nan if i == 0 else 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    got = {x["k"]: (x["sample_entropy"], x["approximate_entropy"]) for x in entropy.entropies(df, S, 2, 0.5).collect()}
    assert got["gap"] == got["nan"] == (None, None)
    assert got[None] == pytest.approx(brute(np.arange(20) % 3 * 1.0, 2, 0.5))
    assert entropy.entropies(df.limit(0), S).collect() == []
    assert all(v is None for x in entropy.entropies(df.where("k is null"), S, 2, -1.0).collect() for v in (x[1], x[2]))
    with pytest.raises(ValueError):
        entropy.entropies(df, S, 0)


def test_a_crowded_cell_meets_in_bounded_groups(spark):
    y = np.random.default_rng(1).random(600)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, t int, y double")
    x = entropy.entropies(df, S, 2, 5.0, 64).first()
    assert (x["sample_entropy"], x["approximate_entropy"]) == pytest.approx(brute(y, 2, 5.0))


def test_features_share_the_join_with_others(spark):
    y = np.random.default_rng(2).integers(0, 6, 100).astype(float)
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y.tolist())], "k string, t int, y double")
    x = features.features(df, S, [("se", "sample_entropy", {"r": 1.0}), ("ae", "approximate_entropy", {"r": 1.0}), ("s1", "sample_entropy", {"m": 1, "r": 0.0}), "mean", "fourier_entropy"]).first()
    assert (x["se"], x["ae"]) == pytest.approx(brute(y, 2, 1.0)) and x["s1"] == pytest.approx(brute(y, 1, 0.0)[0]) and x["mean"] == pytest.approx(y.mean())


def test_sample_entropy_without_longer_matches_is_as_in_sql(spark, tmp_path):
    """Infinite where only templates of two values match, and no row where none do."""
    import duckdb

    counts = {"some": [3, 4, 9, 3, 4, 9, 3, 4, 9, 1, 2], "longer": [1, 2, 5, 9, 1, 2, 7, 12, 20], "none": [1, 2, 4, 8, 16, 32, 64], "short": [1, 1]}
    rows = [(k, f"2024-01-01 {h:02d}:00:{j:02d}.5") for k, y in counts.items() for h, n in enumerate(y) for j in range(n) if j < 60] + [("none", f"2024-01-01 06:01:{j:02d}") for j in range(4)]
    spark.createDataFrame(rows, "event_type string, ts string").selectExpr("event_type", "cast(ts as timestamp_ntz) as ts").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(registry.ORACLE_SQL["feat_sample_entropy"]).fetchall())
    assert want["longer"] == math.inf and set(want) == {"some", "longer"}
    assert dict(map(tuple, registry.QUERIES["feat_sample_entropy"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("d,r,draw", [(3, 0.1, lambda g, n: g.integers(0, 30, n) * 0.1), (2, 10.0, lambda g, n: g.exponential(50, n).round(2)), (4, 0.0, lambda g, n: g.integers(0, 3, n) * 1.0),
                                      (3, 1e-300, lambda g, n: g.normal(size=n) * 1e-300), (3, -1.0, lambda g, n: g.normal(size=n)), (3, 2.0, lambda g, n: 1e15 + g.integers(0, 6, n))])
def test_bitmaps_count_as_comparisons_do(d, r, draw):
    g = np.random.default_rng(1)
    for n in (0, 1, 65, 5000):
        asks, answers, w = [draw(g, 300) for _ in range(d)], [draw(g, n) for _ in range(d)], [g.integers(0, 9, n) for _ in range(3)]
        asks[-1][:3] = answers[-1][-2:] = np.nan
        near = [np.abs(a[:, None] - b) <= r for a, b in zip(asks, answers, strict=True)]
        short = np.logical_and.reduce(near[:-1])
        whole = short & near[-1]
        assert np.array_equal(entropy.counted(asks, answers, w, r), np.stack([short @ w[0], short @ w[1], whole @ w[1], whole @ w[2]]))
