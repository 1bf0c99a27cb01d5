"""Estimates of merged sketches within their bounds of exact answers."""

import random

from pyspark.sql import functions as F

from millrace.functions import sketches
from millrace.operators.series import Series

S = Series()


def test_merged_sketches_stay_in_bounds(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), h * 3600, None if rng.random() < 0.05 else rng.choice([rng.gauss(0, 3), float(rng.randrange(50))])) for h in range(24 * 30) for _ in range(40)]
    rows += [("empty", 0, None), ("one", 0, 7.0), ("one", 0, float("nan"))]
    df = spark.createDataFrame(rows, "key string, t long, y double").select("key", F.timestamp_seconds("t").alias("ds"), "y")
    daily = sketches.sketched(df, S)
    assert daily.groupBy("key", "bucket").count().where("count > 1").count() == 0
    for by in (["key"], ["key", F.date_trunc("week", "bucket").alias("week")]):
        for r in sketches.estimated(sketches.merged(daily, by), (0.0, 0.1, 0.5, 0.9, 1.0)).collect():
            ys = sorted(y for k, t, y in rows if k == r["key"] and y is not None and y == y and (len(by) == 1 or (t // 86400 + 3) // 7 == (int(r["week"].timestamp()) // 86400 + 3) // 7))
            assert r["n"] == len(ys) and r["q_0"] == ys[0] and r["q_100"] == ys[-1]
            for q in (0.1, 0.5, 0.9):
                v = r[f"q_{100 * q:g}"]
                low, high = sum(y < v for y in ys) / len(ys), sum(y <= v for y in ys) / len(ys)
                assert low - 3 * sketches.RANK_ERROR <= q <= high + 3 * sketches.RANK_ERROR + 1 / len(ys)
            assert abs(r["n_distinct"] - len(set(ys))) <= 1 + 4 * sketches.DISTINCT_ERROR * len(set(ys)) and r["distinct_ratio"] <= 1
    assert {r["key"] for r in sketches.estimated(sketches.merged(daily, ["key"])).collect()} == {"a", "b", None, "one"}
    scaled = sketches.robust_scale(df, S, daily)
    mid = {r["key"]: r["m"] for r in scaled.groupBy("key").agg(F.percentile("y", 0.5).alias("m")).collect()}
    assert scaled.count() == len(rows) and abs(mid["a"]) < 0.05 and mid["one"] == 0.0 and mid["empty"] is None
    assert sketches.estimated(sketches.merged(sketches.sketched(df.where("false"), S), ["key"])).count() == 0


def test_sketches_are_small(spark):
    df = spark.range(200_000).select(F.lit("a").alias("key"), F.lit("2024-01-01").cast("timestamp").alias("ds"), F.rand(1).alias("y"))
    r = sketches.sketched(df, S).select(F.length("quantiles").alias("q"), F.length("distinct").alias("d")).first()
    assert r["q"] < 60_000 and r["d"] < 40_000
