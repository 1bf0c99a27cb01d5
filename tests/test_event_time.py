"""Streams in event time: order within the lateness does not matter, over several micro-batches."""

import random

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators.series import Series, fill_gaps
from millrace.operators.transforms import ewm
from millrace.streaming import online

S = Series()


def frame(spark, rows):
    df = spark.createDataFrame(rows, "key string, t long, y double, part int")
    return df.select("key", F.timestamp_seconds("t").alias("ds"), "y", "part")


def test_shuffled_batches_give_the_batch_result(spark):
    rng = random.Random(1)
    times = sorted(rng.sample(range(100_000), 400))
    rows = [(rng.choice("ab"), t, None if rng.random() < 0.1 else rng.uniform(0, 9), min(4, max(0, t // 20_000 + rng.choice([0, 0, 0, 1])) if t % 20_000 > 17_000 else t // 20_000)) for t in times]
    rng.shuffle(rows)
    df = frame(spark, rows)
    stream = online.replayed(df, "part", "test")
    got = {(r["key"], r["ds"]): r["ewm_mean"] for r in online.drained(online.ordered_ewm(stream, S, 0.3, "5000 seconds"), "test").collect()}
    want = {(r["key"], r["ds"]): r["ewm_mean"] for r in ewm(df, S, 0.3).collect()}
    last = pd.Timestamp(max(times) - 5000, unit="s")
    passed = {k: v for k, v in want.items() if pd.Timestamp(k[1]) < last}
    assert got.keys() == passed.keys() and len({r[3] for r in rows}) == 5
    assert all((v is None) == (passed[k] is None) and (v is None or abs(v - passed[k]) < 1e-9) for k, v in got.items())


def test_late_rows_drop_and_state_goes(spark):
    """A row behind the watermark is dropped; a key that is silent for long starts anew."""
    rows = [("a", 0, 1.0, 0), ("a", 10_800, 9.0, 0), ("b", 60, 5.0, 0), ("a", 40_000, 4.0, 1), ("a", 3_600, 100.0, 2), ("a", 41_000, 2.0, 2), ("b", 90_000, 7.0, 3), ("a", 99_000, 1.0, 3), ("a", 190_000, 1.0, 4)]
    day = 86_400  # a watermark starts at 1970, and what is there is late

    def run(**options):
        out = online.drained(online.ordered_ewm(online.replayed(frame(spark, [(k, t + day, y, p) for k, t, y, p in rows]), "part", "late"), S, 0.5, "100 seconds", **options), "late")
        return sorted((r["key"], int(r["ds"].timestamp()) - day, r["ewm_mean"]) for r in out.collect())

    kept = run()
    assert kept == [("a", 0, 1.0), ("a", 10_800, 5.0), ("a", 40_000, 4.5), ("a", 41_000, 3.25), ("a", 99_000, 2.125), ("b", 60, 5.0), ("b", 90_000, 6.0)]
    assert [x for x in run(forget="30000 seconds") if x[0] == "b"] == [("b", 60, 5.0), ("b", 90_000, 7.0)]


def test_long_grid_needs_no_array(spark):
    """A grid of 20 million seconds between two rows, point by point."""
    df = spark.createDataFrame([("a", 0, 1.0, 0), ("a", 20_000_000, 2.0, 0)], "key string, t long, y double, part int").select("key", F.timestamp_seconds("t").alias("ds"), "y")
    out = fill_gaps(df, S, "1s").agg(F.count(F.lit(1)), F.count("y"), F.max(F.unix_seconds("ds"))).first()
    assert tuple(out) == (20_000_001, 2, 20_000_000)


def test_windows_take_the_nearest_second_as_in_sql(spark, tmp_path):
    """Times within half a second of the next window's start, halves to even."""
    import duckdb

    from millrace.plans import registry

    edges = [21600 * k + x for k in range(4) for x in (-0.6, -0.5, -0.499999, -0.000001, 0.0, 0.5, 30.0)] + [21600 * 3 + 7199.7]
    rows = [("ab"[i % 2], 1_704_067_200_000_000 + round(t * 1_000_000), 1.0) for i, t in enumerate(edges)]
    spark.createDataFrame(rows, "event_type string, us long, value double").selectExpr("event_type", "cast(timestamp_micros(us) as timestamp_ntz) as ts", "value").coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    for name in ("stream_resample", "stream_live_resample"):
        got = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(registry.ORACLE_SQL[name]).fetchall()), name


def test_rows_of_a_key_leave_in_bounded_parts(spark, tmp_path, monkeypatch):
    """A key's rows of one batch are arrays, and go out a bounded part at a time; a part's end changes nothing."""
    monkeypatch.setattr(online, "PART", 7)  # workers that are started from here take it
    us, y = online._columns(iter([pd.DataFrame({"us": [3, 1], "y": [1.0, None]}), pd.DataFrame({"us": [online.LAST], "y": [2.0]})]))
    assert us.dtype == "int64" and y.dtype == "float64" and us.tolist() == [3, 1, online.LAST]
    rows = [("a", t, float(t % 5) if t % 11 else None, 0) for t in range(100)] + [("b", 3, 1.0, 0)]
    df = frame(spark, rows).drop("part")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {(r["key"], r["ds"]): (r["ewm_mean"], r["ewm_var"]) for r in online.drained(online.running_ewm(stream, S, 0.3), "parts").collect()}
    want = {(r["key"], r["ds"]): (r["ewm_mean"], r["ewm_var"]) for r in ewm(df, S, 0.3).collect()}
    assert got.keys() == want.keys()
    assert all((v[0] is None) == (want[k][0] is None) and (v[0] is None or abs(v[0] - want[k][0]) < 1e-9 and abs(v[1] - want[k][1]) < 1e-9) for k, v in got.items())
