"""Long series in chunks, as-of and interval joins, against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunks, joins, transforms
from millrace.operators.series import Series

S = Series()
RAW = "key string, ds long, y double, i string, k string"


def series_rows(seed=1, keys=("a", "b", None), n=400):
    """Irregular times: dense spells, long pauses, missing values, one very short series."""
    rng = random.Random(seed)
    rows = [("short", 5, 1.5, "x", "y")]
    for key in keys:
        t = -3_000
        for _ in range(n):
            t += rng.choice([1, 1, 1, 2, 5, 1_000_000 if rng.random() < 0.02 else 3])
            rows.append((key, t, None if rng.random() < 0.2 else round(rng.uniform(-5, 9), 3), "x", "y"))
    rng.shuffle(rows)
    return rows


def by_key(rows):
    out = {}
    for key, t, y, *_ in sorted(rows, key=lambda r: r[1]):
        out.setdefault(key, []).append((t, y))
    return out


@pytest.mark.parametrize("rows,width", [(16, None), (7, 40), (10_000, None), (2, 1)])
def test_positions_and_halos(spark, rows, width):
    raw = series_rows()
    got = chunks.positions(spark.createDataFrame(raw, RAW), S, rows, width).collect()
    want = {(key, t): (i, sum(v is not None for _, v in xs[:i + 1])) for key, xs in by_key(raw).items() for i, (t, _) in enumerate(xs)}
    assert len(got) == len(raw) and all((r["i"], r["k"]) == want[r["key"], r["ds"]] for r in got)


@pytest.mark.parametrize("rows", [5, 64, 10_000])
def test_frames_equal_whole_series(spark, rows):
    df = spark.createDataFrame(series_rows(2, ("a", "b")), RAW)

    def same(a, b, names):
        x, y = ({(r["key"], r["i"]): [r[c] for c in names] for r in d.collect()} for d in (a, b))
        assert x.keys() == y.keys()
        assert all(u == v or u is not None and v is not None and abs(u - v) < 1e-9 for k in x for u, v in zip(x[k], y[k], strict=True))

    for center in (False, True):
        same(chunks.rolling(df, S, 9, transforms.ROLLING, center, rows), transforms.rolling(df, S, 9, transforms.ROLLING, center), [f"rolling_{f}" for f in transforms.ROLLING])
    same(chunks.difference(df, S, 2, 6, rows), transforms.difference(df, S, 2, 6), ["diff"])
    lags = chunks.lagged(df, S, (3, -4), rows).collect()
    ys = {(r["key"], r["i"]): r["y"] for r in lags}
    assert all(r["lag_3"] == ys.get((r["key"], r["i"] - 3)) and r["lag_-4"] == ys.get((r["key"], r["i"] + 4)) for r in lags)


@pytest.mark.parametrize("alpha,rows", [(0.0, 50), (1e-5, 7), (0.02, 50), (0.3, 3), (0.9, 50), (0.999999, 3), (1.0, 50), (7.0, 3)])
def test_scan_equals_recurrence(spark, alpha, rows):
    raw = series_rows(3, ("a", None), 300)
    a = min(1.0, alpha)
    want = {}
    for key, xs in by_key(raw).items():
        m = q = None
        for t, y in xs:
            if y is not None:
                m, q = (y, y * y) if m is None else (a * y + (1 - a) * m, a * y * y + (1 - a) * q)
            want[key, t] = (m, None if m is None else max(q - m * m, 0.0))
    got = chunks.ewm(spark.createDataFrame(raw, RAW), S, alpha, rows).collect()
    assert len(got) == len(raw)
    for r in got:
        m, v = want[r["key"], r["ds"]]
        assert (r["ewm_mean"] is None) == (m is None) and (m is None or abs(r["ewm_mean"] - m) < 1e-9 and abs(r["ewm_var"] - v) < 1e-8)


def test_one_key_uses_all_partitions(spark):
    """The window's exchange deals one series to all partitions, none with much more than its share."""
    df = spark.range(40_000).select(F.lit("a").alias("key"), (F.col("id") * 7).alias("ds"), F.col("id").cast("double").alias("y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (chunks.rolling(df, S, 20, ("mean",), rows=512), chunks.ewm(df, S, 0.1, rows=512)):
            dealt = out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count(out.columns[-1]).alias("n"), F.sum(out.columns[-1]))
            sizes = [r["n"] for r in dealt.collect()]
            assert len(sizes) == 8 and sum(sizes) > 39_900 and max(sizes) < 12_000, sizes
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cells_follow_density(spark):
    """A spell with a thousand times the usual density makes cells smaller for all."""
    rows = [("a", t * 1000) for t in range(2000)] + [("a", 500_000 + t) for t in range(1, 1000)]
    df = spark.createDataFrame(rows, "key string, t long")
    width = chunks.cell_width(df, ["key"], "t", 100)
    most = df.groupBy(F.expr(f"floor(t / {width})")).count().agg(F.max("count")).first()[0]
    assert most <= 100 * chunks.CROWDED and width > 1
    assert chunks.cell_width(df.where("false"), ["key"], "t", 100) == 1


def test_chunks_of_nothing(spark):
    none = spark.createDataFrame([], RAW)
    for out in (chunks.rolling(none, S, 3, ("mean",)), chunks.ewm(none, S, 0.5), chunks.difference(none, S), chunks.lagged(none, S, (1,))):
        assert out.count() == 0
    blank = spark.createDataFrame([("a", None, 1.0, "", ""), ("a", 3, float("nan"), "", ""), (None, None, None, "", "")], RAW)
    assert sorted((r["key"] or "", r["i"], r["ewm_mean"]) for r in chunks.ewm(blank, S, 0.5).collect()) == [("", 0, None), ("a", 0, 1.0), ("a", 1, 1.0)]


# --- joins -------------------------------------------------------------------


def plain_asof(left, right, direction, tolerance, exact):
    out = []
    for key, t, name in left:
        good = [r for r in right if key is not None and t is not None and r[0] == key and r[1] is not None and (exact or r[1] != t)]
        back = max((r for r in good if r[1] <= t), key=lambda r: (r[1], r[2]), default=None)
        ahead = min((r for r in good if r[1] >= t), key=lambda r: (r[1], -r[2]), default=None)
        if direction == "nearest":
            got = ahead if back is None or ahead is not None and ahead[1] - t < t - back[1] else back
        else:
            got = back if direction == "backward" else ahead
        if got and tolerance is not None and abs(got[1] - t) > tolerance:
            got = None
        out.append((key, t, name, *(got[1:] if got else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", joins.DIRECTIONS)
@pytest.mark.parametrize("tolerance,exact", [(None, True), (4, True), (None, False), (4, False)])
def test_asof_equals_plain(spark, direction, tolerance, exact):
    rng = random.Random(5)
    left = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(-20, 60)]) if rng.random() < 0.9 else 10_000, f"n{i % 50}") for i in range(150)]
    right = [(rng.choice(["a", "b", "b", None, "d"]), rng.choice([None, *range(-30, 50)]), i % 7) for i in range(120)]
    a, b = spark.createDataFrame(left, "key string, t long, name string"), spark.createDataFrame(right, "key string, t long, v int")
    want = plain_asof(left, right, direction, tolerance, exact)
    for rows, width in ((4, None), (64, 1)):
        got = joins.asof_join(a, b, ("key",), "t", "t", ("v",), direction, tolerance, exact, "r_", rows, width)
        assert got.columns == ["key", "t", "name", "r_t", "r_v"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_asof_of_nothing_and_clashes(spark):
    a = spark.createDataFrame([("a", 1)], "key string, t long")
    none = a.where("false").withColumn("v", F.lit(1))
    assert [tuple(r) for r in joins.asof_join(a, none, ("key",), "t", "t", ("v",), prefix="r_").collect()] == [("a", 1, None, None)]
    assert joins.asof_join(none.drop("v"), a.withColumn("v", F.lit(1)), ("key",), "t", "t", ("v",), prefix="r_").count() == 0
    with pytest.raises(ValueError, match="prefix"):
        joins.asof_join(a, a.withColumn("v", F.lit(1)), ("key",), "t", "t", ("v",))
    with pytest.raises(ValueError, match="direction"):
        joins.asof_join(a, a.withColumn("v", F.lit(1)), ("key",), "t", "t", ("v",), "sideways", prefix="r_")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_intervals_equal_plain(spark, closed, kind):
    rng = random.Random(6)
    unit = 1 if kind == "long" else 0.37
    points = [(rng.choice(["a", "a", "b", None]), None if rng.random() < 0.05 else rng.randint(-500, 500) * unit, i) for i in range(300)]
    spans = []
    for i in range(120):
        start = rng.randint(-600, 500)
        spans.append((rng.choice(["a", "a", "c", None]), start * unit, None if rng.random() < 0.05 else (start + rng.choice([-3, 0, 0, 1, 4, 16, 17, 64, 900])) * unit, i % 100))
    want = sorted((k, p, n, a, z, m) for k, p, n in points for c, a, z, m in spans if k is not None and k == c and None not in (p, a, z) and (a <= p <= z if closed else a <= p < z))
    got = joins.interval_join(spark.createDataFrame(points, f"key string, p {kind}, n int"), spark.createDataFrame(spans, f"key string, a {kind}, z {kind}, m int"), ("key",), "p", "a", "z", closed)
    assert got.columns == ["key", "p", "n", "a", "z", "m"] and want
    assert sorted(map(tuple, got.collect())) == want


def test_intervals_touch_two_cells_at_most(spark):
    """A span of 10**12 units is not multiplied; what meets in cells is a few times the matches."""
    spans = spark.range(200).select(F.lit("a").alias("key"), (F.col("id") * 5).alias("a"), (F.col("id") * 5 + 3 + F.when(F.col("id") == 7, 10 ** 12).otherwise(0)).alias("z"))
    points = spark.range(1000).select(F.lit("a").alias("key"), F.col("id").alias("p"))
    out = joins.interval_join(points, spans, ("key",), "p", "a", "z")
    assert out.count() == 200 * 3 + (1000 - 35) - 3
    assert joins.interval_join(points, spans.where("false"), ("key",), "p", "a", "z").count() == 0
    assert joins.interval_join(points.where("false"), spans, ("key",), "p", "a", "z").count() == 0


@pytest.mark.parametrize("window,overlap", [(16, 0.5), (24, 0.9), (9, 0.0), (4, 0.3)])
def test_welch_equals_one_series_at_a_time(spark, window, overlap):
    import numpy as np

    from millrace.kernels import periods
    from millrace.operators import spectra

    rng = np.random.default_rng(1)
    lengths = {"a": 200, "b": window, "c": window - 1, "d": 3, "e": 1, None: 50}
    ys = {k: rng.normal(size=n) for k, n in lengths.items()}
    df = spark.createDataFrame([(k, i * i, float(v)) for k, y in ys.items() for i, v in enumerate(y)], "key string, ds long, y double")
    got = {}
    for r in spectra.welch(df, S, window, overlap, rows=20).orderBy("rank").collect():
        got.setdefault(r["key"], []).append((r["period"], r["power"]))
    for k, y in ys.items():
        want = periods.welch(y, window, overlap)
        assert [p for p, _ in got.get(k, [])] == [p for p, _ in want]
        assert np.allclose([v for _, v in got.get(k, [])], [v for _, v in want])


def test_welch_leaves_out_segments_with_gaps(spark):
    from millrace.operators import spectra

    rows = [("a", i, None if i in (0, 40) else float(i % 8)) for i in range(64)]
    df = spark.createDataFrame(rows, "key string, ds long, y double")
    cut = spectra.welch(df, S, 16, 0.0, rows=7)
    whole = spectra.welch(df.where("ds between 16 and 31 or ds >= 48"), S, 16, 0.0, rows=7)
    assert [tuple(r) for r in cut.collect()] == [tuple(r) for r in whole.collect()] and [r[2] for r in cut.collect()] == [16, 8, 5, 4, 3, 2]
    assert spectra.welch(df.where("false"), S, 16).count() == 0
