"""Long series on many tasks: time cells, blocks of positions with halos, scans.

Windows by key put a whole series into one task. Here the rows of a series are
dealt by (key, time cell), and a cell gets what it needs from the others as one
header row: the number of rows before it, a value carried from them, the state
they end in. Header and rows meet in one exchange, so no operator joins. Frames
over a number of rows use blocks of positions: a row also goes to the block
before or after its own where a frame of that block reaches it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Series, cleaned

#: Rows of a time cell on average in the densest series, and of a block of positions.
ROWS = 65_536
#: A cell may have so many times the average before all cells are made smaller, by halves, at most HALVINGS times.
CROWDED, HALVINGS = 4, 10


def micros(df: DataFrame, column: str) -> Column:
    """A time as a whole number of microseconds; whole numbers stay as they are."""
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "date"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("long")
    raise ValueError(f"{column} is no time and no whole number: {kind}")


def cell_width(times: DataFrame, keys: list[str], t: str, rows: int = ROWS) -> int:
    """Microseconds of a cell, so that the densest series has ``rows`` a cell on
    average and no cell more than ``CROWDED`` times that, as far as
    ``HALVINGS`` halvings can do it.

    Two aggregates over counts, whatever the number of rows; 1 without rows.
    Rows at one time of one key stay together.
    """
    per = times.groupBy(*keys).agg(F.count(t).alias("n"), (F.max(t) - F.min(t)).cast("double").alias("span"))
    density = per.agg(F.max(F.col("n") / F.greatest("span", F.lit(1.0)))).first()[0]
    if not density:
        return 1
    wide = max(1, int(rows / density))
    fine = max(1, wide >> HALVINGS)
    counts = times.where(F.col(t).isNotNull()).groupBy(*keys, F.expr(f"floor({t} / {fine}D)").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    levels = [h for h in range(HALVINGS + 1) if wide >> h >= fine]
    sized = counts.select(*keys, "c", "n", F.explode(F.array(*map(F.lit, levels))).alias("h"))
    sums = sized.groupBy(*keys, "h", F.expr(f"floor(c / pow(2, {HALVINGS} - h))").alias("c")).agg(F.sum("n").alias("n"))
    most = {r["h"]: r["n"] for r in sums.groupBy("h").agg(F.max("n").alias("n")).collect()}
    good = [h for h in levels if most[h] <= CROWDED * rows]
    return fine << (HALVINGS - (good[0] if good else levels[-1]))


def _cell(t: str, width: int) -> Column:
    """The cell of a time; times that are NULL come before all others."""
    return F.coalesce(F.expr(f"floor({t} / {width}D)"), F.lit(-(1 << 62)))


def positions(df: DataFrame, s: Series, rows: int = ROWS, width: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Keys, ``ds``, ``y``, ``i`` (position from 0), ``k`` (values that are not
    missing so far, this one included) and ``extra``, as whole-series windows
    would give them, but with a task per time cell.

    ``width`` is a cell's, in microseconds (or units of a whole-number time);
    without it, it is chosen by :func:`cell_width`. A key that is NULL is a
    series of its own; rows without a time come first. Rows of one time take
    any order, so times should differ. An empty frame gives no rows.
    """
    keys = list(s.keys)
    base = df.select(*keys, F.col(s.ts).alias("ds"), cleaned(F.col(s.value)).alias("y"), *extra)
    base = base.withColumn("__t", micros(base, "ds"))
    width = width or cell_width(base, keys, "__t", rows)
    base = base.withColumn("__cell", _cell("__t", width)).withColumn("__head", F.lit(0))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = base.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"), F.count("y").alias("__v")).select(
        *keys, "__cell", F.lit(1).alias("__head"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__i0"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__k0"))
    inside = Window.partitionBy(*keys, "__cell").orderBy(F.desc("__head"), "ds")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = base.unionByName(heads, allowMissingColumns=True).select(
        *keys, "ds", "y", *extra, "__head", (F.first("__i0").over(upto) + F.row_number().over(inside) - 2).alias("i"), (F.first("__k0").over(upto) + F.count("y").over(upto)).alias("k"))
    return out.where("__head = 0").drop("__head")


def with_halo(p: DataFrame, before: int, after: int = 0, rows: int = ROWS) -> DataFrame:
    """Rows with their ``block`` of positions, and again in the block beside it
    where that needs them (``own`` is false): ``before`` rows before a block
    and ``after`` rows behind it are there as well.

    Blocks have ``rows`` rows, or as many as the frame reaches, if more.
    """
    rows = max(rows, before, after, 1)
    b, at = F.expr(f"i div {rows}"), F.col("i") % rows
    beside = [F.when(at >= rows - before, b + 1), F.when((at < after) & (b > 0), b - 1)]
    return p.withColumn("__own", b).withColumn("block", F.explode(F.array_compact(F.array(b, *beside)))).withColumn("own", F.col("block") == F.col("__own")).drop("__own")


def _own(p: DataFrame) -> DataFrame:
    return p.where("own").drop("own", "block")


def rolling(df: DataFrame, s: Series, window: int, functions: tuple[str, ...], center: bool = False, rows: int = ROWS, width: int | None = None) -> DataFrame:
    """As :func:`transforms.rolling`, a task per block of positions."""
    from .transforms import _aggregate

    if window < 1:
        raise ValueError("a window has one row at least")
    low, high = (window // 2, window - window // 2 - 1) if center else (window - 1, 0)
    p = with_halo(positions(df, s, rows, width), low, high, rows)
    frame = Window.partitionBy(*s.keys, "block").orderBy("i").rowsBetween(-low, high)
    for f in functions:
        x = _aggregate(f, F.col("y")).over(frame)
        p = p.withColumn(f"rolling_{f}", x if center else F.when(F.col("i") >= window - 1, x))
    return _own(p)


def lagged(df: DataFrame, s: Series, lags: tuple[int, ...], rows: int = ROWS, width: int | None = None) -> DataFrame:
    """Keys, ``i``, ``ds``, ``y`` and ``lag_<n>`` for each lag (negative: ahead)."""
    p = with_halo(positions(df, s, rows, width), max(0, *lags), max(0, *(-n for n in lags)), rows)
    w = Window.partitionBy(*s.keys, "block").orderBy("i")
    return _own(p.select("*", *(F.lag("y", n).over(w).alias(f"lag_{n}") for n in lags))).drop("k")


def difference(df: DataFrame, s: Series, d: int = 1, period: int = 1, rows: int = ROWS, width: int | None = None) -> DataFrame:
    """Keys, ``i``, ``ds``, ``y`` and ``diff``: ``d`` differences at a distance of ``period`` rows."""
    p = with_halo(positions(df, s, rows, width), d * period, 0, rows).withColumn("diff", F.col("y"))
    w = Window.partitionBy(*s.keys, "block").orderBy("i")
    for _ in range(d):
        p = p.withColumn("diff", F.col("diff") - F.lag("diff", period).over(w))
    return _own(p).drop("k")


def decayed(p: DataFrame, keys: list[str], index: str, order: str, values: list[str], ratio: float, rows: int = ROWS) -> DataFrame:
    """``p`` with each of ``values`` replaced by its sum over all rows so far,
    each earlier one times ``ratio`` for every step of ``index`` since then: the
    states of the recurrence ``x = ratio * x + value``.

    ``index`` counts from 0 without gaps in each series and may repeat; where
    it is negative, results are NULL. ``ratio`` is from 0 to 1.

    The updates of a chunk of indexes are one affine map, ``x`` to
    ``ratio ** length * x + total``; maps of chunks obey the same recurrence
    among each other, so their states are found in the same way, a level up,
    or, where a chunk leaves nothing of what is some chunks back (under the
    least double), as sums over those few. A chunk then gets the state before
    it as its header row. Weights within a chunk stay within 1e100.
    """
    rows = max(2, rows)
    rate = math.inf if ratio <= 0 else -math.log(ratio)
    length = rows if rate == 0 else max(1, min(rows, int(230 / rate)))
    r = F.lit(float(ratio))

    def power(n: Column) -> Column:
        return F.lit(1.0) if ratio == 1 else F.when(n == 0, 1.0).otherwise(F.pow(r, n))

    chunked = p.withColumn("__g", F.expr(f"floor({index} / {length})")).withColumn("__k", F.pmod(F.col(index), F.lit(length)))
    totals = chunked.where("__g >= 0").groupBy(*keys, "__g").agg(*(F.sum(F.col(v) * power(length - 1 - F.col("__k"))).alias(v) for v in values))
    back = 0 if math.isinf(rate) else math.inf if rate == 0 else math.ceil(745 / (rate * length))
    if back <= 8:
        q = 0.0 if math.isinf(rate) else ratio ** length
        steps = totals.select(*keys, "__g", *values, F.explode(F.array(*map(F.lit, range(1, max(back, 1) + 1)))).alias("__d"))
        carried = steps.groupBy(*keys, (F.col("__g") + F.col("__d")).alias("__g")).agg(*(F.sum(F.col(v) * F.when(F.col("__d") == 1, 1.0).otherwise(F.pow(F.lit(q), F.col("__d") - 1))).alias(v) for v in values))
    elif rate == 0:  # a plain running sum, over one row a chunk
        above = Window.partitionBy(*keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, 0)
        carried = totals.select(*keys, (F.col("__g") + 1).alias("__g"), *(F.sum(v).over(above).alias(v) for v in values))
    else:
        above = decayed(totals.withColumnRenamed("__g", "__index"), keys, "__index", "__index", values, ratio ** length, rows)
        carried = above.select(*keys, (F.col("__index") + 1).alias("__g"), *values)
    heads = carried.select(*keys, "__g", F.lit(1).alias("__head"), *(F.col(v).alias(f"__c_{v}") for v in values))
    w = Window.partitionBy(*keys, "__g").orderBy(F.desc("__head"), order).rowsBetween(Window.unboundedPreceding, 0)
    out = chunked.withColumn("__head", F.lit(0)).unionByName(heads, allowMissingColumns=True)
    sums = {v: F.when(F.col("__g") >= 0, power(F.col("__k")) * F.sum(F.coalesce(F.col(v), F.lit(0.0)) / power(F.col("__k"))).over(w) + F.coalesce(F.first(f"__c_{v}").over(w), F.lit(0.0)) * power(F.col("__k") + 1)) for v in values}
    return out.withColumns({f"__s_{v}": x for v, x in sums.items()}).where("__head = 0").withColumns({v: F.col(f"__s_{v}") for v in values}).select(*p.columns)


def ewm(df: DataFrame, s: Series, alpha: float, rows: int = ROWS, width: int | None = None) -> DataFrame:
    """Keys, ``i``, ``ds``, ``y``, ``ewm_mean``, ``ewm_var``, ``ewm_std``.

    The mean starts at the first value and moves by ``alpha`` (clamped to 0..1)
    of each surprise; the variance is the weighted mean of squares less the
    squared mean, at least 0. A missing value leaves the state as it is; before
    the first value all three are NULL. Runs a task per time cell and per chunk
    of the scan (:func:`decayed`), in the JVM, whatever the length of a series.
    """
    a = min(1.0, max(0.0, alpha))
    p = positions(df, s, rows, width).withColumn("__j", F.col("k") - 1)
    value = F.when(F.col("y").isNotNull(), F.when(F.col("k") == 1, F.lit(1.0)).otherwise(a))
    p = p.withColumn("__m", F.coalesce(value * F.col("y"), F.lit(0.0))).withColumn("__q", F.coalesce(value * F.col("y") * F.col("y"), F.lit(0.0)))
    out = decayed(p, list(s.keys), "__j", "i", ["__m", "__q"], 1.0 - a, rows)
    var = F.greatest(F.col("__q") - F.col("__m") * F.col("__m"), F.lit(0.0))
    return out.select(*s.keys, "i", "ds", "y", F.col("__m").alias("ewm_mean"), var.alias("ewm_var"), F.sqrt(var).alias("ewm_std"))
