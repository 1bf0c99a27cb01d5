"""Welch's spectrum by segments: overlapping stretches of long series as rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ROWS, positions
from .series import Series


def _power(values: Column, size: Column) -> Column:
    """Power of the frequencies 1 to size / 2 of an array, in their order."""
    turn = F.lit(2 * math.pi) / size

    def part(wave, k: Column) -> Column:
        terms = F.transform(values, lambda y, i: y * wave(turn * F.pmod(k * i, size)))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return F.transform(F.sequence(F.lit(1), F.expr("size div 2")), lambda k: (F.pow(part(F.cos, k), 2) + F.pow(part(F.sin, k), 2)) / size)


def segments(df: DataFrame, s: Series, window: int, hop: int, rows: int = ROWS, width: int | None = None) -> DataFrame:
    """Keys, ``segment`` (from 0), ``size`` and ``values`` (in order, NULL where
    missing) of the stretches of ``window`` rows that begin every ``hop`` rows; a
    series shorter than that is one stretch. Rows go to their segments by
    position, so a series is dealt to as many tasks as it has segments."""
    p = positions(df, s, rows, width)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (window - 1)) / hop)).cast("long")
    dealt = p.withColumn("segment", F.explode(F.sequence(first, F.greatest(first, F.expr(f"i div {hop}"))))).where(f"i - segment * {hop} between 0 and {window - 1}")
    cut = dealt.groupBy(*s.keys, "segment").agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("v"))
    cut = cut.select(*s.keys, "segment", F.size("v").cast("long").alias("size"), F.col("v.y").alias("values"))
    return cut.where(f"size = {window} or segment = 0")


def welch(df: DataFrame, s: Series, window: int, overlap: float = 0.5, rows: int = ROWS, width: int | None = None) -> DataFrame:
    """Keys, ``rank`` (longest period first), ``period`` and ``power``: the mean
    over segments tapered by Hann's window, merged by period.

    A series shorter than ``window`` gives its plain spectrum, where periods may
    repeat; of less than two rows, none. Segments with a missing value are left
    out. Each segment's powers are sums over its ``window`` values, in the JVM;
    means are merged from partial ones of every task.
    """
    if window < 4:
        raise ValueError("a window of Welch's spectrum has four rows at least")
    hop = max(1, math.ceil((1 - min(0.9, max(0.0, overlap))) * window))
    cut = segments(df, s, window, hop, rows, width).where("size > 1 and not exists(values, y -> y is null)")
    taper = F.transform("values", lambda y, i: F.when(F.col("size") == window, y * 0.5 * (1 - F.cos(F.lit(2 * math.pi / window) * i))).otherwise(y))
    each = cut.withColumn("values", taper).select(*s.keys, "size", F.posexplode(_power(F.col("values"), F.col("size"))).alias("k", "power"))
    period = F.expr("size div (k + 1)")
    apart = F.when(F.col("size") < window, F.col("k")).otherwise(0)
    mean = each.groupBy(*s.keys, period.cast("int").alias("period"), apart.alias("k")).agg(F.avg("power").alias("power"))
    w = Window.partitionBy(*s.keys).orderBy(F.desc("period"), "k")
    return mean.select(*s.keys, F.row_number().over(w).alias("rank"), "period", "power")
