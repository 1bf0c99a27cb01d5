"""Fitted exponential smoothing of series of any length, in the JVM.

The residuals of simple smoothing obey ``e = (1 - alpha) * e + d``, with ``d``
the difference of neighbouring values. Over a chunk of a series the last
residual is affine in the one before the chunk, and the sum of squares is a
quadratic in it: five numbers, which compose. So each chunk is reduced to five
numbers for every ``alpha`` of a grid, chunks are composed in a tree, and only the grid
is narrowed from round to round; no task holds a series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.registry import interval_z
from ..streaming.online import shared_path
from . import chunks
from .forecast import spread
from .series import Series, cleaned

LOW, HIGH = 1e-4, 0.9999
#: Chunks that are composed at once.
FAN = 512
_PARTS = ("q", "t", "a", "b", "c")  # e after = q e + t; sum of squares = a + 2 b e + c e^2


def _struct(*x: Column) -> Column:
    return F.struct(*(v.alias(n) for v, n in zip(x, _PARTS, strict=True)))


def _identity() -> Column:
    return _struct(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 0.0)))


def _step(s: Column, d: Column, keep: Column) -> Column:
    """``s`` and one more difference."""
    q, t = keep * s["q"], keep * s["t"] + d
    return _struct(q, t, s["a"] + t * t, s["b"] + t * q, s["c"] + q * q)


def _then(s: Column, n: Column) -> Column:
    """``s``, then ``n``."""
    q, t = s["q"], s["t"]
    return _struct(n["q"] * q, n["q"] * t + n["t"], s["a"] + n["a"] + 2 * n["b"] * t + n["c"] * t * t, s["b"] + n["b"] * q + n["c"] * q * t, s["c"] + n["c"] * q * q)


def _beside(x: DataFrame, y: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys that may be null."""
    if not keys:
        return x.join(y, how=how)
    named = y.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    return x.join(named, reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys)), how).drop(*(f"__r_{k}" for k in keys))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit_ses(df: DataFrame, s: Series, h: int, level: float = 0.95, points: int = 33, rounds: int = 4, rows: int = 1024, width: int | None = None) -> DataFrame:
    """Keys, ``h``, ``yhat``, ``lo``, ``hi``, ``alpha``, ``sse``, ``n`` of simple
    exponential smoothing with the ``alpha`` of least squared one-step errors,
    which start at the first value.

    ``alpha`` is sought on a grid of ``points`` from 1e-4 to 0.9999, and each
    further round on a grid of the two cells beside the best point (ties: the
    smaller): to (0.9998 / (points - 1)) * (2 / (points - 1)) ** (rounds - 1).
    Where the sum of squares has several minima further apart than a cell, the
    lowest on the first grid is refined.

    Missing values are left out. A null key is a series of its own; a series
    without values gives no rows. Rows of one time take any order, so times
    should differ. ``rows`` is a chunk's size; chunks are read once a round.
    """
    if points < 3 or rounds < 1 or h < 1:
        raise ValueError("at least 3 points, one round and a horizon of 1 are needed")
    keys, cell = list(s.keys), float(points - 1)
    values = df.where(cleaned(F.col(s.value)).isNotNull())
    steps = chunks.lagged(values, s, (1,), rows, width).select(*keys, F.expr(f"i div {rows}").alias("g"), "i", "y", F.coalesce(F.col("y") - F.col("lag_1"), F.lit(0.0)).alias("d"))
    # many files: a value costs a step for each rate of the grid, so bytes are no measure of work
    parts = steps.repartition(spread(df.sparkSession), *keys, "g").groupBy(*keys, "g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda v: v["d"]).alias("ds"), F.max_by("y", "i").alias("last"), F.count(F.lit(1)).alias("n"))
    parts = _kept(parts, "differences")
    most = parts.agg(F.max("g")).first()[0] or 0
    best = parts.groupBy(*keys).agg(F.max_by("last", "g").alias("last"), F.sum("n").alias("n")).withColumns({"lo": F.lit(LOW), "hi": F.lit(HIGH)})
    for _ in range(rounds):
        best = _kept(best, "bounds")
        tried = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * j / cell)
        maps = _beside(parts.select(*keys, "g", "ds"), best.select(*keys, "lo", "hi"), keys).select(
            *keys, "g", "ds", F.explode(tried).alias("alpha"))
        maps = maps.select(*keys, "g", "alpha", F.aggregate("ds", _identity(), lambda m, d: _step(m, d, 1 - F.col("alpha"))).alias("m"))
        top = most
        while top > 0:
            found = maps.groupBy(*keys, "alpha", F.expr(f"g div {FAN}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("g", "m"))).alias("ms"))
            maps = found.select(*keys, "g", "alpha", F.aggregate("ms", _identity(), lambda m, n: _then(m, n["m"])).alias("m"))
            top //= FAN
        least = maps.groupBy(*keys).agg(F.min(F.struct(F.col("m.a").alias("sse"), "alpha", F.col("m.t").alias("error"))).alias("least"))
        step = (F.col("hi") - F.col("lo")) / cell
        best = _beside(best.drop("sse", "alpha", "error"), least, keys).select(
            *keys, "last", "n", F.greatest(F.lit(LOW), F.col("least.alpha") - step).alias("lo"), F.least(F.lit(HIGH), F.col("least.alpha") + step).alias("hi"), "least.*")
    out = best.withColumn("yhat", F.col("last") - (1 - F.col("alpha")) * F.col("error")).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    b2 = F.pow(1 - F.col("alpha"), F.lit(2.0))
    half = F.lit(interval_z(level)) * F.sqrt(F.col("sse") / F.col("n") * (1 + b2 * (1 - F.pow(b2, F.col("h") - 1)) / (1 - b2)))
    return out.select(*keys, "h", "yhat", (F.col("yhat") - half).alias("lo"), (F.col("yhat") + half).alias("hi"), "alpha", "sse", "n")
