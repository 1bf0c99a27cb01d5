"""Mergeable sketches of series: quantiles and distinct values per key and time bucket.

A table of sketches has a row per key and bucket. It is written once, and any
range of buckets is answered by merging its rows, without reading a value
again: order and grouping of merges do not matter, so partial merges leave each
task and a hot key sends one sketch a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import Series, cleaned

#: Size of quantile sketches; with it, a quantile's rank is right to RANK_ERROR with 99 % confidence, about.
K, RANK_ERROR = 1000, 0.005
#: Logarithm of the size of distinct-value sketches, and their relative standard error.
LG, DISTINCT_ERROR = 14, 0.0082


def sketched(df: DataFrame, s: Series, every: str = "day") -> DataFrame:
    """Keys, ``bucket`` (the time cut to ``every``: hour, day, week, month and so
    on), ``n``, ``low``, ``high``, ``quantiles`` and ``distinct`` (binary).

    Missing values (NULL, NaN, infinite) are left out; a bucket without any has
    ``n`` 0 and sketches of nothing. Keys that are NULL are a key of their own.
    A sketch's size is bounded by ``K`` and ``LG``, whatever it has seen.
    """
    rows = df.select(*s.keys, F.date_trunc(every, F.col(s.ts)).alias("bucket"), cleaned(F.col(s.value)).alias("__y"))
    return rows.groupBy(*s.keys, "bucket").agg(
        F.count("__y").alias("n"), F.min("__y").alias("low"), F.max("__y").alias("high"),
        F.kll_sketch_agg_double("__y", F.lit(K)).alias("quantiles"), F.hll_sketch_agg(F.xxhash64("__y"), F.lit(LG)).alias("distinct"))


def merged(sketches: DataFrame, by: list[Column | str]) -> DataFrame:
    """Sketches of coarser groups: ``by`` names columns or expressions of
    ``sketches``, as in the key and the week of ``bucket``."""
    return sketches.where("n > 0").groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles", F.lit(K)).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def quantile(q: float, sketch: str = "quantiles") -> Column:
    """A value whose rank among all is ``q``, give or take ``RANK_ERROR``; ends are exact."""
    if q in (0.0, 1.0):
        return F.col("low" if q == 0 else "high")
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))


def estimated(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The frame with ``q_<percent>`` for each quantile, ``n_distinct`` and
    ``distinct_ratio`` (of values to rows), without the sketches."""
    out = sketches.where("n > 0").withColumns({f"q_{100 * q:g}".replace(".", "_"): quantile(q) for q in quantiles})
    distinct = F.hll_sketch_estimate("distinct")
    return out.withColumn("n_distinct", distinct).withColumn("distinct_ratio", F.least(F.lit(1.0), distinct / F.col("n"))).drop("quantiles", "distinct")


def robust_scale(df: DataFrame, s: Series, sketches: DataFrame) -> DataFrame:
    """Keys, ``ds``, ``y``: values less their key's median, over the distance of
    its quartiles (1 where that is under 1e-10), both from all of the key's sketches."""
    e = estimated(merged(sketches, list(s.keys)))
    scale = F.col("q_75") - F.col("q_25")
    e = e.select(*(F.col(k).alias(f"__{k}") for k in s.keys), F.col("q_50").alias("__c"), F.when(scale < 1e-10, 1.0).otherwise(scale).alias("__s"))
    same = F.lit(True)
    for k in s.keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = df.select(*s.keys, F.col(s.ts).alias("ds"), cleaned(F.col(s.value)).alias("y"))
    return rows.join(e, same, "left").select(*s.keys, "ds", ((F.col("y") - F.col("__c")) / F.col("__s")).alias("y"))
