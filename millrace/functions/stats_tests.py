"""Tests of residuals and of stationarity, one row per series.

Products at each lag are sums over lagged values, partial sums are window sums;
no series is held as an array, and the statistics never leave the JVM. With
``rows`` given, a long series runs on many tasks, in blocks of so many
positions (:mod:`millrace.operators.chunks`); otherwise its rows are one sort.
Only the chi-squared tail is a vectorised Python function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.numeric import chi2_upper
from ..operators import chunks
from ..operators.series import Series, cleaned, prepare


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else chi2_upper(float(a), int(k)) for a, k in zip(x, df, strict=True)], dtype=float)


def _sums(df: DataFrame, s: Series, most: int, partial: bool, rows: int | None) -> DataFrame:
    """Keys, ``n`` and, of the values less their mean, ``c0`` (sum of squares),
    ``products`` (sums of products at lags 1 to ``most``) and, if ``partial``,
    ``q`` (sum of squares of the partial sums). Missing values are passed over."""
    keys = list(s.keys)
    known = df.where(cleaned(F.col(s.value)).isNotNull())
    lags = range(1, most + 1)
    if rows is None:
        w = Window.partitionBy(*keys).orderBy("i")
        p = prepare(known, s).withColumn("d", F.col("y") - F.avg("y").over(Window.partitionBy(*keys)))
        p = p.select(*keys, "d", *(F.lag("d", k).over(w).alias(f"d{k}") for k in lags), *([F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run")] if partial else []))
        runs = None
    else:
        size = max(rows, most, 1)
        base = chunks.positions(known, s, size)
        means = base.groupBy(*keys).agg(F.avg("y").alias("mu"), F.count("y").alias("n"))
        means = means.select(*keys, "mu", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {size}"))).alias("block"))
        p = chunks.with_halo(base, most, 0, size).join(means, [*keys, "block"]).withColumn("d", F.col("y") - F.col("mu"))
        w = Window.partitionBy(*keys, "block").orderBy("i")
        p = p.select(*keys, "i", "own", "d", *(F.lag("d", k).over(w).alias(f"d{k}") for k in lags)).where("own")
        runs = chunks.decayed(p.select(*keys, "i", F.col("d").alias("run")), keys, "i", "i", ["run"], 1.0, size) if partial else None
    squares = F.sum(F.col("run") * F.col("run")).alias("q")
    products = F.array(*(F.coalesce(F.sum(F.col("d") * F.col(f"d{k}")), F.lit(0.0)) for k in lags)).cast("array<double>").alias("products")
    out = p.groupBy(*keys).agg(F.count("d").alias("n"), F.sum(F.col("d") * F.col("d")).alias("c0"), products, *([squares] if partial and runs is None else []))
    return out if runs is None else out.join(runs.groupBy(*keys).agg(squares), keys)


def _portmanteau(df: DataFrame, s: Series, lags: int | None, term: str, outer: str, rows: int | None) -> DataFrame:
    chosen = f"{lags}L" if lags is not None else "greatest(1L, least(10L, n div 5))"
    a = _sums(df, s, 10 if lags is None else lags, False, rows).where("n >= 3").withColumn("lags", F.expr(f"cast(least({chosen}, n - 1) as int)"))
    q = F.expr(f"aggregate(transform(slice(products, 1, lags), (x, k) -> power(x / nullif(c0, 0D), 2) {term}), 0D, (t, x) -> t + x) * {outer}")
    return a.withColumn("statistic", F.when(F.col("c0") == 0, 0.0).otherwise(q))


def ljung_box(df: DataFrame, s: Series, lags: int | None = None, fitted_params: int = 0, rows: int | None = None) -> DataFrame:
    """Keys, ``statistic``, ``p_value``, ``lags``, ``df``; NULLs under three values."""
    a = _portmanteau(df, s, lags, "/ (n - k - 1)", "n * (n + 2)", rows).withColumn("df", F.greatest(F.lit(1), F.col("lags") - fitted_params))
    return _tail(df, s, a)


def box_pierce(df: DataFrame, s: Series, lags: int | None = None, rows: int | None = None) -> DataFrame:
    """As :func:`ljung_box`, without its correction for length or parameters."""
    return _tail(df, s, _portmanteau(df, s, lags, "", "n", rows).withColumn("df", F.col("lags")))


def _tail(df: DataFrame, s: Series, a: DataFrame) -> DataFrame:
    a = a.select(*s.keys, "statistic", chi2_tail("statistic", "df").alias("p_value"), "lags", "df")
    return df.select(*s.keys).distinct().join(a, list(s.keys), "left")


def is_white_noise(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    return tests.withColumn("white_noise", F.col("p_value") > alpha)


def durbin_watson(df: DataFrame, s: Series) -> DataFrame:
    """Keys, ``statistic`` (2 if all zero) and ``interpretation``."""
    p = prepare(df, s)
    d = p.withColumn("e", F.col("y") - F.lag("y").over(Window.partitionBy(*s.keys).orderBy("ds")))
    g = d.groupBy(*s.keys).agg(F.max("n").alias("n"), F.sum(F.col("e") * F.col("e")).alias("a"), F.sum(F.col("y") * F.col("y")).alias("b"))
    dw = F.when(F.col("n") >= 2, F.when(F.col("b") == 0, 2.0).otherwise(F.col("a") / F.nullif(F.col("b"), F.lit(0.0))))
    label = F.when(dw < 0.5, "positive_strong").when(dw < 1.5, "positive_weak").when(dw <= 2.5, "none").when(dw < 3.5, "negative_weak").when(dw >= 3.5, "negative_strong").otherwise("none")
    return g.select(*s.keys, dw.alias("statistic"), label.alias("interpretation"))


def _steps(x: Column, steps: list[tuple[float, float]], last: Column) -> Column:
    out = last
    for bound, value in reversed(steps):
        out = F.when(x < bound, value).otherwise(out)
    return F.when(x.isNotNull(), out)


# Upper bounds of the unit-root statistic and the p-value below each;
# critical values are -3.43, -2.86, -2.57 and, for level stationarity, 0.739, 0.463, 0.347.
ADF_STEPS = [(-4.0, 0.001), (-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-1.94, 0.20), (-1.62, 0.30), (-1.28, 0.40), (-0.84, 0.50), (0.0, 0.70)]
ADF_5, KPSS_5 = -2.86, 0.463


def adf_test(df: DataFrame, s: Series, max_lags: int | None = None) -> DataFrame:
    """Keys, ``statistic``, ``p_value``, ``lags``, ``is_stationary``.

    The regression of differences on levels, begun ``lags`` rows later for each
    lag tried; the lag has the lowest AIC. No lagged differences enter.
    """
    p = prepare(df, s)
    top = f"{max_lags}L" if max_lags is not None else "cast(floor(power(n - 1, 1D / 3)) as bigint)"
    rows = p.withColumn("x", F.lag("y").over(Window.partitionBy(*s.keys).orderBy("ds"))).where("n >= 4 and i >= 1").withColumn("e", F.col("y") - F.col("x"))
    rows = rows.withColumn("lag", F.explode(F.expr(f"sequence(1, cast(greatest(1L, least({top}, n div 2 - 1)) as int))"))).where("i - 1 >= lag")
    g = rows.groupBy(*s.keys, "lag").agg(F.count("e").alias("m"), F.regr_sxx("e", "x").alias("xx"), F.regr_sxy("e", "x").alias("xy"), F.regr_syy("e", "x").alias("yy"))
    xx = F.nullif(F.col("xx"), F.lit(0.0))
    g = g.withColumn("beta", F.col("xy") / xx).withColumn("rss", F.col("yy") - F.col("beta") * F.col("xy"))
    ok = (F.col("m") >= 3) & (F.col("rss") > 0)
    g = g.withColumn("aic", F.when(ok, F.col("m") * F.ln(F.when(ok, F.col("rss")) / F.col("m")) + 2.0 * (F.col("lag") + 2)))
    best = g.where("aic is not null").groupBy(*s.keys).agg(F.min_by(F.struct("lag", "m", "xx", "beta", "rss"), F.struct("aic", "lag")).alias("b"))
    se = F.sqrt(F.col("b.rss") / F.nullif(F.col("b.m") - 2, F.lit(0)) / F.nullif(F.col("b.xx"), F.lit(0.0)))
    best = best.select(*s.keys, (F.col("b.beta") / F.nullif(se, F.lit(0.0))).alias("statistic"), F.col("b.lag").alias("lags"))
    t = F.col("statistic")
    best = best.withColumn("p_value", _steps(t, ADF_STEPS, 0.90 + 0.05 * (1 - F.exp(-t)))).withColumn("is_stationary", F.coalesce(t < ADF_5, F.lit(False)))
    return df.select(*s.keys).distinct().join(best, list(s.keys), "left").select(*s.keys, "statistic", "p_value", "lags", F.coalesce("is_stationary", F.lit(False)).alias("is_stationary"))


def kpss_test(df: DataFrame, s: Series, lags: int | None = None, rows: int | None = None) -> DataFrame:
    """Keys, ``statistic``, ``p_value`` (by pieces; above 0.1 for small statistics),
    ``lags``, ``is_stationary``. Bartlett weights. Without ``lags``, the longest
    series' length is counted first, as it decides how many there are."""
    chosen = f"{lags}L" if lags is not None else "cast(floor(4 * power(n / 100D, 0.25D)) as bigint)"
    wanted = F.expr(f"cast(greatest(1L, least({chosen}, n div 2)) as int)")
    most = max(1, lags) if lags is not None else df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max(wanted)).first()[0] or 1
    a = _sums(df, s, most, True, rows).where("n >= 4").withColumn("lags", wanted)
    a = a.withColumn("num", F.expr("q / (n * 1D * n)"))
    a = a.withColumn("var", F.expr("c0 / n + aggregate(transform(slice(products, 1, lags), (x, k) -> 2 * (1 - (k + 1) / (lags + 1D)) * x / n), 0D, (t, x) -> t + x)"))
    t = F.col("statistic")
    p = (F.when(t < 0.347, 0.10 + 0.90 * (1 - t / 0.347)).when(t < 0.463, 0.05 + 0.05 * (0.463 - t) / (0.463 - 0.347))
         .when(t < 0.739, 0.01 + 0.04 * (0.739 - t) / (0.739 - 0.463)).otherwise(0.01 * (1 - F.least(t - 0.739, F.lit(1.0)))))
    a = a.withColumn("statistic", F.when(F.col("var") > 0, F.col("num") / F.when(F.col("var") > 0, F.col("var"))))
    a = a.select(*s.keys, "statistic", F.when(t.isNotNull(), p).alias("p_value"), "lags", F.coalesce(t < KPSS_5, F.lit(True)).alias("is_stationary"))
    return df.select(*s.keys).distinct().join(a, list(s.keys), "left").select(*s.keys, "statistic", "p_value", "lags", F.coalesce("is_stationary", F.lit(False)).alias("is_stationary"))


def test_stationarity(df: DataFrame, s: Series) -> DataFrame:
    """Keys, both statistics and ``conclusion``: stationary or non_stationary where
    the tests agree, else inconclusive."""
    a = adf_test(df, s).select(*s.keys, F.col("statistic").alias("adf"), F.col("is_stationary").alias("x"))
    b = kpss_test(df, s).select(*s.keys, F.col("statistic").alias("kpss"), F.col("is_stationary").alias("z"))
    x, z = F.col("x"), F.col("z")
    return a.join(b, list(s.keys)).select(*s.keys, "adf", "kpss", F.when(x & z, "stationary").when(~x & ~z, "non_stationary").otherwise("inconclusive").alias("conclusion"))


test_stationarity.__test__ = False
