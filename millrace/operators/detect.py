"""Outliers, periods, changepoints and decomposition of many series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import changepoints, periods
from ..kernels.decompose import mstl, stl
from ..kernels.smoothing import TooShort
from . import spectra
from .joins import interval_join
from .series import Series, prepare


def outliers(df: DataFrame, s: Series, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """The prepared frame with ``score`` and ``is_outlier``.

    ``iqr``: distance beyond the fences over the interquartile range, quartiles
    being the sorted values at positions n/4 and 3n/4; ``zscore`` with the sample
    deviation; ``modified``: 0.6745 |y - median| / MAD, 0 if that is tiny. Under
    four values (iqr) nothing is an outlier.
    """
    p = prepare(df, s)
    key = list(s.keys)
    if method == "iqr":
        t = 1.5 if threshold is None else threshold
        w = Window.partitionBy(*key)
        x = p.withColumn("m", F.count("y").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.col("y").asc_nulls_last())))

        def ranked(share: F.Column) -> F.Column:
            return F.max(F.when(F.col("k") == F.floor(share) + 1, F.col("y"))).over(w)

        x = x.withColumn("q1", ranked(F.col("m") / 4)).withColumn("q3", ranked(F.col("m") * 3 / 4)).withColumn("r", F.col("q3") - F.col("q1"))
        beyond = F.greatest(F.col("q1") - t * F.col("r") - F.col("y"), F.col("y") - F.col("q3") - t * F.col("r"), F.lit(0.0))
        score = F.when((F.col("m") >= 4) & (F.col("r") > 1e-10), beyond / F.nullif(F.col("r"), F.lit(0.0))).otherwise(0.0)
        out = x.withColumn("score", F.when(F.col("y").isNotNull(), score).otherwise(0.0)).drop("m", "k", "q1", "q3", "r")
        return out.withColumn("is_outlier", F.col("score") > 0)
    w = Window.partitionBy(*key)
    if method == "zscore":
        t = 3.0 if threshold is None else threshold
        sd = F.stddev_samp("y").over(w)
        score = F.when(sd > 1e-10, F.abs(F.col("y") - F.avg("y").over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)
        out = p.withColumn("score", F.coalesce(score, F.lit(0.0)))
    elif method == "modified":
        t = 3.5 if threshold is None else threshold
        x = p.withColumn("d", F.abs(F.col("y") - F.median("y").over(w)))
        mad = F.median("d").over(w)
        out = x.withColumn("score", F.coalesce(F.when(mad > 1e-10, 0.6745 * F.col("d") / F.nullif(mad, F.lit(0.0))), F.lit(0.0))).drop("d")
    else:
        raise ValueError(f"unknown method {method}")
    return out.withColumn("is_outlier", F.col("score") > t)


def outlier_summary(found: DataFrame, s: Series) -> DataFrame:
    """Keys, ``outliers`` and ``percentage``."""
    n = F.count_if("is_outlier")
    return found.groupBy(*s.keys).agg(n.alias("outliers"), (n * 100.0 / F.count(F.lit(1))).alias("percentage"))


def _per_series(df: DataFrame, s: Series, kernel, fields: list[T.StructField]) -> DataFrame:
    """Run ``kernel(y, ds) -> rows`` on each series (missing values left out)."""
    schema = T.StructType([*(df.schema[k] for k in s.keys), *fields])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["y"].notna()].sort_values("i")
        rows = kernel(pdf["y"].to_numpy(float), pdf["ds"])
        return pd.DataFrame([[*key, *r] for r in rows], columns=schema.names)

    return prepare(df, s).select(*s.keys, "ds", "i", "y").groupBy(*s.keys).applyInPandas(run, schema)


def detect_periods(df: DataFrame, s: Series, method: str = "autoperiod", low: int = 2, high: int = 365, **options) -> DataFrame:
    """Keys, ``rank`` (1: primary), ``period``, ``score``; no row without a period.
    Methods: acf, fft, autoperiod, cfd, sazed, seasonality."""
    f = periods.DETECTORS[method]
    fields = [T.StructField("rank", T.IntegerType()), T.StructField("period", T.IntegerType()), T.StructField("score", T.DoubleType())]
    return _per_series(df, s, lambda y, _: [(k + 1, int(p), float(v)) for k, (p, v) in enumerate(f(y, low, high, **options))], fields)


def detect_period(df: DataFrame, s: Series, low: int = 2, high: int = 365) -> DataFrame:
    return detect_periods(df, s, "autoperiod", low, high)


def detect_period_ensemble(df: DataFrame, s: Series, low: int = 2, high: int = 365) -> DataFrame:
    return detect_periods(df, s, "sazed", low, high)


def periodogram(df: DataFrame, s: Series, window: int | None = None, overlap: float = 0.5, threshold: float | None = None, low: int = 2, high: int = 365) -> DataFrame:
    """Keys, ``rank``, ``period``, ``power``: plain, Welch's (with ``window``, by
    segments, see :mod:`spectra`) or its peaks only (with ``threshold``)."""
    if window and window >= 4:
        return spectra.welch(df, s, window, overlap)

    def f(y: np.ndarray, _) -> list:
        got = periods.spectral_peaks(y, threshold, low, high) if threshold and not window else periods.periodogram(y)
        return [(k + 1, int(p), float(v)) for k, (p, v) in enumerate(got)]

    return _per_series(df, s, f, [T.StructField("rank", T.IntegerType()), T.StructField("period", T.IntegerType()), T.StructField("power", T.DoubleType())])


def fft_real(df: DataFrame, s: Series) -> DataFrame:
    """Keys, ``k``, ``re``, ``im`` for frequencies 0..n/2."""
    fields = [T.StructField("k", T.IntegerType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]
    return _per_series(df, s, lambda y, _: [(k, float(z.real), float(z.imag)) for k, z in enumerate(np.fft.rfft(y))], fields)


def autocorrelations(df: DataFrame, s: Series, max_lag: int) -> DataFrame:
    """Keys, ``lag``, ``acf`` (biased) for lags 1..max_lag, as window lags of one sorted pass."""
    p = prepare(df, s)
    w = Window.partitionBy(*s.keys).orderBy("ds")
    d = p.withColumn("d", F.col("y") - F.avg("y").over(Window.partitionBy(*s.keys)))
    lags = {f"l{k}": F.lag("d", k).over(w) for k in range(1, max_lag + 1)}
    a = d.withColumns(lags).groupBy(*s.keys).agg(F.max("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("c0"), F.array(*(F.sum(F.col("d") * F.col(x)) for x in lags)).alias("c"))
    e = a.select(*s.keys, "n", "c0", F.posexplode("c").alias("lag", "c"))
    acf = F.when(F.col("c0") / F.col("n") < 1e-10, 0.0).otherwise(F.col("c") / F.nullif(F.col("c0"), F.lit(0.0)))
    return e.select(*s.keys, (F.col("lag") + 1).alias("lag"), F.coalesce(acf, F.lit(0.0)).alias("acf")).where(F.col("lag") <= max_lag)


def detect_seasonality(df: DataFrame, s: Series, low: int = 2, high: int = 30, threshold: float = 0.3) -> DataFrame:
    """Keys, ``period``, ``strength``: the highest autocorrelation peak above the
    threshold strictly inside low..min(high, n/2), without leaving the JVM."""
    acf = autocorrelations(df, s, high)
    n = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*s.keys).orderBy("lag")
    x = acf.join(n, list(s.keys)).where(F.col("lag") <= F.floor(F.col("n") / 2)).where(f"lag >= {low}")
    x = x.withColumn("prev", F.lag("acf").over(w)).withColumn("next", F.lead("acf").over(w)).where(f"acf > prev and acf > next and acf > {threshold}")
    return x.groupBy(*s.keys).agg(F.max_by("lag", F.struct(F.col("acf"), -F.col("lag"))).alias("period"), F.least(F.lit(1.0), F.max("acf")).alias("strength"))


def pelt(df: DataFrame, s: Series, cost: str = "l2", penalty: float | str = 1.0, min_size: int = 2) -> DataFrame:
    """Keys, ``segment``, ``start``, ``end`` (positions, half-open), ``start_ds``,
    ``mean``, ``cost`` (of all segments, without penalties). ``penalty`` may be
    ``bic`` (ln n) or ``aic`` (2)."""
    def f(y: np.ndarray, ds: pd.Series) -> list:
        n = len(y)
        if not n:
            return []
        changes, total = changepoints.pelt(y, cost, {"bic": float(np.log(n)), "aic": 2.0}.get(penalty, penalty), min_size)
        bounds = [0, *changes, n]
        return [(k, a, b, ds.iloc[a], float(y[a:b].mean()), total) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]

    fields = [T.StructField("segment", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("start_ds", df.schema[s.ts].dataType),
              T.StructField("mean", T.DoubleType()), T.StructField("cost", T.DoubleType())]
    return _per_series(df, s, f, fields)


def segment_costs(df: DataFrame, s: Series, segment: str) -> DataFrame:
    """Keys, the segment column and the closed-form costs of its rows: l1, l2,
    normal, poisson, linear_trend, mean_variance and cusum."""
    p = prepare(df, s, (segment,))
    w = Window.partitionBy(*s.keys, segment)
    x = p.withColumn("mu", F.avg("y").over(w)).withColumn("med", F.median("y").over(w))
    x = x.withColumn("c", F.abs(F.sum(F.col("y") - F.col("mu")).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))))
    n, var, mean = F.count("y"), F.var_pop("y"), F.avg("y")
    sxx, sxy, syy = F.regr_sxx("y", F.col("i").cast("double")), F.regr_sxy("y", F.col("i").cast("double")), F.regr_syy("y", F.col("i").cast("double"))
    flat = (n < 2) | (var < 1e-10)
    logv = F.ln(F.when(var >= 1e-10, var))
    return x.groupBy(*s.keys, segment).agg(
        F.sum(F.abs(F.col("y") - F.col("med"))).alias("l1"), (n * var).alias("l2"), F.when(flat, 0.0).otherwise(n * logv).alias("normal"),
        F.when(mean < 1e-10, 0.0).otherwise(n * mean - F.sum("y") * F.ln(F.when(mean >= 1e-10, mean))).alias("poisson"),
        F.when(n < 3, 0.0).otherwise(F.greatest(F.lit(0.0), syy - sxy * sxy / F.nullif(sxx, F.lit(0.0)))).alias("linear_trend"),
        F.when(flat, 0.0).otherwise(n * (1 + logv)).alias("mean_variance"), F.max("c").alias("cusum"))


def segment_for_index(segments: DataFrame, points: DataFrame, s: Series, index: str = "i") -> DataFrame:
    """Points with the segment that holds their position, as an interval join."""
    return interval_join(points, segments.select(*s.keys, "segment", "start", "end"), s.keys, index, "start", "end").drop("start", "end")


def decompose(df: DataFrame, s: Series, periods_: int | tuple[int, ...], robust: bool = False, **options) -> DataFrame:
    """Keys, ``ds``, ``y``, ``trend``, ``seasonal`` (their sum), ``remainder`` and one
    ``seasonal_<period>`` each. One period is STL, several are MSTL; a series
    shorter than two of the longest gives no rows."""
    several = (periods_,) if isinstance(periods_, int) else tuple(sorted(set(periods_)))
    fields = [T.StructField("ds", df.schema[s.ts].dataType), *(T.StructField(c, T.DoubleType()) for c in ("y", "trend", "seasonal", "remainder", *(f"seasonal_{p}" for p in several)))]

    def f(y: np.ndarray, ds: pd.Series) -> list:
        try:
            parts = stl(y, several[0], robust=robust, **options) if len(several) == 1 else mstl(y, several, robust=robust, **options)
        except TooShort:
            return []
        cols = [y, parts.trend, parts.season, parts.remainder, *(parts.seasonal[p] for p in several)]
        return [(d, *map(float, v)) for d, *v in zip(ds, *cols, strict=True)]

    return _per_series(df, s, f, fields)


def strengths(parts: DataFrame, s: Series) -> DataFrame:
    """Keys, ``seasonal_strength``, ``trend_strength``: 1 - var(remainder) over the
    variance of the part with the remainder, within 0..1."""
    def strength(c: str) -> F.Column:
        whole = F.var_samp(F.col(c) + F.col("remainder"))
        return F.when(whole > 1e-10, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.var_samp("remainder") / F.nullif(whole, F.lit(0.0))))).otherwise(0.0)

    return parts.groupBy(*s.keys).agg(strength("seasonal").alias("seasonal_strength"), strength("trend").alias("trend_strength"))
