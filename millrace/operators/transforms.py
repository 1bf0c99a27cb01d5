"""Transformations of series: windows, scaling, Box-Cox, differences.

All but the Box-Cox search are window or aggregate expressions over one exchange
on the keys; it runs over each series' array, in time that grows with its
length. ``ewm`` and the operators of :mod:`chunks` split long series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ewm as ewm
from .series import Series, cleaned, prepare

ROLLING = ("mean", "std", "var", "min", "max", "sum", "median")
EXPANDING = ("mean", "sum", "max", "min")


def _aggregate(name: str, y: Column) -> Column:
    return {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum,
            "median": lambda c: F.percentile(c, 0.5)}[name](y)


def rolling(df: DataFrame, s: Series, window: int, functions: tuple[str, ...] = ROLLING, center: bool = False) -> DataFrame:
    """The prepared frame with ``rolling_<function>`` columns.

    Trailing windows are NULL until full; centred ones run from ``window // 2``
    rows before to ``window - window // 2 - 1`` after and are partial at the
    edges. ``std`` and ``var`` have divisor n - 1 and need two values.
    """
    if window < 1:
        raise ValueError("a window has one row at least")
    p = prepare(df, s)
    w = Window.partitionBy(*s.keys).orderBy("ds")
    frame = w.rowsBetween(-(window // 2), window - window // 2 - 1) if center else w.rowsBetween(-(window - 1), 0)
    for f in functions:
        x = _aggregate(f, F.col("y")).over(frame)
        p = p.withColumn(f"rolling_{f}", x if center else F.when(F.col("i") >= window - 1, x))
    return p


def expanding(df: DataFrame, s: Series, functions: tuple[str, ...] = EXPANDING) -> DataFrame:
    """The prepared frame with ``expanding_<function>``: over all rows so far."""
    p = prepare(df, s)
    w = Window.partitionBy(*s.keys).orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumns({f"expanding_{f}": _aggregate(f, F.col("y")).over(w) for f in functions})


SCALERS = ("standardize", "normalize", "robust", "center")


def scale_parameters(df: DataFrame, s: Series, method: str) -> DataFrame:
    """Keys, ``center`` and ``scale`` (1 where the spread is under 1e-10)."""
    y = cleaned(F.col(s.value))
    g = df.groupBy(*s.keys)
    if method == "standardize":
        p = g.agg(F.avg(y).alias("center"), F.stddev_samp(y).alias("scale"))
    elif method == "normalize":
        p = g.agg(F.min(y).alias("center"), (F.max(y) - F.min(y)).alias("scale"))
    elif method == "robust":
        p = g.agg(F.percentile(y, 0.5).alias("center"), (F.percentile(y, 0.75) - F.percentile(y, 0.25)).alias("scale"))
    elif method == "center":
        p = g.agg(F.avg(y).alias("center"), F.lit(1.0).alias("scale"))
    else:
        raise ValueError(f"unknown method {method}")
    return p.withColumn("scale", F.when(F.col("scale") >= 1e-10, F.col("scale")).otherwise(1.0))


def apply_scale(df: DataFrame, s: Series, parameters: DataFrame, inverse: bool = False) -> DataFrame:
    """(y - center) / scale by key, or back; 0 where a given scale is under 1e-10."""
    y, c, k = cleaned(F.col(s.value)), F.col("center"), F.col("scale")
    value = y * k + c if inverse else F.when(F.abs(k) < 1e-10, F.when(y.isNotNull(), 0.0)).otherwise((y - c) / F.nullif(k, F.lit(0.0)))
    return df.join(parameters, list(s.keys)).withColumn(s.value, value).drop("center", "scale")


def scale(df: DataFrame, s: Series, method: str) -> DataFrame:
    return apply_scale(df, s, scale_parameters(df, s, method))


def scale_to_range(df: DataFrame, s: Series, low: float, high: float) -> DataFrame:
    """Min-max to low..high; unchanged if ``low >= high``."""
    if low >= high:
        return df
    return scale(df, s, "normalize").withColumn(s.value, F.lit(float(low)) + F.col(s.value) * F.lit(float(high - low)))


def boxcox(y: Column, lam: Column | float) -> Column:
    """NULL for values not above 0; the logarithm where lambda is about 0."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    power = (F.pow(F.when(y > 0, y), lam) - 1) / F.when(F.abs(lam) >= 1e-10, lam)
    return F.when(y > 0, F.when(F.abs(lam) < 1e-10, F.ln(F.when(y > 0, y))).otherwise(power))


def inv_boxcox(z: Column, lam: Column | float) -> Column:
    """NULL where lambda * z + 1 is not above 0."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    base = lam * z + 1
    return F.when(F.abs(lam) < 1e-10, F.exp(z)).otherwise(F.pow(F.when(base > 0, base), 1 / F.when(F.abs(lam) >= 1e-10, lam)))


def boxcox_lambda(df: DataFrame, s: Series) -> DataFrame:
    """Keys and ``lambda``: the best profile likelihood on the grid -2..2 by 0.01
    (positive values only), then within 0.1 of it in 101 steps; 1 without any.

    The grid is run over a series' array, in blocks of it.
    """
    keys = list(s.keys)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("lambda", T.DoubleType())])

    def best(y: np.ndarray, logs: np.ndarray, grid: np.ndarray) -> float:
        v = np.empty(len(grid))
        step = max(1, 2_000_000 // len(y))
        for at in range(0, len(grid), step):
            lam = grid[at:at + step, None]
            zero = np.abs(lam) < 1e-10
            z = np.where(zero, logs, (np.power(y, lam) - 1) / np.where(zero, 1.0, lam))
            v[at:at + step] = z.var(axis=1)
        llf = -len(y) / 2 * np.log(np.maximum(v, 1e-300)) + (grid - 1) * logs.sum()
        return float(grid[int(np.argmax(llf))])  # the smallest of equals

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy(float)
        lam = 1.0
        if len(y):
            logs = np.log(y)
            lam = best(y, logs, np.arange(-200, 201) / 100)
            lam = best(y, logs, lam - 0.1 + np.arange(101) * 0.002)
        return pd.DataFrame([[*key, lam]], columns=schema.names)

    found = df.select(*keys, cleaned(F.col(s.value)).alias("y")).where("y > 0").groupBy(*keys).applyInPandas(run, schema)
    return df.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("lambda", F.lit(1.0)).alias("lambda"))


def boxcox_auto(df: DataFrame, s: Series) -> DataFrame:
    """The frame with the value transformed by each key's own ``lambda``, which is kept."""
    out = df.join(boxcox_lambda(df, s), list(s.keys))
    return out.withColumn(s.value, boxcox(cleaned(F.col(s.value)), F.col("lambda")))


def is_boxcox_suitable(df: DataFrame, s: Series) -> DataFrame:
    """Keys and ``suitable``: every value is above 0."""
    return df.groupBy(*s.keys).agg(F.coalesce(F.bool_and(F.coalesce(cleaned(F.col(s.value)) > 0, F.lit(False))), F.lit(False)).alias("suitable"))


def boxcox_shifted(df: DataFrame, s: Series, lam: float) -> DataFrame:
    """Box-Cox after adding ``shift`` (1 - minimum where that is not above 0, else
    0), which is kept so that the transformation can be undone."""
    y = cleaned(F.col(s.value))
    shift = df.groupBy(*s.keys).agg(F.when(F.min(y) <= 0, 1 - F.min(y)).otherwise(0.0).alias("shift"))
    return df.join(shift, list(s.keys)).withColumn(s.value, boxcox(y + F.col("shift"), lam))


def difference(df: DataFrame, s: Series, d: int = 1, period: int = 1) -> DataFrame:
    """The prepared frame with ``diff``: ``d`` times the difference at lag ``period``."""
    p = prepare(df, s).withColumn("diff", F.col("y"))
    w = Window.partitionBy(*s.keys).orderBy("ds")
    for _ in range(d):
        p = p.withColumn("diff", F.col("diff") - F.lag("diff", period).over(w))
    return p


def integrate(diffs: DataFrame, history: DataFrame, s: Series, d: int = 1) -> DataFrame:
    """Undo ``d`` differences of future rows: running sums that start from the last
    value of each difference level of the history."""
    w = Window.partitionBy(*s.keys).orderBy(s.ts).rowsBetween(Window.unboundedPreceding, 0)
    out = diffs
    for level in range(d - 1, -1, -1):
        h = difference(history, s, level)
        last = h.groupBy(*s.keys).agg(F.max_by("diff", "ds").alias("__last"))
        out = out.withColumn(s.value, F.sum(s.value).over(w)).join(last, list(s.keys)).withColumn(s.value, F.col(s.value) + F.coalesce("__last", F.lit(0.0))).drop("__last")
    return out


def suggest_differencing(df: DataFrame, s: Series) -> DataFrame:
    """Keys and ``d``: 1 if differencing brings the variance under 0.9 of what it
    was, 2 if a second time does so again and beats the original."""
    p = difference(df, s).withColumn("d2", F.col("diff") - F.lag("diff").over(Window.partitionBy(*s.keys).orderBy("ds")))
    v = p.groupBy(*s.keys).agg(F.var_samp("y").alias("v0"), F.var_samp("diff").alias("v1"), F.var_samp("d2").alias("v2"), F.count("diff").alias("n1"), F.count("d2").alias("n2"))
    one = (F.col("n1") >= 2) & (F.col("v0") > 0) & (F.col("v1") < 0.9 * F.col("v0"))
    two = (F.col("n2") >= 2) & (F.col("v2") < 0.9 * F.col("v1")) & (F.col("v2") < F.col("v0"))
    return v.select(*s.keys, F.when(F.coalesce(one & two, F.lit(False)), 2).when(F.coalesce(one, F.lit(False)), 1).otherwise(0).alias("d"))
