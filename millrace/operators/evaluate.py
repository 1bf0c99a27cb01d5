"""Accuracy, rolling-origin evaluation and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import registry
from ..kernels.smoothing import sigma2
from .forecast import Models, specs, spread
from .series import Series, cleaned


def metric_columns(a: Column, p: Column) -> dict[str, Column]:
    """Aggregates of actual and predicted: mae, mse, rmse, mape (NULL if any actual is 0), smape, r2 (1 if constant)."""
    e = a - p
    both = F.abs(a) + F.abs(p)
    ss = F.var_pop(a) * F.count(a)
    return {
        "n": F.count(e), "mae": F.avg(F.abs(e)), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.when(F.min(F.abs(a)) > 0, F.avg(F.abs(e) / F.nullif(F.abs(a), F.lit(0.0))) * 100),
        "smape": F.avg(F.when(both == 0, 0.0).otherwise(2 * F.abs(e) / F.nullif(both, F.lit(0.0)))) * 100,
        "r2": F.when(ss < 1e-10, 1.0).otherwise(1 - F.sum(e * e) / F.nullif(ss, F.lit(0.0))),
    }


def metrics(df: DataFrame, groups: list[str], actual: str = "y", predicted: str = "yhat", order: str | None = None, period: int = 1, scale: DataFrame | None = None) -> DataFrame:
    """Accuracy by group. With ``order``, also ``mase``, scaled by the seasonal
    naive error of the actuals themselves (NULL if 0 or too few), or by ``scale``
    (groups and ``scale``, as from the training data) if given."""
    a, p = F.col(actual), F.col(predicted)
    cols = metric_columns(a, p)
    if order is None:
        return df.groupBy(*groups).agg(*(c.alias(n) for n, c in cols.items()))
    d = df.withColumn("__d", F.abs(a - F.lag(a, period).over(Window.partitionBy(*groups).orderBy(order))))
    out = d.groupBy(*groups).agg(*(c.alias(n) for n, c in cols.items()), F.avg("__d").alias("__s"))
    if scale is not None:
        out = out.join(scale.select(*groups, F.col("scale").alias("__t")), groups, "left").withColumn("__s", F.col("__t")).drop("__t")
    return out.withColumn("mase", F.when(F.col("__s") > 0, F.col("mae") / F.nullif(F.col("__s"), F.lit(0.0)))).drop("__s")


#: Models whose forecast from every origin is a window expression.
WINDOWED = ("naive", "random_walk_with_drift", "seasonal_naive", "historic_average", "window_average")
#: What these take where nothing is given: the period, and the rows of ``window_average``.
_PERIOD, _AVERAGED = 12, 7


def _windowed_folds(df: DataFrame, s: Series, names: list[str], window: int, horizon: int, step: int, expanding: bool, period: int | None) -> DataFrame:
    """:func:`cross_validate` for models of ``WINDOWED``: each row is an origin's
    last training row, whose forecast looks back over the frame of that origin,
    and a test row takes it from as many rows ago as it is ahead. One sort of
    each series serves all folds, models and steps; no row is copied for a fold.
    """
    m = period or _PERIOD
    w = Window.partitionBy(*s.keys).orderBy("ds")
    frame = w.rowsBetween(Window.unboundedPreceding if expanding else 1 - window, 0)
    p = df.select(*s.keys, F.col(s.ts).alias("ds"), cleaned(F.col(s.value)).alias("y"))
    p = p.withColumn("i", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*s.keys)))
    size = F.col("i") + 1 if expanding else F.least(F.col("i") + 1, F.lit(window))
    p = p.withColumns({"__size": size, "__seen": F.count("y").over(frame), "__first": F.first("y").over(frame), "__mean": F.avg("y").over(frame), "__last": F.avg("y").over(w.rowsBetween(1 - _AVERAGED, 0))})
    p = p.withColumn("__slope", (F.col("y") - F.col("__first")) / F.nullif(F.col("__size") - 1, F.lit(0)))
    need = {"naive": 1, "random_walk_with_drift": 2, "seasonal_naive": m, "historic_average": 1, "window_average": _AVERAGED}
    steps = []
    for h in range(1, horizon + 1):
        def ago(c: str, extra: int = 0, h: int = h) -> Column:
            return F.lag(c, h + extra).over(w)

        point = {"naive": lambda: ago("y"), "random_walk_with_drift": lambda: ago("y") + h * ago("__slope"), "seasonal_naive": lambda: ago("y", m - 1 - (h - 1) % m),
                 "historic_average": lambda: ago("__mean"), "window_average": lambda: ago("__last")}
        short = {k: ago("__size") < need[k] for k in names}
        gap = ago("__seen") < ago("__size")
        found = [F.struct(F.lit(k).alias("model"), F.when(gap, "missing_values").when(short[k], "insufficient_data").otherwise("ok").alias("status"), F.when(~gap & ~short[k], point[k]()).alias("yhat")) for k in names]
        p = p.withColumn(f"__h{h}", F.array(*found))
        steps.append(F.struct(F.lit(h).alias("h"), (F.col("i") - h + 1 - window).alias("from"), F.col(f"__h{h}").alias("found")))
    rows = p.select(*s.keys, "y", "n", F.explode(F.array(*steps)).alias("x")).where(f"x.from >= 0 and x.from % {step} = 0 and x.from + {window + horizon} <= n")
    out = rows.select(*s.keys, F.expr(f"cast(x.from div {step} as int)").alias("fold"), "x.h", "y", F.explode("x.found").alias("f"))
    return out.select(*s.keys, "f.model", "fold", "h", "y", "f.yhat", "f.status")


def cross_validate(df: DataFrame, s: Series, models: Models, window: int = 10, horizon: int = 1, step: int = 1, expanding: bool = True, period: int | None = None, folds_per_task: int = 16) -> DataFrame:
    """Keys, ``model``, ``fold``, ``h``, ``y``, ``yhat``, ``status`` for every origin
    from ``window`` on, ``step`` apart, that leaves ``horizon`` values.

    A series is sent once for every ``folds_per_task`` neighbouring folds, whatever
    the number of models, and only the rows these folds need; so a long series runs
    on several tasks. Regressors of the test rows are used as known. Models of
    ``WINDOWED`` that are given by name, without regressors, are window
    expressions in the JVM instead.
    """
    if not isinstance(models, dict) and not s.regressors:
        given = [models] if isinstance(models, str) else list(dict.fromkeys(models))
        if plain := [k for k in given if k in WINDOWED]:
            folds = _windowed_folds(df, s, plain, window, horizon, step, expanding, period)
            rest = [k for k in given if k not in WINDOWED]
            return folds.unionByName(cross_validate(df, s, rest, window, horizon, step, expanding, period, folds_per_task)) if rest else folds
    use = specs(models, period)
    names = sorted(s.regressors)
    w = s.by_time()
    rows = df.select(*s.keys, F.col(s.ts).alias("ds"), cleaned(F.col(s.value)).alias("y"), *names, (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(s.whole()).alias("n"))
    # folds whose training or test part holds row i; fold k starts testing at window + k * step
    last = F.floor((F.col("n") - window - horizon) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - window - horizon + 1) / step)).cast("int")
    until = last if expanding else F.least(last, F.floor(F.col("i") / step))
    rows = rows.where(last >= 0).withColumn("last", until.cast("int")).withColumn("first", first).where("first <= last")
    rows = rows.withColumn("part", F.explode(F.expr(f"sequence(int(first div {folds_per_task}), int(last div {folds_per_task}))")))
    schema = T.StructType([*(df.schema[k] for k in s.keys), T.StructField("model", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("h", T.IntegerType()),
                           T.StructField("y", T.DoubleType()), T.StructField("yhat", T.DoubleType()), T.StructField("status", T.StringType())])
    nk = len(s.keys)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        at, y = pdf["i"].to_numpy(), pdf["y"].to_numpy(float)
        x = pdf[names].to_numpy(float) if names else None
        begin = int(key[nk]) * folds_per_task
        end = min(begin + folds_per_task, (int(pdf["n"].iloc[0]) - window - horizon) // step + 1)
        out = []
        for fold in range(begin, end):
            origin = window + fold * step
            a, b, c = np.searchsorted(at, [0 if expanding else origin - window, origin, origin + horizon]).tolist()
            for model, spec in use.items():
                got = registry.run(spec, y[a:b], horizon, 0.95, *((x[a:b], x[b:c]) if names else (None, None)))
                yhat = got.fit.point if got.fit is not None else [None] * (c - b)
                out += [[*key[:nk], model, fold, h + 1, v, p, got.status] for h, (v, p) in enumerate(zip(y[b:c].tolist(), yhat, strict=True))]
        return pd.DataFrame(out, columns=schema.names)

    rows = rows.select(*s.keys, "part", "i", "n", "y", *names).repartition(spread(rows.sparkSession), *s.keys, "part")
    return rows.groupBy(*s.keys, "part").applyInPandas(fit, schema)


def cv_summary(folds: DataFrame, s: Series) -> DataFrame:
    """Means over folds of each fold's metrics, and the sample deviations of mae
    and rmse; mape only where every fold has it."""
    per = metrics(folds.where("status = 'ok'"), [*s.keys, "model", "fold"])
    g = per.groupBy(*s.keys, "model")
    return g.agg(F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("smape").alias("smape"),
                 F.when(F.count("mape") == F.count(F.lit(1)), F.avg("mape")).alias("mape"), F.stddev_samp("mae").alias("mae_std"), F.stddev_samp("rmse").alias("rmse_std"))


def bootstrap_forecast(df: DataFrame, s: Series, model: str, h: int, samples: int = 200, block: int | None = None, level: float = 0.95, period: int | None = None, seed: int = 1, batch: int = 25) -> DataFrame:
    """Keys, ``h``, ``yhat``, ``lo``, ``hi``: empirical quantiles of the forecasts
    refitted on series rebuilt from the fit and resampled residuals (single ones,
    or moving blocks). Where there is no fit, the value itself is used.

    Draws are dealt out in batches over tasks; each draw's generator is seeded by
    the series, the draw and ``seed``.
    """
    spec = specs(model, period)[model]
    schema = T.StructType([*(df.schema[k] for k in s.keys), T.StructField("draw", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("v", T.DoubleType())])
    rows = df.select(*s.keys, F.col(s.ts).alias("ds"), cleaned(F.col(s.value)).alias("y"))
    batches = -(-samples // batch)
    rows = rows.withColumn("batch", F.explode(F.expr(f"sequence(-1, {batches - 1})"))).withColumn("hash", F.xxhash64(*s.keys))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y, b, nk = pdf["y"].to_numpy(float), int(key[-1]), len(s.keys)
        base = registry.run(spec, y, h)
        if base.fit is None:
            return pd.DataFrame(columns=schema.names)
        if b < 0:
            return pd.DataFrame([[*key[:nk], -1, k + 1, v] for k, v in enumerate(base.fit.point.tolist())], columns=schema.names)
        has = np.isfinite(base.fit.fitted)
        fitted = np.where(has, base.fit.fitted, y)
        resid = (y - fitted)[has]
        out = []
        for draw in range(b * batch, min(samples, (b + 1) * batch)):
            rng = np.random.default_rng([seed, draw, int(pdf["hash"].iloc[0]) & 0xFFFFFFFFFFFF])
            n = len(resid)
            if block:
                starts = rng.integers(0, max(1, n - block + 1), -(-n // block))
                noise = np.concatenate([resid[i:i + block] for i in starts])[:n] if n else resid
            else:
                noise = resid[rng.integers(0, n, n)] if n else resid
            z = fitted.copy()
            z[has] += np.resize(noise, has.sum()) if n else 0
            again = registry.run(spec, z, h)
            if again.fit is not None:
                out += [[*key[:nk], draw, k + 1, v] for k, v in enumerate(again.fit.point.tolist())]
        return pd.DataFrame(out, columns=schema.names)

    draws = rows.groupBy(*s.keys, "batch").applyInPandas(fit, schema)
    tail = (1 - level) / 2
    vals = F.array_sort(F.collect_list(F.when(F.col("draw") >= 0, F.col("v"))))
    out = draws.groupBy(*s.keys, "h").agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("yhat"), vals.alias("v"))
    at = lambda q: F.try_element_at("v", (F.least(F.floor(F.lit(q) * F.size("v")), F.size("v") - 1) + 1).cast("int"))
    return out.select(*s.keys, "h", "yhat", at(tail).alias("lo"), at(1 - tail).alias("hi"))


def residual_variance(y: np.ndarray, fitted: np.ndarray) -> float:
    return sigma2(y, fitted)


def ols_fit(df: DataFrame, s: Series) -> DataFrame:
    """Keys and ``coefficients`` (map; ``intercept`` and the regressors by name) of
    the value on the regressors. One regressor is an aggregate; more go through
    sums of products (a map-side aggregate of fixed size) and a small solve."""
    names = sorted(s.regressors)
    y = cleaned(F.col(s.value))
    if not names:
        return df.groupBy(*s.keys).agg(F.create_map(F.lit("intercept"), F.avg(y)).alias("coefficients"))
    cols = [F.lit(1.0), *(cleaned(F.col(r)) for r in names)]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * y) for c in cols]
    ok = y.isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    g = df.where(ok).groupBy(*s.keys).agg(F.array(*sums).alias("m"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(m: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> list[float]:
            a = np.zeros((k, k))
            a[np.triu_indices(k)] = v[:k * (k + 1) // 2]
            a = a + np.triu(a, 1).T + 1e-8 * np.eye(k)
            return np.linalg.solve(a, v[k * (k + 1) // 2:]).tolist()
        return m.map(lambda v: one(np.asarray(v, float)))

    return g.select(*s.keys, F.map_from_arrays(F.array(*map(F.lit, ["intercept", *names])), solve("m")).alias("coefficients"))


def ols_predict(df: DataFrame, s: Series, fit: DataFrame) -> DataFrame:
    """The frame with ``prediction`` and, where there is a value, ``ols_residual``."""
    c = F.col("coefficients")
    p = c["intercept"]
    for r in s.regressors:
        p = p + c[r] * cleaned(F.col(r))
    out = df.join(fit, list(s.keys)).withColumn("prediction", p)
    return out.withColumn("ols_residual", cleaned(F.col(s.value)) - F.col("prediction")).drop("coefficients")
