"""Forecasts of many series.

Two ways. Baselines, and smoothing with given parameters, are SQL over one
exchange on the keys (:mod:`millrace.functions.forecasts`). Every model is also
a NumPy kernel run per series and model: series and models are exploded before
the exchange, so several models of one long series are fitted by different
tasks, and a series that cannot be fitted yields a row with its status. Models
of intermittent demand, whose series are many and short, are computed for many
series of one length at once, each series a row, in the partitions there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import registry
from ..kernels.registry import MODELS, ModelSpec
from .series import Series, cleaned

Models = dict[str, ModelSpec] | list[str] | str


def specs(models: Models, period: int | None = None) -> dict[str, ModelSpec]:
    """Name to specification; names are looked up, and a period given once goes to all that take one."""
    named = models if isinstance(models, dict) else {m: MODELS[m] for m in ([models] if isinstance(models, str) else models)}
    return {k: m.with_period(period) if period else m for k, m in named.items()}


def spread(spark: SparkSession) -> int:
    """Tasks for work whose cost is the fitting and not the bytes: a number that is
    given, so that small partitions are not put together again."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _grouped(df: DataFrame, s: Series, names: list[str], extra: list[str] = ()) -> DataFrame:
    rows = df.select(*s.keys, F.col(s.ts).cast("timestamp").alias("ds"), cleaned(F.col(s.value)).alias("y"), *(cleaned(F.col(r)).alias(r) for r in s.regressors), *extra)
    rows = rows.withColumn("model", F.explode(F.array(*map(F.lit, names))))
    return rows.repartition(spread(rows.sparkSession), *s.keys, "model", *extra).groupBy(*s.keys, "model", *extra)


#: Series, and values of them, that are computed at once.
AT_ONCE, VALUES_AT_ONCE = 512, 1 << 20


@lru_cache(maxsize=10_000)
def _next_micros(a: int | None, b: int | None, h: int, zone: str) -> list[int | None]:
    """As :func:`_next_times`, of the last two times in microseconds, by the calendar of ``zone``."""
    if a is None or b is None:
        return [None] * h
    ends = pd.Series(pd.to_datetime([a, b], unit="us", utc=True).tz_convert(zone).tz_localize(None))
    ahead = pd.DatetimeIndex(_next_times(ends, h)).tz_localize(zone, ambiguous=np.zeros(h, bool), nonexistent="shift_forward").tz_convert("UTC").tz_localize(None)
    return [x.value // 1000 for x in ahead.as_unit("ns")]


def _batched(df: DataFrame, s: Series, use: dict[str, ModelSpec], h: int, level: float, schema: T.StructType) -> DataFrame:
    """:func:`forecast` by the models' batches: a series is a row with its values, so a task meets no series by itself."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    rows = df.select(*s.keys, F.col(s.ts).cast("timestamp").alias("__ds"), cleaned(F.col(s.value)).alias("__y"))
    series = rows.groupBy(*s.keys).agg(F.sort_array(F.collect_list(F.struct(F.col("__ds").isNull().alias("late"), F.unix_micros("__ds").alias("us"), F.col("__y").alias("y")))).alias("__rows"))
    series = series.select(*s.keys, F.expr("try_element_at(__rows.us, -2)").alias("__a"), F.expr("try_element_at(__rows.us, -1)").alias("__b"), F.col("__rows.y").alias("__y"))
    nk, z = len(s.keys), registry.interval_z(level)

    def computed(spec: ModelSpec, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        status, point, var = np.full(len(sizes), "ok", object), np.full(len(sizes), np.nan), np.full(len(sizes), np.nan)
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            step = max(1, min(AT_ONCE, VALUES_AT_ONCE // max(n, 1)))
            for k in range(0, len(at), step):
                part = at[k:k + step]
                y = values[starts[part][:, None] + np.arange(n)]
                whole = np.isfinite(y).all(1)
                status[part[~whole]] = "missing_values"
                part, y = part[whole], y[whole]
                if len(part):
                    good, point[part], var[part] = spec.batch(y, **spec.options)
                    status[part[~good]] = "insufficient_data"
        return status, point, var

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or h < 1:
                continue
            lists = b.column(nk + 2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(float)
            before, last = b.column(nk).to_pylist(), b.column(nk + 1).to_pylist()
            for name, spec in use.items():
                status, point, var = computed(spec, values, offsets[:-1], np.diff(offsets))
                good = status == "ok"
                each = np.where(good, h, 1)
                of = np.repeat(np.arange(len(good)), each)
                out = of[good[of]]
                ok = good[of]
                half = z * np.sqrt(np.maximum(var, 0.0))
                steps = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + 1
                times = [t for k in np.flatnonzero(good).tolist() for t in _next_micros(before[k], last[k], h, zone)]
                ahead = np.full(len(of), None, object)
                ahead[ok] = times
                doubles = []
                for x in (point, point - half, point + half):
                    column = np.full(len(of), np.nan)
                    column[ok] = x[out]
                    doubles.append(pa.array(column, pa.float64(), mask=~ok))
                yield pa.RecordBatch.from_arrays([
                    *(b.column(j).take(pa.array(of)) for j in range(nk)), pa.array([name] * len(of), pa.string()), pa.array(steps.astype(np.int32), pa.int32(), mask=~ok),
                    pa.array(ahead, pa.int64()).cast(pa.timestamp("us", "UTC")), *doubles, pa.array(np.full(len(of), level), pa.float64()), pa.array(status[of], pa.string())], names=schema.names)

    return series.mapInArrow(run, schema)


def _next_times(ds: pd.Series, h: int) -> list[pd.Timestamp]:
    """Times that carry on the last step (whole months where the days agree)."""
    if len(ds) < 2:
        return [pd.NaT] * h
    a, b = ds.iloc[-2], ds.iloc[-1]
    months = (b.year - a.year) * 12 + b.month - a.month
    if months and a.day == b.day and a.time() == b.time():
        return [b + pd.DateOffset(months=months * k) for k in range(1, h + 1)]
    return [b + (b - a) * k for k in range(1, h + 1)]


def forecast(df: DataFrame, s: Series, models: Models, h: int, level: float = 0.95, period: int | None = None, future: DataFrame | None = None) -> DataFrame:
    """Keys, ``model``, ``h``, ``ds``, ``yhat``, ``lo``, ``hi``, ``level``, ``status``.

    ``future`` has the keys, ``h`` and the regressors' columns, for models that
    take regressors. A series without a forecast has one row, with its status and
    NULLs; a horizon of 0 gives no rows.
    """
    use = specs(models, period)
    schema = T.StructType([*(df.schema[k] for k in s.keys), T.StructField("model", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("ds", T.TimestampType()),
                           *(T.StructField(c, T.DoubleType()) for c in ("yhat", "lo", "hi", "level")), T.StructField("status", T.StringType())])
    names = sorted(s.regressors)
    nk = len(s.keys)
    together = {} if names else {k: m for k, m in use.items() if m.batched()}
    if together:
        out = _batched(df, s, together, h, level, schema)
        rest = {k: m for k, m in use.items() if k not in together}
        return out.unionByName(forecast(df, s, rest, h, level)) if rest else out

    def fit(key: tuple, pdf: pd.DataFrame, ahead: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(pdf) or h < 1:
            return pd.DataFrame(columns=schema.names)
        pdf = pdf.sort_values("ds")
        x = pdf[names].to_numpy(float) if names else None
        fx = ahead.sort_values("h")[names].to_numpy(float)[:h] if names and ahead is not None else None
        out = registry.run(use[key[nk]], pdf["y"].to_numpy(float), h, level, x, fx)
        if out.fit is None:
            return pd.DataFrame([[*key[:nk + 1], None, None, None, None, None, level, out.status]], columns=schema.names)
        cols = {k: [v] * h for k, v in zip([*s.keys, "model"], key, strict=False)}
        return pd.DataFrame({**cols, "h": np.arange(1, h + 1, dtype="int32"), "ds": _next_times(pdf["ds"], h), "yhat": out.fit.point, "lo": out.lower, "hi": out.upper, "level": level, "status": "ok"})[schema.names]

    grouped = _grouped(df, s, list(use))
    if future is None or not names:
        return grouped.applyInPandas(lambda key, pdf: fit(key, pdf), schema)
    # renamed to themselves: future rows may come from the same frame as the history
    ahead = future.select(*(F.col(k).alias(k) for k in s.keys), F.col("h").cast("int").alias("h"), *(cleaned(F.col(r)).alias(r) for r in names)).withColumn("model", F.explode(F.array(*map(F.lit, use))))
    return grouped.cogroup(ahead.groupBy(*s.keys, "model")).applyInPandas(lambda key, a, b: fit(key, a, b), schema)


def fitted_values(df: DataFrame, s: Series, models: Models, level: float = 0.95, period: int | None = None) -> DataFrame:
    """Keys, ``model``, ``ds``, ``y``, ``fitted``, ``residual``, ``lo``, ``hi``, ``status``:
    one-step fits on the scale of the values, NULL in the warm-up."""
    use = specs(models, period)
    schema = T.StructType([*(df.schema[k] for k in s.keys), T.StructField("model", T.StringType()), T.StructField("ds", T.TimestampType()),
                           *(T.StructField(c, T.DoubleType()) for c in ("y", "fitted", "residual", "lo", "hi")), T.StructField("status", T.StringType())])
    nk = len(s.keys)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y = pdf["y"].to_numpy(float)
        out = registry.run(use[key[nk]], y, 1, level, pdf[sorted(s.regressors)].to_numpy(float) if s.regressors else None, pdf[sorted(s.regressors)].to_numpy(float)[-1:] if s.regressors else None)
        f = out.fit.fitted if out.fit is not None else np.full(len(y), np.nan)
        r = y - f
        ok = r[np.isfinite(r)]
        half = registry.interval_z(level) * np.sqrt((ok**2).mean()) if len(ok) else np.nan
        cols = {k: [v] * len(y) for k, v in zip([*s.keys, "model"], key, strict=False)}
        out_df = pd.DataFrame({**cols, "ds": pdf["ds"].to_numpy(), "y": y, "fitted": f, "residual": r, "lo": f - half, "hi": f + half, "status": out.status})[schema.names]
        return out_df.astype({c: object for c in ("y", "fitted", "residual", "lo", "hi")}).where(out_df.notna(), None)

    return _grouped(df, s, list(use)).applyInPandas(fit, schema)


def conditional_variance(df: DataFrame, s: Series, h: int, p: int = 1, q: int = 1) -> DataFrame:
    """Keys, ``h``, ``variance``, ``omega``, ``unconditional`` and ``status`` of a GARCH(p, q)."""
    schema = T.StructType([*(df.schema[k] for k in s.keys), T.StructField("h", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("variance", "omega", "unconditional")), T.StructField("status", T.StringType())])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = registry.run(MODELS["garch"].with_options(p=p, q=q), pdf.sort_values("ds")["y"].to_numpy(float), h)
        if out.fit is None:
            return pd.DataFrame([[*key[:len(s.keys)], None, None, None, None, out.status]], columns=schema.names)
        i = out.fit.info
        return pd.DataFrame([[*key[:len(s.keys)], k + 1, v, i["omega"], i.get("unconditional"), "ok"] for k, v in enumerate(out.fit.variance.tolist())], columns=schema.names)

    return _grouped(df, s, ["garch"]).applyInPandas(fit, schema)


def ensemble(forecasts: DataFrame, s: Series, method: str = "mean", weights: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """Combine the models of each key and step: ``mean``, ``median`` or ``weighted``.

    Weights are a mapping by model or a frame (keys, ``model``, ``weight``), as
    :func:`inverse_mse_weights` gives. Bounds are combined like points.
    """
    f = forecasts.where("status = 'ok'")
    g = [*s.keys, "h"]
    if method in ("mean", "median"):
        agg = F.avg if method == "mean" else F.median
        return f.groupBy(*g).agg(F.max("ds").alias("ds"), *(agg(c).alias(c) for c in ("yhat", "lo", "hi")), F.count(F.lit(1)).alias("models"))
    if method != "weighted" or weights is None:
        raise ValueError("method is mean, median or weighted (with weights)")
    if isinstance(weights, dict):
        f = f.withColumn("weight", F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("model")])
    else:
        f = f.join(weights.select(*s.keys, "model", "weight"), [*s.keys, "model"])
    total = F.sum("weight")
    return f.where("weight > 0").groupBy(*g).agg(F.max("ds").alias("ds"), *((F.sum(F.col(c) * F.col("weight")) / total).alias(c) for c in ("yhat", "lo", "hi")), F.count(F.lit(1)).alias("models"))


def inverse_mse_weights(fits: DataFrame, s: Series) -> DataFrame:
    """Keys, ``model`` and ``weight``: inverse mean squared residual, over those
    residuals there are, scaled to sum 1."""
    mse = fits.where("status = 'ok' and residual is not null").groupBy(*s.keys, "model").agg(F.avg(F.col("residual") * F.col("residual")).alias("mse"))
    w = mse.withColumn("w", 1 / F.greatest("mse", F.lit(1e-10)))
    total = w.groupBy(*s.keys).agg(F.sum("w").alias("t"))
    return w.join(total, list(s.keys)).select(*s.keys, "model", (F.col("w") / F.col("t")).alias("weight"))
