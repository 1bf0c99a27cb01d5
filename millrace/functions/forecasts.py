"""Baseline and fixed-parameter forecasts as SQL over one pass.

Written for two dialects like the features. Each gives the key, ``h``, ``yhat``,
``lo`` and ``hi``; without two residuals the bounds are NULL or the point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..kernels.numeric import interval_z
from ..operators.series import Series, prepare
from .features import doubles


class Steps:
    """Spark's spelling of the horizon."""

    def across(self, rows: str, h: int) -> str:
        return f"(select q.*, h from ({rows}) q lateral view explode(sequence(1, {h})) s as h)"


class DuckSteps(Steps):
    def across(self, rows: str, h: int) -> str:
        return f"(select q.*, cast(h as integer) as h from ({rows}) q, unnest(generate_series(1, {h})) s(h))"


def _out(point: str, var: str, rows: str, level: float, d: Steps, h: int) -> str:
    z = interval_z(level)
    return f"select {{K}}, h, {point} as yhat, {point} - {z!r} * sqrt({var}) as lo, {point} + {z!r} * sqrt({var}) as hi from {d.across(rows, h)} f"


def naive(d, h, level):
    rows = "select {K}, max(case when i = n - 1 then y end) as p, avg(power(y - l1, 2)) as s2 from (select *, lag(y, 1) over ({W}) as l1 from {p}) a group by {K}"
    return _out("p", "s2 * h", rows, level, d, h)


def random_walk_with_drift(d, h, level):
    slope = "((last_y - first_y) / nullif(n - 1, 0))"
    inner = "select *, lag(y, 1) over ({W}) as l1, max(case when i = n - 1 then y end) over ({P}) as last_y, max(case when i = 0 then y end) over ({P}) as first_y from {p}"
    rows = f"select {{K}}, max(last_y) as p, max({slope}) as b, avg(power(y - l1 - {slope}, 2)) as s2 from ({inner}) a group by {{K}}"
    return _out("(p + b * h)", "s2 * h", rows, level, d, h)


def _phases(point_rows: str, fit: str, m: int, d: Steps, h: int, level: float) -> str:
    """Steps take the point of their phase (0..m-1 after the end)."""
    z = interval_z(level)
    s2 = f"select {{K}}, avg(power(y - f, 2)) as s2 from (select *, {fit} as f from {{p}}) a group by {{K}}"
    return (f"select g.*, g.p as yhat, g.p - {z!r} * sqrt(v.s2 * (floor((h - 1) / {float(m)}) + 1)) as lo, g.p + {z!r} * sqrt(v.s2 * (floor((h - 1) / {float(m)}) + 1)) as hi "
            f"from {d.across(point_rows, h)} g join ({s2}) v on {{ON}} where (h - 1) % {m} = phase")


def seasonal_naive(d, h, level, period=7):
    rows = f"select {{K}}, i - (n - {period}) as phase, y as p from {{p}} where i >= n - {period} and n >= {period}"
    return f"select {{K}}, h, yhat, lo, hi from ({_phases(rows, f'lag(y, {period}) over ({{W}})', period, d, h, level)}) r"


def seasonal_window_average(d, h, level, period=7, window=2):
    m = period
    phase = f"((i - n) % {m} + {m}) % {m}"
    rows = f"select {{K}}, {phase} as phase, avg(y) as p from {{p}} where i >= n - {window * m} and n >= {m} group by {{K}}, {phase}"
    lags = [f"lag(y, {c * m}) over ({{W}})" for c in range(1, window + 1)]
    total = " + ".join(f"coalesce({x}, 0.0)" for x in lags)
    count = " + ".join(f"case when {x} is null then 0 else 1 end" for x in lags)
    return f"select {{K}}, h, yhat, lo, hi from ({_phases(rows, f'({total}) / nullif({count}, 0)', m, d, h, level)}) r"


def simple_moving_average(d, h, level, window=7):
    if window:
        fit = f"case when i >= {window} then avg(y) over ({{W}} rows between {window} preceding and 1 preceding) end"
        rows = f"select {{K}}, avg(case when i >= n - {window} then y end) as p, avg(power(y - f, 2)) as s2 from (select *, {fit} as f from {{p}} where n >= {window}) a group by {{K}}"
    else:
        rows = "select {K}, avg(y) as p, avg(power(y - f, 2)) as s2 from (select *, avg(y) over ({W} rows between unbounded preceding and 1 preceding) as f from {p}) a group by {K}"
    return _out("p", "s2", rows, level, d, h)


def historic_average(d, h, level):
    return simple_moving_average(d, h, level, 0)


def window_average(d, h, level, window=14):
    return simple_moving_average(d, h, level, max(1, window))


def _smoothed(x: str, at: str, count: str, alpha: float) -> str:
    """The last level of simple smoothing that starts at the first value, as one weighted sum."""
    a, b = alpha, 1 - alpha
    return f"sum({x} * case when {at} = 0 then power({b!r}, {count} - 1) else {a!r} * power({b!r}, {count} - 1 - {at}) end)"


def ses_fixed(d, h, level, alpha=0.3):
    rows = f"select {{K}}, {_smoothed('y', 'i', 'n', alpha)} as p, cast(null as double) as s2 from {{p}} group by {{K}}"
    return _out("p", "s2", rows, level, d, h)


def croston(d, h, level, alpha=0.1, sba=False):
    demand = ("select {K}, y, i - coalesce(lag(i) over ({W}), -1) as gap, row_number() over ({W}) - 1 as j, count(*) over ({P}) as c from {p} where y > 0 and n >= 4")
    factor = 1 - alpha / 2 if sba else 1.0
    rows = f"select {{K}}, {factor!r} * {_smoothed('y', 'j', 'c', alpha)} / greatest({_smoothed('gap', 'j', 'c', alpha)}, 0.001) as p, cast(null as double) as s2 from ({demand}) a where c >= 2 group by {{K}}"
    return _out("p", "s2", rows, level, d, h)


def croston_sba(d, h, level, alpha=0.1):
    return croston(d, h, level, alpha, True)


def tsb(d, h, level, alpha=0.1, beta=0.1):
    sizes = f"select {{K}}, {_smoothed('y', 'j', 'c', alpha)} as size from (select {{K}}, y, row_number() over ({{W}}) - 1 as j, count(*) over ({{P}}) as c from {{p}} where y > 0) a group by {{K}}"
    chance = f"select {{K}}, {_smoothed('case when y > 0 then 1.0 else 0.0 end', 'i', 'n', beta)} as pr from {{p}} group by {{K}}"
    rows = f"select v.*, coalesce(g.size, 0.0) * v.pr as p, cast(null as double) as s2 from ({chance}) v left join ({sizes}) g on {{ON}}"
    return _out("p", "s2", rows, level, d, h)


MODELS = {f.__name__: f for f in (naive, random_walk_with_drift, seasonal_naive, seasonal_window_average, simple_moving_average, historic_average, window_average, ses_fixed, croston, croston_sba, tsb)}


def _sql(sql: str, keys: tuple[str, ...], p: str, digits: int | None) -> str:
    k = ", ".join(keys)
    sql = sql.format(K=k, P=f"partition by {k}", W=f"partition by {k} order by i", p=p, ON=" and ".join(f"g.{c} = v.{c}" for c in keys))
    sql = doubles(sql)
    if digits is None:
        return sql
    return f"select {k}, h, " + ", ".join(f"round({c}, {digits}) + 0.0e0 as {c}" for c in ("yhat", "lo", "hi")) + f" from ({sql}) z"


def oracle(model: str, prepared: str, h: int, level: float = 0.95, key: str = "key", digits: int = 6, **options) -> str:
    """DuckDB SQL over ``prepared`` (SQL giving the key, i, n, y)."""
    return f"with p as ({prepared}) " + _sql(MODELS[model](DuckSteps(), h, level, **options), (key,), "p", digits)


def baseline(df: DataFrame, s: Series, model: str, h: int, level: float = 0.95, digits: int | None = None, **options) -> DataFrame:
    """Keys, ``h``, ``yhat``, ``lo``, ``hi``; no rows for a series that is too short.

    Smoothing and intermittent models with given parameters have no bounds here:
    these need the path of one-step errors, which the kernels give.
    """
    view = prepare(df, s).select(*s.keys, "i", "n", "y")
    return df.sparkSession.sql(_sql(MODELS[model](Steps(), h, level, **options), s.keys, "{p}", digits), p=view)
