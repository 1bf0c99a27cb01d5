"""The 69 series features.

A feature is a SQL aggregate over the prepared frame (``i``, ``n``, ``y``) and
the window columns it names; all features asked for share one pass: one
exchange on the keys, one sort by time (plus one by value where ranks are
needed) and one aggregation. Features that count values or runs first have a
query of their own, entropies of templates are a neighbour join, and those
without a closed form run as NumPy kernels over whole series. The SQL is written once for two dialects, Spark's and DuckDB's.

What the definitions call undefined (too short, no variation) is NULL.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import features as kernels
from ..operators import entropy
from ..operators.series import Series, prepare

EPS = "1e-10"


class Dialect:
    """Spark's spelling."""

    name = "spark"

    def quantile(self, x: str, q: float, over: str = "") -> str:
        return f"percentile({x}, {q}){over}"

    def middle(self, values: list[str]) -> str:
        a, m = f"array_sort(array({', '.join(values)}))", len(values)
        return f"({a}[{(m - 1) // 2}] + {a}[{m // 2}]) / 2"


class DuckDialect(Dialect):
    name = "duckdb"

    def quantile(self, x: str, q: float, over: str = "") -> str:
        return f"quantile_cont({x}, {q}){over}"

    def middle(self, values: list[str]) -> str:
        a, m = f"list_sort([{', '.join(values)}])", len(values)
        return f"({a}[{(m - 1) // 2 + 1}] + {a}[{m // 2 + 1}]) / 2"


@dataclass(frozen=True)
class Agg:
    """An aggregate and the window columns it reads ({P}: keys, {W}: keys by time)."""

    sql: str
    cols: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Nested:
    """A query (from ``{p}``, giving the keys and ``v``) of more than one level."""

    sql: str
    #: Value of a series that the query has no row for.
    default: str | None = None


@dataclass(frozen=True)
class Kernel:
    """A NumPy function over a whole series."""

    f: Callable[..., float | None]
    args: tuple = ()


@dataclass(frozen=True)
class Neighbours:
    """A column of the neighbour join of templates (:mod:`millrace.operators.entropy`)."""

    column: str
    m: int
    r: float


L1, L2 = {"l1": "lag(y, 1) over ({W})"}, {"l2": "lag(y, 2) over ({W})"}
MU, SD = {"mu": "avg(y) over ({P})"}, {"sd": "stddev_pop(y) over ({P})"}
MN, MX = {"mn": "min(y) over ({P})"}, {"mx": "max(y) over ({P})"}
N = "max(n)"


def _count(cond: str) -> str:
    return f"count(case when {cond} then 1 end)"


def _ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def _lead(k: int) -> dict[str, str]:
    return {f"f{k}": f"lead(y, {k}) over ({{W}})"}


def _lag(k: int) -> dict[str, str]:
    return {f"l{k}": f"lag(y, {k}) over ({{W}})"}


def _acf(k: int) -> str:
    return f"case when var_pop(y) < {EPS} then 0.0 when {N} > {k} then sum((y - mu) * (l{k} - mu)) / nullif(({N} - {k}) * var_pop(y), 0) end"


def _simple(sql: str, *cols: dict[str, str]) -> Callable:
    return lambda d: Agg(sql, {k: v for c in cols for k, v in c.items()})


def mean_n_absolute_max(d, number_of_maxima=7):
    return Agg(f"avg(case when ra <= {number_of_maxima} then abs(y) end)", {"ra": "row_number() over (partition by {K} order by abs(y) desc nulls last)"})


def quantile(d, q=0.25):
    return Agg(d.quantile("y", min(1.0, max(0.0, q))))


def large_standard_deviation(d, r=0.25):
    return Agg(f"max(y) - min(y) >= {EPS} and stddev_pop(y) > {r} * (max(y) - min(y))")


def symmetry_looking(d, r=0.1):
    return Agg(f"max(y) - min(y) < {EPS} or abs(avg(y) - median(y)) < {r} * (max(y) - min(y))")


def ratio_beyond_r_sigma(d, r=1.0):
    return Agg(f"avg(case when abs(y - mu) > {r} * sd then 1.0 else 0.0 end)", MU | SD)


def autocorrelation(d, lag=1):
    return Agg("1.0 * max(1)") if lag == 0 else Agg(_acf(lag), MU | _lag(lag))


def agg_autocorrelation(d, max_lag=10, f="mean"):
    lags = [f"({_acf(k)})" for k in range(1, max_lag + 1)]
    mean = f"({' + '.join(lags)}) / {max_lag}"
    var = f"({' + '.join(f'power({x} - ({mean}), 2)' for x in lags)}) / {max_lag - 1}"
    sql = {"mean": mean, "var": var, "std": f"sqrt({var})", "median": d.middle(lags)}.get(f, "cast(null as double)")
    return Agg(sql, MU | {k: v for j in range(1, max_lag + 1) for k, v in _lag(j).items()})


def time_reversal_asymmetry_statistic(d, lag=1):
    return Agg(f"avg(f{2 * lag} * f{2 * lag} * f{lag} - f{lag} * y * y)", _lead(lag) | _lead(2 * lag))


def count_above(d, t=0.0):
    return Agg(_count(f"y > {t}"))


def count_below(d, t=0.0):
    return Agg(_count(f"y < {t}"))


def number_peaks(d, support=1):
    if support == 0:
        return Agg("count(case when false then 1 end)")
    s = support
    return Agg(_count(f"i >= {s} and i < n - {s} and y > pb{s} and y > pa{s}"), {
        f"pb{s}": f"max(y) over ({{W}} rows between {s} preceding and 1 preceding)", f"pa{s}": f"max(y) over ({{W}} rows between 1 following and {s} following)"})


def number_crossing_m(d, m=0.0):
    return Agg(_count(f"(l1 <= {m}) <> (y <= {m})"), L1)


def _strike(side: str) -> Callable:
    def f(d):
        return Nested(f"select {{K}}, max(c) as v from (select {{K}}, i - r as g, count(*) as c from (select {{K}}, i, row_number() over (partition by {{K}} order by i) as r "
                      f"from (select {{K}}, i, y, avg(y) over ({{P}}) as mu from {{p}}) a where y {side} mu) b group by {{K}}, i - r) c group by {{K}}", "0")
    return f


def has_duplicate(d):
    return Agg(f"coalesce(bool_or(y - sy < {EPS}), false)", {"sy": "lag(y) over (partition by {K} order by y)"})


def index_mass_quantile(d, q=0.5):
    return Agg(f"case when max(ta) < {EPS} then 0.0 else min(case when ca >= {q} * ta then (i + 1.0) / n end) end", {
        "ca": "sum(abs(y)) over ({W} rows between unbounded preceding and current row)", "ta": "sum(abs(y)) over ({P})"})


def value_count(d, value=0.0):
    return Agg(_count(f"abs(y - ({value})) < {EPS}"))


def range_count(d, low=-1.0, high=1.0):
    return Agg(_count(f"y between {low} and {high}"))


def permutation_entropy(d, order=3, delay=1, normalized=False):
    leads = ", ".join(f"lead(y, {k * delay}) over ({{W}}) as v{k}" for k in range(order))
    pattern = " || ".join(f"case when v{a} <= v{b} then '1' else '0' end" for a in range(order) for b in range(a + 1, order))
    scale = f" / {math.log(math.factorial(order))!r}" if normalized else ""
    return Nested(f"select {{K}}, -sum(c * 1.0 / t * ln(c * 1.0 / t)){scale} as v from (select {{K}}, c, sum(c) over (partition by {{K}}) as t from (select {{K}}, {pattern} as p, count(*) as c "
                  f"from (select {{K}}, {leads} from {{p}}) a where v{order - 1} is not null group by {{K}}, {pattern}) b) c group by {{K}}")


def permutation_entropy_normalized(d, order=3, delay=1):
    return permutation_entropy(d, order, delay, True)


def binned_entropy(d, max_bins=10):
    bins = f"least({max_bins}, n)"
    b = f"least(floor((y - mn) / nullif((mx - mn) / {bins}, 0)), {bins} - 1)"
    return Nested(f"select {{K}}, case when max(w) < {EPS} then 0.0 else -sum(c * 1.0 / t * ln(c * 1.0 / t)) end as v from (select {{K}}, c, w, sum(c) over (partition by {{K}}) as t from (select {{K}}, {b} as b, max(mx - mn) as w, count(*) as c "
                  f"from (select {{K}}, y, n, min(y) over ({{P}}) as mn, max(y) over ({{P}}) as mx from {{p}}) a group by {{K}}, {b}) b) c group by {{K}}")


def cid_ce(d, normalize=True):
    if not normalize:
        return Agg("sqrt(coalesce(sum(power(y - l1, 2)), 0.0))", L1)
    return Agg(f"case when stddev_pop(y) < {EPS} then 0.0 else sqrt(coalesce(sum(power(y - l1, 2)), 0.0)) / nullif(stddev_pop(y), 0) end", L1)


def c3(d, lag=1):
    return Agg(f"avg(y * f{lag} * f{2 * lag})", _lead(lag) | _lead(2 * lag))


#: A regression's parts, from sums about the means.
def _fit(y: str, x: str) -> dict[str, str]:
    sxx, sxy, syy, n = f"regr_sxx({y}, {x})", f"regr_sxy({y}, {x})", f"regr_syy({y}, {x})", f"regr_count({y}, {x})"
    slope = f"({sxy} / nullif({sxx}, 0))"
    rss = f"greatest({syy} - {sxy} * {sxy} / nullif({sxx}, 0), 0.0)"
    return {"slope": slope, "intercept": f"(regr_avgy({y}, {x}) - {slope} * regr_avgx({y}, {x}))", "rss": rss, "n": n,
            "r2": f"case when {syy} < {EPS} then 1.0 else 1.0 - {rss} / nullif({syy}, 0) end",
            "stderr": f"case when {n} > 2 then sqrt({rss} / nullif({n} - 2, 0) / nullif({sxx}, 0)) end"}


def linear_trend(d, attr="slope"):
    fit = _fit("y", "cast(i as double)")
    if attr == "pvalue":  # two-sided, normal; erf by a published polynomial (fixed values)
        z = f"(abs({fit['slope']}) / nullif({fit['stderr']}, 0) / sqrt(2.0))"
        t = f"(1.0 / (1.0 + 0.3275911 * {z}))"
        erf = f"(1.0 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{z} * {z}))"
        return Agg(f"case when {fit['stderr']} <= {EPS} then 0.0 else 1.0 - {erf} end")
    return Agg(fit[attr])


def agg_linear_trend(d, chunk_len=5, f="mean", attr="slope"):
    agg = {"mean": "avg(y)", "var": "var_pop(y)", "std": "stddev_pop(y)", "min": "min(y)", "max": "max(y)", "median": "median(y)"}.get(f, "avg(y)")
    fit = _fit("a", "c")
    sql = f"sqrt({fit['r2']})" if attr == "rvalue" else fit[attr]
    return Nested(f"select {{K}}, {sql} as v from (select {{K}}, floor(i / {float(chunk_len)}) * 1.0e0 as c, {agg} as a from {{p}} group by {{K}}, floor(i / {float(chunk_len)})) b group by {{K}}")


def augmented_dickey_fuller(d):
    fit = _fit("(y - l1)", "l1")
    return Agg(f"case when {N} >= 4 then {fit['slope']} / nullif({fit['stderr']}, 0) end", L1)


def change_quantiles(d, ql=0.2, qh=0.8, isabs=False, f="mean"):
    inside = "y between ql and qh and l1 between ql and qh"
    x = f"case when {inside} then {'abs(y - l1)' if isabs else 'y - l1'} end"
    agg = {"mean": "avg", "var": "var_samp", "std": "stddev_samp", "median": "median"}.get(f, "avg")
    return Agg(f"{agg}({x})", L1 | {"ql": d.quantile("y", ql, " over ({P})"), "qh": d.quantile("y", qh, " over ({P})")})


def energy_ratio_by_chunks(d, num_segments=10, segment_focus=0):
    c = f"ceil(n / {float(num_segments)})"
    return Agg(_ratio(f"sum(case when i >= {segment_focus} * {c} and i < ({segment_focus} + 1) * {c} then y * y else 0.0 end)", "sum(y * y)"))


def _values(sql: str) -> Callable:
    return lambda d: Nested(f"select {{K}}, {sql} as v from (select {{K}}, round(y, 10) as y, count(*) as c from {{p}} where y is not null group by {{K}}, round(y, 10)) a group by {{K}}")


_SKEW = f"case when {N} < 3 then null when max(sd) < {EPS} then 0.0 else {N} * 1.0 / (({N} - 1.0) * nullif({N} - 2.0, 0)) * sum(power((y - mu) / nullif(sd, 0), 3)) end"
_KURT = (f"case when {N} >= 4 and max(sd) >= {EPS} then {N} * ({N} + 1.0) / (({N} - 1.0) * ({N} - 2.0) * nullif({N} - 3.0, 0)) * sum(power((y - mu) / nullif(sd, 0), 4)) "
         f"- 3.0 * ({N} - 1.0) * ({N} - 1.0) / (({N} - 2.0) * nullif({N} - 3.0, 0)) end")

#: By name, as functions of the dialect and the feature's own parameters.
FEATURES: dict[str, Callable[..., Agg | Nested | Kernel | Neighbours]] = {
    # basic
    "abs_energy": _simple("sum(y * y)"), "absolute_maximum": _simple("max(abs(y))"), "absolute_sum_of_changes": _simple("coalesce(sum(abs(y - l1)), 0.0)", L1),
    "length": _simple("count(*)"), "maximum": _simple("max(y)"), "mean": _simple("avg(y)"), "mean_abs_change": _simple("avg(abs(y - l1))", L1),
    "mean_change": _simple(_ratio("max(case when i = n - 1 then y end) - max(case when i = 0 then y end)", f"{N} - 1")),
    "mean_second_derivative_central": _simple("avg((y - 2 * l1 + l2) / 2)", L1, L2), "mean_n_absolute_max": mean_n_absolute_max, "median": _simple("median(y)"),
    "minimum": _simple("min(y)"), "root_mean_square": _simple("sqrt(avg(y * y))"), "standard_deviation": _simple("stddev_pop(y)"), "sum_values": _simple("sum(y)"),
    "variance": _simple("var_pop(y)"), "variance_sample": _simple("var_samp(y)"),
    # distribution
    "skewness": _simple(_SKEW, MU, SD), "kurtosis": _simple(_KURT, MU, SD), "quantile": quantile, "large_standard_deviation": large_standard_deviation,
    "variance_larger_than_standard_deviation": _simple("var_pop(y) > sqrt(var_pop(y))"),
    "variation_coefficient": _simple(f"case when abs(avg(y)) >= {EPS} then stddev_pop(y) / nullif(avg(y), 0) end"), "symmetry_looking": symmetry_looking, "ratio_beyond_r_sigma": ratio_beyond_r_sigma,
    # autocorrelation
    "autocorrelation": autocorrelation, "partial_autocorrelation": lambda d, lag=1: Kernel(kernels.partial_autocorrelation, (lag,)),
    "agg_autocorrelation": agg_autocorrelation, "time_reversal_asymmetry_statistic": time_reversal_asymmetry_statistic,
    # counting
    "count_above": count_above, "count_below": count_below, "count_above_mean": _simple(_count("y > mu"), MU), "count_below_mean": _simple(_count("y < mu"), MU),
    "number_peaks": number_peaks, "number_crossing_m": number_crossing_m, "longest_strike_above_mean": _strike(">"), "longest_strike_below_mean": _strike("<"),
    "first_location_of_maximum": _simple("min(case when y = mx then i end) * 1.0 / max(n)", MX), "first_location_of_minimum": _simple("min(case when y = mn then i end) * 1.0 / max(n)", MN),
    "last_location_of_maximum": _simple("(max(case when y = mx then i end) + 1.0) / max(n)", MX), "last_location_of_minimum": _simple("(max(case when y = mn then i end) + 1.0) / max(n)", MN),
    "has_duplicate": has_duplicate, "has_duplicate_max": _simple(f"{_count(f'abs(y - mx) < {EPS}')} > 1", MX), "has_duplicate_min": _simple(f"{_count(f'abs(y - mn) < {EPS}')} > 1", MN),
    "index_mass_quantile": index_mass_quantile, "value_count": value_count, "range_count": range_count,
    # entropy
    "sample_entropy": lambda d, m=2, r=0.2, limit=False: Neighbours("sample_entropy_limit" if limit else "sample_entropy", m, r), "approximate_entropy": lambda d, m=2, r=0.2: Neighbours("approximate_entropy", m, r),
    "permutation_entropy": permutation_entropy, "permutation_entropy_normalized": permutation_entropy_normalized, "binned_entropy": binned_entropy,
    "fourier_entropy": lambda d: Kernel(kernels.fourier_entropy),
    # complexity
    "cid_ce": cid_ce, "c3": c3, "lempel_ziv_complexity": lambda d, bins=10: Kernel(kernels.lempel_ziv_complexity, (bins,)),
    "lempel_ziv_complexity_binary": lambda d: Kernel(kernels.lempel_ziv_complexity_binary),
    # trend
    "linear_trend": linear_trend, "agg_linear_trend": agg_linear_trend, "ar_coefficient": lambda d, k=10, coeff=1: Kernel(kernels.ar_coefficient, (k, coeff)),
    "ar_coefficient_yule_walker": lambda d, k=2: Kernel(kernels.ar_coefficient_yule_walker, (k,)), "augmented_dickey_fuller": augmented_dickey_fuller,
    # change
    "change_quantiles": change_quantiles, "energy_ratio_by_chunks": energy_ratio_by_chunks,
    "percentage_of_reoccurring_datapoints_to_all_datapoints": _values("sum(case when c > 1 then c else 0 end) * 1.0 / sum(c)"),
    "percentage_of_reoccurring_values_to_all_values": _values("sum(case when c > 1 then 1 else 0 end) * 1.0 / count(*)"),
    "ratio_value_number_to_time_series_length": _values("count(*) * 1.0 / sum(c)"),
    "sum_of_reoccurring_data_points": _values("sum(case when c > 1 then c * y else 0.0 end)"), "sum_of_reoccurring_values": _values("sum(case when c > 1 then y else 0.0 end)"),
}


Request = str | tuple[str, dict] | tuple[str, str, dict]


def _requests(wanted: Iterable[Request] | None) -> list[tuple[str, str, dict]]:
    """(alias, name, parameters) of each."""
    out = []
    for r in FEATURES if wanted is None else wanted:
        if isinstance(r, str):
            out.append((r, r, {}))
        elif len(r) == 2:
            out.append(("__".join([r[0], *(f"{k}_{v}" for k, v in r[1].items())]).replace(".", "_").replace("-", "m"), *r))
        else:
            out.append(r)
    return out


def doubles(sql: str) -> str:
    """Literals with a point as doubles: both dialects would take them for decimals."""
    return re.sub(r"(?<![\w.])([0-9]+\.[0-9]+)(?![\w.])", r"\1e0", sql)


def _sql(plans: dict[str, Agg | Nested], keys: tuple[str, ...], p: str, digits: int | None) -> str:
    """One query for all but kernels and neighbour joins."""
    k = ", ".join(keys)
    names = {"K": k, "P": f"partition by {k}", "W": f"partition by {k} order by i", "p": p}

    def shown(x: str) -> str:
        return x if digits is None else f"round(cast({x} as double), {digits}) + 0.0e0"

    def typed(name: str, x: str) -> str:
        whole = x.startswith("count(") and not x.rstrip().endswith("> 1")
        flag = name.startswith(("has_duplicate", "large_standard", "variance_larger", "symmetry"))
        return x if whole or flag else shown(x)

    aggs = {a: x for a, x in plans.items() if isinstance(x, Agg)}
    cols = {c: v for x in aggs.values() for c, v in x.cols.items()}
    windows = "".join(f", {v.format(**names)} as {c}" for c, v in cols.items())
    base = f"(select {k}, i, n, y{windows} from {p}) w" if cols else f"{p} w"
    listed = ", ".join(f"{typed(a, x.sql)} as {a}" for a, x in aggs.items())
    sql = f"select {k}{', ' if listed else ''}{listed} from {base} group by {k}"
    nested = {a: x for a, x in plans.items() if isinstance(x, Nested)}
    if nested:
        # features over one inner query (counts of values, of patterns) are aggregated there together
        inner: dict[str, list[tuple[str, str]]] = {}
        for a, x in nested.items():
            value, _, source = x.sql.removeprefix("select {K}, ").partition(" as v from ")
            inner.setdefault(source, []).append((a, value))
        joins = " ".join(f"left join (select {k}, {', '.join(f'{v.format(**names)} as {a}' for a, v in xs)} from {source.format(**names)}) j{j} on " + " and ".join(f"j{j}.{c} = m.{c}" for c in keys)
                         for j, (source, xs) in enumerate(inner.items()))
        place = {a: j for j, xs in enumerate(inner.values()) for a, _ in xs}
        values = ", ".join((f"coalesce(j{place[a]}.{a}, {x.default})" if x.default else shown(f"j{place[a]}.{a}")) + f" as {a}" for a, x in nested.items())
        sql = f"select m.*, {values} from ({sql}) m {joins}"
    return doubles(sql)


def oracle(wanted: Iterable[Request] | None, prepared: str, key: str = "key", digits: int = 6) -> str:
    """DuckDB SQL over ``prepared`` (SQL giving the key, i, n, y)."""
    plans = {a: FEATURES[f](DuckDialect(), **kw) for a, f, kw in _requests(wanted)}
    return f"with p as ({prepared}) " + _sql(plans, (key,), "p", digits)


def features(df: DataFrame, s: Series, wanted: Iterable[Request] | None = None, digits: int | None = None) -> DataFrame:
    """Keys and a column per feature asked for: a name, (name, parameters) or
    (column, name, parameters); all 69 with their defaults if none is named.

    ``digits`` rounds what is not a count or a flag.
    """
    requests = _requests(wanted)
    plans = {a: FEATURES[f](Dialect(), **kw) for a, f, kw in requests}
    p = prepare(df, s)
    view = p.select(*s.keys, "i", "n", "y")
    sql = _sql({a: x for a, x in plans.items() if isinstance(x, Agg | Nested)}, s.keys, "{p}", digits)
    out = df.sparkSession.sql(sql, p=view)
    own = {a: x for a, x in plans.items() if isinstance(x, Kernel)}
    if own:
        schema = T.StructType([*(view.schema[k] for k in s.keys), *(T.StructField(a, T.DoubleType()) for a in own)])

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            y = pdf.sort_values("i")["y"].to_numpy(float)
            values = [kernels.undefined(x.f(y, *x.args)) for x in own.values()]
            if digits is not None:
                values = [None if v is None else round(v, digits) + 0.0 for v in values]
            return pd.DataFrame([[*key, *values]], columns=schema.names)

        more = view.select(*s.keys, "i", "y").groupBy(*s.keys).applyInPandas(run, schema)
        out = out.join(more, list(s.keys))
    joins: dict[tuple[int, float], dict[str, str]] = {}
    for a, x in plans.items():
        if isinstance(x, Neighbours):
            joins.setdefault((x.m, x.r), {})[a] = x.column
    for (m, r), columns in joins.items():
        found = entropy.of_prepared(view, s.keys, m, r)
        out = out.join(found.select(*s.keys, *((F.col(c) if digits is None else F.round(c, digits) + 0.0).alias(a) for a, c in columns.items())), list(s.keys))
    return out.select(*s.keys, *plans)
