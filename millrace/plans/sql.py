"""DuckDB SQL that says again, by another way, what the kernels compute.

``p`` is a query that gives the key, time, ``y``, position ``i`` and length ``n``
of each series (:func:`millrace.plans.base.prepared`).
"""

from __future__ import annotations

P = "partition by key"
W = "partition by key order by i"


def rounded(x: str, alias: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0e0 as {alias}"


# --- features -----------------------------------------------------------------


def sample_entropy(p: str, r: float) -> str:
    """Pairs of templates of two and three values, by self-join."""
    return (f"with p as ({p}), w as (select key, i, n, y, lead(y, 1) over ({W}) as f1, lead(y, 2) over ({W}) as f2 from p), m as (select a.key as key, count(*) as b, "
            f"count(case when a.i < a.n - 3 and b.i < b.n - 3 and abs(a.f2 - b.f2) <= {r} then 1 end) as a from w a join w b on a.key = b.key and a.i < b.i and a.i < a.n - 2 and b.i < b.n - 2 and abs(a.y - b.y) <= {r} and abs(a.f1 - b.f1) <= {r} group by a.key) "
            f"select key, {rounded('-ln(a * 1.0 / nullif(b, 0))', 'sample_entropy')} from m")


def approximate_entropy(p: str, r: float) -> str:
    """Templates of two and three values, by self-join."""
    return (f"with p as ({p}), w as (select key, i, n, y, lead(y, 1) over ({W}) as f1, lead(y, 2) over ({W}) as f2 from p), "
            f"a as (select a.key, a.i, max(a.n) as n, count(*) as c from w a join w b on b.key = a.key and abs(a.y - b.y) <= {r} and abs(a.f1 - b.f1) <= {r} where a.i <= a.n - 2 and b.i <= b.n - 2 group by a.key, a.i), "
            f"b as (select a.key, a.i, max(a.n) as n, count(*) as c from w a join w b on b.key = a.key and abs(a.y - b.y) <= {r} and abs(a.f1 - b.f1) <= {r} and abs(a.f2 - b.f2) <= {r} where a.i <= a.n - 3 and b.i <= b.n - 3 group by a.key, a.i) "
            f"select x.key, {rounded('x.v - z.v', 'approximate_entropy')} from (select key, avg(ln(c * 1.0e0 / (n - 1))) as v from a group by key) x join (select key, avg(ln(c * 1.0e0 / (n - 2))) as v from b group by key) z on z.key = x.key")


def spectrum(p: str, first: int = 1, y: str = "y") -> str:
    """Power by frequency ``k``, a sum of cosines and sines over the rows."""
    return (f"select key, n, k, (power(sum({y} * cos(2 * pi() * (k * i % n) / n)), 2) + power(sum({y} * sin(2 * pi() * (k * i % n) / n)), 2)) / n as v "
            f"from ({p}) d, unnest(generate_series({first}, cast(n // 2 as bigint))) g(k) group by key, n, k")


def fourier_entropy(p: str) -> str:
    return (f"with s as (select * from ({spectrum(p, 0)}) a where k < n // 2), t as (select key, v / sum(v) over ({P}) as q from s) "
            f"select key, {rounded('-sum(q * ln(q))', 'fourier_entropy')} from t where q > 1e-10 group by key")


def ar3_first(p: str) -> str:
    """First coefficient of an AR(3) with intercept, by Cramer's rule on covariances."""
    def s(x: str, z: str) -> str:
        return f"covar_pop({x}, {z})"

    a, b, c, d, e, f = (s(*x) for x in (("l1", "l1"), ("l1", "l2"), ("l1", "l3"), ("l2", "l2"), ("l2", "l3"), ("l3", "l3")))
    return (f"with p as ({p}), l as (select key, y, lag(y, 1) over ({W}) as l1, lag(y, 2) over ({W}) as l2, lag(y, 3) over ({W}) as l3 from p), "
            f"m as (select key, {a} as a, {b} as b, {c} as c, {d} as d, {e} as e, {f} as f, {s('l1', 'y')} as u, {s('l2', 'y')} as v, {s('l3', 'y')} as w from l where l3 is not null group by key) "
            f"select key, {rounded('(u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))', 'ar_coefficient')} from m")


def lempel_ziv(p: str) -> str:
    """An incremental parse, its phrases kept in a list."""
    return (f"with recursive p as ({p}), s as (select key, i, n, cast(least(floor((y - min(y) over ({P})) / ((max(y) over ({P}) - min(y) over ({P})) / 10.0e0)), 9) as integer)::varchar as c from p), "
            "z as (select key, 0::bigint as i, max(n) as n, '' as phrase, []::varchar[] as seen from s group by key union all select z.key, z.i + 1, z.n, case when list_contains(z.seen, z.phrase || s.c) then z.phrase || s.c else '' end, "
            "case when list_contains(z.seen, z.phrase || s.c) then z.seen else list_append(z.seen, z.phrase || s.c) end from z join s on s.key = z.key and s.i = z.i) "
            f"select key, {rounded('len(seen) * 1.0e0 / n', 'lempel_ziv_complexity')} from z where i = n")


def lempel_ziv_binary(p: str) -> str:
    """Components of a string of bits, each the shortest that what precedes it lacks."""
    return (f"with recursive p as ({p}), b as (select key, i, n, case when y >= median(y) over ({P}) then '1' else '0' end as c from p), s as (select key, max(n) as n, string_agg(c, '' order by i) as s from b group by key), "
            "z as (select key, n, s, 3::bigint as pos, 2::bigint as c, 1::bigint as size from s union all select key, n, s, pos + size, c + 1, size from (select key, n, s, pos, c, list_filter(range(1, n - pos + 1), lambda x: not contains(s[1:pos], s[pos + 1:pos + x]))[1] as size from z where pos < n) q where size is not null) "
            f"select key, {rounded('max(c) * log2(max(n)) / max(n)', 'lempel_ziv_complexity_binary')} from z group by key")


# --- spectra and periods ----------------------------------------------------------


def welch(p: str, window: int, hop: int | None = None) -> str:
    hop = hop or window // 2
    return (f"with p as ({p}), g as (select key, n, unnest(generate_series(0, cast(n as bigint) - {window}, {hop})) as pos from (select distinct key, n from p) a), "
            f"t as (select g.key, pos, p.i - pos as i, {window} as n, y * 0.5e0 * (1 - cos(2 * pi() * (p.i - pos) / {window})) as y from g join p on p.key = g.key and p.i >= pos and p.i < pos + {window}), "
            f"s as (select key, pos, k, (power(sum(y * cos(2 * pi() * k * i / {window})), 2) + power(sum(y * sin(2 * pi() * k * i / {window})), 2)) / {window} as v from t, unnest(generate_series(1, {window // 2})) f(k) group by key, pos, k), "
            f"m as (select key, {window} // k as period, avg(v) as power from s group by key, {window} // k) "
            f"select key, cast(row_number() over (partition by key order by period desc) as integer) as rank, cast(period as integer) as period, {rounded('power', 'power')} from m")


def _peaks(p: str, threshold: float, y: str = "y", high: int = 365) -> str:
    """Periods whose power is over ``threshold`` times the median power."""
    return (f"select key, cast(n // k as integer) as period, v, k from (select *, median(v) over ({P}) as middle from ({spectrum(p, 1, y)}) a where n // k >= 2 and n // k <= {high}) b where v > {threshold} * middle")


def spectral_peaks(p: str, threshold: float) -> str:
    return (f"select key, cast(row_number() over (partition by key order by v desc, period) as integer) as rank, period, {rounded('v', 'power', 4)} from ({_peaks(p, threshold)}) c")


def acf(p: str, top: str = "least(365, n // 2)") -> str:
    """Biased autocorrelations of lags 0 to ``top``."""
    return (f"select a.key, max(a.n) as n, lag, sum(a.d * b.d) / max(a.c0) as r from (select *, y - avg(y) over ({P}) as d, sum(power(y - mu, 2)) over ({P}) as c0 from (select *, avg(y) over ({P}) as mu from ({p}) q) q) a "
            f"join (select key, i, y - avg(y) over ({P}) as d from ({p}) q) b on b.key = a.key and b.i <= a.i, lateral (select a.i - b.i as lag) l where lag <= {top.replace('n //', 'a.n //')} group by a.key, lag")


def _hills(p: str, low: int, threshold: float) -> str:
    """Autocorrelation peaks inside ``low`` .. top, both neighbours known."""
    return f"select key, lag, r from (select *, lag(r) over (partition by key order by lag) as a, lead(r) over (partition by key order by lag) as b from ({acf(p)}) c) d where r > a and r > b and r > {threshold} and lag >= {low}"


def period_seasonality(p: str) -> str:
    return f"select key, cast(row_number() over (partition by key order by r desc, lag) as integer) as rank, cast(lag as integer) as period, {rounded('least(1.0, r)', 'score')} from ({_hills(p, 3, 0.3)}) h"


def period_acf(p: str) -> str:
    """Peaks, strongest first, without those near a multiple of one kept before."""
    return (f"with recursive h as materialized (select *, row_number() over (partition by key order by r desc, lag) as k from ({_hills(p, 2, 0.3)}) h), "
            "z as (select key, 0::bigint as k, []::bigint[] as kept from (select distinct key from h) a union all "
            "select z.key, h.k, case when len(list_filter(z.kept, lambda q: abs(h.lag * 1.0e0 / q - round(h.lag * 1.0e0 / q)) < 0.1 and round(h.lag * 1.0e0 / q) > 1)) > 0 then z.kept else list_append(z.kept, h.lag) end from z join h on h.key = z.key and h.k = z.k + 1), "
            "e as (select key, kept from (select *, row_number() over (partition by key order by k desc) as o from z) a where o = 1), u as (select key, unnest(kept) as lag, unnest(range(1, len(kept) + 1)) as rank from e) "
            f"select u.key, cast(u.rank as integer) as rank, cast(u.lag as integer) as period, {rounded('least(1.0, h.r)', 'score')} from u join h on h.key = u.key and h.lag = u.lag")


def period_fft(p: str) -> str:
    return f"select key, cast(row_number() over (partition by key order by v desc, period) as integer) as rank, period, {rounded(f'v / max(v) over ({P})', 'score')} from ({_peaks(p, 3.0)}) c"


def period_cfd(p: str) -> str:
    """Peaks of the differences, clusters of those at most 2 apart, their centres by autocorrelation."""
    d = f"select key, i - 1 as i, n - 1 as n, y - l as y from (select *, lag(y) over ({W}) as l from ({p}) a) b where i > 0"
    return (f"with h as (select key, period, k from ({_peaks(d, 2.0)}) a), g as (select *, case when period - lag(period) over (partition by key order by period, k) <= 2 then 0 else 1 end as new from h), "
            f"c as (select key, sum(new) over (partition by key order by period, k rows unbounded preceding) as c, period from g), m as (select key, c, cast(sum(period) // count(*) as bigint) as period from c group by key, c), r as ({acf(p, 'n // 2')}) "
            f"select m.key, cast(row_number() over (partition by m.key order by r desc, period) as integer) as rank, cast(period as integer) as period, {rounded('least(1.0, r)', 'score')} from m join r on r.key = m.key and r.lag = m.period where r > 0.2 and period < n // 2")


# --- changepoints -------------------------------------------------------------------

_PLAIN = {  # costs that are aggregates over a segment's rows
    "l2": "count(*) * var_pop(y)", "l1": "sum(abs(y - med))",
    "normal": "case when count(*) < 2 or var_pop(y) < 1e-10 then 0.0 else count(*) * ln(greatest(var_pop(y), 1e-10)) end",
    "mean_variance": "case when count(*) < 2 or var_pop(y) < 1e-10 then 0.0 else count(*) * (1 + ln(greatest(var_pop(y), 1e-10))) end",
    "poisson": "case when avg(y) < 1e-10 then 0.0 else sum(y) - sum(y) * ln(greatest(avg(y), 1e-10)) end",
    "linear_trend": "case when count(*) < 3 then 0.0 else greatest(0.0, regr_syy(y, i) - power(regr_sxy(y, i), 2) / nullif(regr_sxx(y, i), 0)) end",
    "cusum": "max(abs(run))",
}


def segment_costs(p: str, cost: str) -> str:
    """The cost of every segment [s, t)."""
    rows = f"select a.key, s, t, b.i, b.y from (select distinct key, n from p) a, unnest(generate_series(0, cast(n as bigint) - 1)) x(s), unnest(generate_series(s + 1, cast(n as bigint))) z(t) join p b on b.key = a.key and b.i >= s and b.i < t"
    if cost == "l1":
        rows = f"select *, median(y) over (partition by key, s, t) as med from ({rows}) w"
    if cost == "cusum":
        rows = f"select *, sum(y - mu) over (partition by key, s, t order by i) as run from (select *, avg(y) over (partition by key, s, t) as mu from ({rows}) w) w"
    return f"select key, s, t, {_PLAIN[cost]} as c from ({rows}) w group by key, s, t"


def pelt(p: str, cost: str, min_size: int = 2, penalty: str = "ln(max(n))") -> str:
    """Partitioning by lists that grow by one value a step: the best cost up to each
    point, where its last segment starts, and whether it is still open (a start whose
    cost without penalty exceeds the best is closed). The penalty is ln n by default."""
    upto = f"greatest(0, l.t - {min_size} + 1)"
    return (f"with recursive p as materialized ({p}), c as materialized ({segment_costs(p, cost)}), l as materialized (select key, t, list(c order by s) as cs from c group by key, t), k as (select key, max(n) as n, {penalty}::double as pen from p group by key), "
            "z as (select key, n, pen, 0::bigint as t, [-pen]::double[] as best, [0]::bigint[] as last, [true] as alive from k union all "
            "select key, n, pen, t, list_append(best, low + pen), list_append(last, coalesce(list_position(v, low), 1) - 1), list_append(list_transform(alive, lambda o, x: o and not coalesce(v[x] > low + pen, false)), true) "
            f"from (select *, coalesce(list_min(v), 'infinity'::double) as low from (select z.key, z.n, z.pen, l.t, z.best, z.last, z.alive, list_transform(range(1, {upto} + 1), lambda x: case when z.alive[x] then z.best[x] + l.cs[x] else 'infinity'::double end) as v from z join l on l.key = z.key and l.t = z.t + 1) q) q2), "
            "f as (select * from z where t = n), b as (select key, n, last, n as e, last[n + 1] as s from f union all select key, n, last, s, last[s + 1] from b where s > 0), "
            "g as (select b.key, b.s, e, c.c from b join c on c.key = b.key and c.s = b.s and c.t = b.e), o as (select *, row_number() over (partition by key order by s) - 1 as segment, sum(c) over (partition by key) as cost from g) "
            f"select o.key, cast(segment as integer) as segment, cast(s as integer) as start, cast(e as integer) as \"end\", epoch(max(case when p.i = s then ds end))::bigint as start_ds, {rounded('avg(p.y)', 'mean', 3)}, {rounded('max(cost)', 'cost', 3)} from o join p on p.key = o.key and p.i >= s and p.i < e group by o.key, segment, s, e")


# --- decomposition --------------------------------------------------------------------


class _Steps:
    """Named tables (key, i, v), each made from those before it."""

    def __init__(self, p: str):
        self.parts = [f"p as materialized ({p})"]
        self.n = 0

    def add(self, sql: str) -> str:
        self.n += 1
        self.parts.append(f"t{self.n} as materialized ({sql})")
        return f"t{self.n}"

    def smooth(self, t: str, span: int, weights: str | None, stride: int = 1) -> str:
        """Tricube-weighted mean over ``span`` neighbours ``stride`` apart."""
        half = span // 2
        k = f"power(1 - power(abs(b.i - a.i) / {stride} / {half + 1}.0e0, 3), 3)" + (" * w.v" if weights else "")
        phase = f" and (b.i - a.i) % {stride} = 0" if stride > 1 else ""
        extra = f" join {weights} w on w.key = b.key and w.i = b.i" if weights else ""
        return self.add(f"select a.key, a.i, case when sum({k}) > 1e-10 then sum({k} * b.v) / greatest(sum({k}), 1e-10) else max(case when b.i = a.i then b.v end) end as v from {t} a join {t} b on b.key = a.key and abs(b.i - a.i) <= {half * stride}{phase}{extra} group by a.key, a.i")

    def average(self, t: str, window: int) -> str:
        return self.add(f"select key, i, avg(v) over ({W} rows between {window // 2} preceding and {window - window // 2 - 1} following) as v from {t}")

    def minus(self, a: str, b: str) -> str:
        return self.add(f"select a.key, a.i, a.v - b.v as v from {a} a join {b} b on b.key = a.key and b.i = a.i")


def _odd(x: float) -> int:
    import math

    n = math.ceil(x - 1e-9)
    return n if n % 2 else n + 1


def _stl(q: _Steps, y: str, period: int, robust: bool, inner: int = 2) -> tuple[str, str]:
    """Trend and season of the table ``y``."""
    ns = period | 1
    nt, nl = _odd(1.5 * period / (1 - 1.5 / ns)), _odd(period)
    rounds = 6 if robust else 0
    trend = season = weights = None
    for k in range(rounds + 1):
        for _ in range(inner):
            rest = q.minus(y, trend) if trend else y
            cycle = q.smooth(rest, ns, weights, period)
            low = q.smooth(q.average(q.average(q.average(cycle, period), period), 3), nl, None)
            season = q.minus(cycle, low)
            trend = q.smooth(q.minus(y, season), nt, weights)
        if k < rounds:
            left = q.minus(q.minus(y, trend), season)
            weights = q.add(f"select key, i, case when h <= 1e-10 then 1.0 when abs(v) < h then power(1 - power(v / h, 2), 2) else 0.0 end as v from (select *, 6 * median(abs(v)) over ({P}) as h from {left}) a")
    return trend, season


def stl(p: str, period: int, robust: bool, columns: str) -> str:
    """``columns`` may use y, trend, seasonal and remainder."""
    q = _Steps(p)
    y = q.add("select key, i, y as v from p")
    trend, season = _stl(q, y, period, robust)
    q.parts.append(f"parts as (select p.key, p.ds, p.y, a.v as trend, b.v as seasonal, p.y - a.v - b.v as remainder from p join {trend} a on a.key = p.key and a.i = p.i join {season} b on b.key = p.key and b.i = p.i where p.n >= {2 * period})")
    return f"with {', '.join(q.parts)} {columns}"


def mstl(p: str, periods: tuple[int, ...], columns: str, iterations: int = 2) -> str:
    q = _Steps(p)
    y = q.add("select key, i, y as v from p")
    seasons: dict[int, str] = {}
    trend = None
    for _ in range(iterations):
        for m in periods:
            rest = y
            for other, s in seasons.items():
                if other != m:
                    rest = q.minus(rest, s)
            t, seasons[m] = _stl(q, rest, m, False)
            trend = t if m == periods[-1] else trend
    joins = " ".join(f"join {s} s{m} on s{m}.key = p.key and s{m}.i = p.i" for m, s in seasons.items())
    total = " - ".join(f"s{m}.v" for m in seasons)
    q.parts.append(f"parts as (select p.key, p.ds, p.y, a.v as trend, {', '.join(f's{m}.v as seasonal_{m}' for m in seasons)}, p.y - a.v - {total} as remainder from p join {trend} a on a.key = p.key and a.i = p.i {joins} where p.n >= {2 * periods[-1]})")
    return f"with {', '.join(q.parts)} {columns}"


def strengths(period: int, p: str) -> str:
    def s(c: str) -> str:
        return f"case when var_samp({c} + remainder) > 1e-10 then least(1.0, greatest(0.0, 1 - var_samp(remainder) / nullif(var_samp({c} + remainder), 0))) else 0.0 end"

    return stl(p, period, False, f"select key, {rounded(s('seasonal'), 'seasonal_strength')}, {rounded(s('trend'), 'trend_strength')} from parts group by key")


# --- smoothing with given parameters -------------------------------------------------------

Z = 1.9603949169253396


def given_holt(p: str, h: int, a: float, b: float, phi: float) -> str:
    """Level and trend row by row."""
    return (f"with recursive p as ({p}), z as (select key, 0::bigint as i, max(n) as n, max(case when i = 0 then y end) as l, max(case when i = 1 then y end) - max(case when i = 0 then y end) as b, 0.0e0 as e from p group by key union all "
            f"select z.key, z.i + 1, z.n, {a}e0 * p.y + {1 - a}e0 * (z.l + {phi}e0 * z.b), {b}e0 * ({a}e0 * p.y + {1 - a}e0 * (z.l + {phi}e0 * z.b) - z.l) + {1 - b}e0 * {phi}e0 * z.b, p.y - z.l - {phi}e0 * z.b from z join p on p.key = z.key and p.i = z.i + 1), "
            f"v as (select key, avg(e * e) as s2 from z group by key), g as (select cast(h as integer) as h, (select sum(power({phi}e0, x)) from range(1, h + 1) r(x)) as d, 1 + coalesce((select sum(power({a}e0 + {a * b!r}e0 * (select sum(power({phi}e0, u)) from range(1, x + 1) q(u)), 2)) from range(1, h) r(x)), 0) as k from range(1, {h + 1}) s(h)) "
            f"select z.key, h, {rounded('l + b * d', 'yhat')}, {rounded(f'l + b * d - {Z!r} * sqrt(s2 * k)', 'lo')}, {rounded(f'l + b * d + {Z!r} * sqrt(s2 * k)', 'hi')} from z join v on v.key = z.key, g where z.i = z.n - 1")


def given_ses(p: str, h: int, a: float) -> str:
    b2 = (1 - a) ** 2
    grow = f"(1 + {b2!r}e0 * (1 - power({b2!r}e0, h - 1)) / {1 - b2!r}e0)"
    return (f"with recursive p as ({p}), z as (select key, 0::bigint as i, n, y as l, 0.0e0 as e from p where i = 0 union all select z.key, z.i + 1, z.n, {a}e0 * p.y + {1 - a}e0 * z.l, p.y - z.l from z join p on p.key = z.key and p.i = z.i + 1), "
            f"v as (select key, avg(e * e) as s2 from z group by key) select z.key, cast(h as integer) as h, {rounded('l', 'yhat')}, {rounded(f'l - {Z!r} * sqrt(s2 * {grow})', 'lo')}, {rounded(f'l + {Z!r} * sqrt(s2 * {grow})', 'hi')} from z join v on v.key = z.key, range(1, {h + 1}) s(h) where z.i = z.n - 1")


def given_holt_winters(p: str, h: int, m: int, a: float, b: float, g: float, multiplicative: bool) -> str:
    """Level, trend and the last ``m`` seasons, as a list of which one value changes a row."""
    start = f"list_transform(s, lambda x: x / list_avg(s))" if multiplicative else "list_transform(s, lambda x: x - list_avg(s))"
    raw = "y / l" if multiplicative else "y - l"
    old = f"z.s[p.i % {m} + 1]"
    fit = f"(z.l + z.b) * {old}" if multiplicative else f"z.l + z.b + {old}"
    level = f"{a}e0 * " + (f"(case when abs({old}) > 1e-10 then p.y / {old} else p.y end)" if multiplicative else f"(p.y - {old})") + f" + {1 - a}e0 * (z.l + z.b)"
    new = f"{g}e0 * " + ("(case when abs(nl) > 1e-10 then y / nl else 1.0 end)" if multiplicative else "(y - nl)") + f" + {1 - g}e0 * os"
    at = f"s[(n + h - 1) % {m} + 1]"
    point = f"(l + b * h) * {at}" if multiplicative else f"l + b * h + {at}"
    half = f"{Z!r} * sqrt(s2 * ((h - 1) // {m} + 1))"
    return (f"with recursive p as ({p}), f as (select key, max(n) as n, avg(case when i < {m} then y end) as l, sum(case when i >= {m} and i < {2 * m} then y when i < {m} then -y end) / {m * m}.0e0 as b from p group by key), "
            f"q as (select p.key, list({raw} order by p.i) as s from p join f on f.key = p.key where p.i < {m} group by p.key), "
            f"z as (select f.key, {m - 1}::bigint as i, f.n, f.l, f.b, {start} as s, null::double as e from f join q on q.key = f.key union all "
            f"select key, i, n, nl, {b}e0 * (nl - l) + {1 - b}e0 * b, list_transform(s, lambda x, k: case when k = i % {m} + 1 then {new} else x end), y - fit from "
            f"(select z.key, p.i, z.n, z.l, z.b, z.s, p.y, {old} as os, {fit} as fit, {level} as nl from z join p on p.key = z.key and p.i = z.i + 1) c), v as (select key, avg(e * e) as s2 from z group by key) "
            f"select z.key, cast(h as integer) as h, {rounded(point, 'yhat')}, {rounded(f'{point} - {half}', 'lo')}, {rounded(f'{point} + {half}', 'hi')} from z join v on v.key = z.key, range(1, {h + 1}) t(h) where z.i = z.n - 1")


def seasonal_es(p: str, h: int, m: int, a: float) -> str:
    """Each phase smoothed on its own, counted from the end."""
    half = f"{Z!r} * sqrt(s2 * sqrt(1 + 0.1e0 * (h - 1)))"
    return (f"with recursive p as ({p}), t as (select key, n, (i - n % {m}) % {m} as ph, (i - n % {m}) // {m} as c, n // {m} as cs, y from p where i >= n % {m}), z as (select key, ph, 0::bigint as c, cs, y as l, null::double as e from t where c = 0 union all "
            f"select z.key, z.ph, z.c + 1, z.cs, {a}e0 * t.y + {1 - a}e0 * z.l, t.y - z.l from z join t on t.key = z.key and t.ph = z.ph and t.c = z.c + 1), v as (select key, avg(e * e) as s2 from z group by key) "
            f"select z.key, 'seasonal_es' as model, cast(h as integer) as h, {rounded('l', 'yhat')}, {rounded(f'l - {half}', 'lo')}, {rounded(f'l + {half}', 'hi')}, 'ok' as status from z join v on v.key = z.key, range(1, {h + 1}) s(h) where z.c = z.cs - 1 and (h - 1) % {m} = z.ph")


def croston_path(p: str, h: int, name: str, a: float = 0.1) -> str:
    """Size and interval of demands period by period; the variance is that of the errors after the first demand."""
    factor = 1 - a / 2 if name == "croston_sba" else 1.0
    rate = f"{factor}e0 * size / greatest(gap, 0.001e0)"
    half = f"{Z!r} * sqrt(s2)"
    return (f"with recursive p as materialized ({p}), z as (select key, -1::bigint as i, max(n) as n, null::double as size, null::double as gap, -1::bigint as last, null::double as e, 0::bigint as c from p group by key union all "
            f"select z.key, p.i, z.n, case when p.y > 0 then coalesce({a}e0 * p.y + {1 - a}e0 * size, p.y) else size end, case when p.y > 0 then coalesce({a}e0 * (p.i - last) + {1 - a}e0 * gap, (p.i - last) * 1.0e0) else gap end, "
            f"case when p.y > 0 then p.i else last end, p.y - {rate}, z.c + case when p.y > 0 then 1 else 0 end from z join p on p.key = z.key and p.i = z.i + 1), v as (select key, coalesce(var_samp(e), 0.0) as s2 from z group by key) "
            f"select z.key, '{name}' as model, case when c >= 2 then cast(h as integer) end as h, {rounded(f'case when c >= 2 then {rate} end', 'yhat')}, {rounded(f'case when c >= 2 then {rate} - {half} end', 'lo')}, {rounded(f'case when c >= 2 then {rate} + {half} end', 'hi')}, "
            f"case when c >= 2 then 'ok' else 'insufficient_data' end as status from z join v on v.key = z.key, range(1, {h + 1}) s(h) where z.i = z.n - 1 and (c >= 2 or h = 1)")


def tsb_path(p: str, h: int, a: float = 0.1, b: float = 0.1) -> str:
    half = f"{Z!r} * sqrt(s2)"
    return (f"with recursive p as materialized ({p}), f as (select key, max(n) as n, arg_min(y, i) filter (y > 0) as size, max(case when i = 0 and y > 0 then 1.0e0 else 0.0e0 end) as pr from p group by key), "
            "z as (select key, -1::bigint as i, n, coalesce(size, 0.0e0) as size, pr, null::double as e from f union all "
            f"select z.key, p.i, z.n, case when p.y > 0 then {a}e0 * p.y + {1 - a}e0 * size else size end, {b}e0 * case when p.y > 0 then 1 else 0 end + {1 - b}e0 * pr, p.y - size * pr from z join p on p.key = z.key and p.i = z.i + 1), v as (select key, var_samp(e) as s2 from z group by key) "
            f"select z.key, 'tsb' as model, cast(h as integer) as h, {rounded('size * pr', 'yhat')}, {rounded(f'size * pr - {half}', 'lo')}, {rounded(f'size * pr + {half}', 'hi')}, 'ok' as status from z join v on v.key = z.key, range(1, {h + 1}) s(h) where z.i = z.n - 1")


def _intermittent(p: str, h: int, name: str, levels: str) -> str:
    """Block sums from the end, smoothed with the best of 101 constants; ``levels`` are the block sizes of a key."""
    half = f"{Z!r} * sqrt(s2)"
    return (f"with recursive p as materialized ({p}), m as (select p.key, max(p.n) as n, var_samp(y) as s2, greatest(1, cast(floor(coalesce(max(g.gap), 1) + 0.5) as bigint)) as top from p left join (select key, avg(gap) as gap from (select key, i - lag(i) over ({W}) as gap from p where y <> 0) a group by key) g on g.key = p.key group by p.key), "
            f"k as (select key, n, unnest({levels}) as k from m), b as materialized (select p.key, k, (i - p.n % k) // k as b, sum(y) as v, max(p.n) // k as bs from p join k on k.key = p.key where i >= p.n % k group by p.key, k, (i - p.n % k) // k), "
            "z as (select key, k, bs, j, 0.1e0 + 0.002e0 * j as a, 0::bigint as b, v as l, 0.0e0 as sse from b, range(0, 101) g(j) where b = 0 union all "
            "select z.key, z.k, z.bs, z.j, z.a, z.b + 1, z.a * b.v + (1 - z.a) * z.l, z.sse + power(b.v - z.l, 2) from z join b on b.key = z.key and b.k = z.k and b.b = z.b + 1), "
            "e as (select key, k, arg_min(l, sse) as l from (select * from z where b = bs - 1 order by key, k, sse, j) q group by key, k), f as (select key, avg(l / k) as point from e group by key) "
            f"select f.key, '{name}' as model, cast(h as integer) as h, {rounded('point', 'yhat')}, {rounded(f'point - {half}', 'lo')}, {rounded(f'point + {half}', 'hi')}, 'ok' as status from f join m on m.key = f.key, range(1, {h + 1}) s(h)")


def adida(p: str, h: int) -> str:
    return _intermittent(p, h, "adida", "[top]")


def imapa(p: str, h: int) -> str:
    return _intermittent(p, h, "imapa", "range(1, least(top, n) + 1)")


def _deseasoned(p: str, m: int, quantile: float) -> str:
    """Tables p, f (factor by phase, 1 where the series is not seasonal) and a (the
    series without season), for positive series and an even period."""
    half = m // 2
    return (f"p as materialized ({p}), c as ({acf('select * from p', str(m))}), q as (select key, abs(max(case when lag = {m} then r end)) / sqrt((1 + 2 * sum(case when lag between 1 and {m - 1} then r * r else 0 end)) / max(n)) > {quantile!r} and max(n) >= {2 * m} as seasonal from c group by key), "
            f"w as (select key, i, n, y, case when i >= {half} and i < n - {half} then (sum(y) over ({W} rows between {half} preceding and {half} following) - 0.5 * lag(y, {half}) over ({W}) - 0.5 * lead(y, {half}) over ({W})) / {m} end as trend from p), "
            f"h as (select key, i % {m} as ph, avg(y / trend) as f from w group by key, i % {m}), f as materialized (select h.key, ph, case when seasonal then f / avg(f) over (partition by h.key) else 1.0 end as f from h join q on q.key = h.key), "
            f"a as materialized (select p.key, i, n, y, y / f as x, f from p join f on f.key = p.key and f.ph = p.i % {m})")


def theta(p: str, h: int, m: int, quantile: float, a: float = 0.1, th: float = 2.0) -> str:
    b2 = (1 - a) ** 2
    grow = f"sqrt(s2 * (1 + {b2!r}e0 * (1 - power({b2!r}e0, h - 1)) / {1 - b2!r}e0)) * {Z!r}"
    point = f"(l + {1 - 1 / th}e0 * b * ({1 / a}e0 + h - 1)) * f.f"
    return (f"with recursive {_deseasoned(p, m, quantile)}, z as (select key, 0::bigint as i, n, x as l, 0.0e0 as e from a where i = 0 union all select z.key, z.i + 1, z.n, {a}e0 * a.x + {1 - a}e0 * z.l, a.y - z.l * a.f from z join a on a.key = z.key and a.i = z.i + 1), "
            "v as (select key, avg(e * e) as s2 from z group by key), s as (select key, regr_slope(x, i) as b from a group by key) "
            f"select z.key, 'theta' as model, cast(h as integer) as h, {rounded(point, 'yhat')}, {rounded(f'{point} - {grow}', 'lo')}, {rounded(f'{point} + {grow}', 'hi')}, 'ok' as status "
            f"from z join v on v.key = z.key join s on s.key = z.key, range(1, {h + 1}) t(h), f where z.i = z.n - 1 and f.key = z.key and f.ph = (z.n + h - 1) % {m}")


def dynamic_theta(p: str, h: int, m: int, quantile: float, a: float = 0.1, th: float = 2.0) -> str:
    """The line's two numbers are carried along, first over the rows, then over the forecasts."""
    b2, share = (1 - a) ** 2, 1 - 1 / th
    grow = f"sqrt(s2 * (1 + {b2!r}e0 * (1 - power({b2!r}e0, d.h - 1)) / {1 - b2!r}e0)) * {Z!r}"
    return (f"with recursive {_deseasoned(p, m, quantile)}, s as (select key, regr_slope(x, i) as b from a where i < 10 group by key), "
            "z as (select a.key, 0::bigint as i, n, x as l, x as mean, b as bn, x - b / 2 as an, 0.0e0 as e from a join s on s.key = a.key where i = 0 union all "
            f"select key, i + 1, n, {a}e0 * x + {1 - a}e0 * l, ((i + 1) * mean + x) / (i + 2), nb, ((i + 1) * mean + x) / (i + 2) - nb * (i + 3) / 2, y - f * g from "
            f"(select z.*, a.x, a.y, a.f, z.l + {share}e0 * (z.an * power({1 - a}e0, z.i + 1) + z.bn * (1 - power({1 - a}e0, z.i + 2)) / {a}e0) as g, (z.i * z.bn + 6 * (a.x - z.mean) / (z.i + 2)) / (z.i + 3) as nb from z join a on a.key = z.key and a.i = z.i + 1) c), "
            "v as (select key, avg(e * e) as s2 from z group by key), "
            f"d as (select key, n, 0::bigint as h, l, mean, bn, an, null::double as g from z where i = n - 1 union all select key, n, h + 1, {a}e0 * g2 + {1 - a}e0 * l, ((n + h) * mean + g2) / (n + h + 1), nb, ((n + h) * mean + g2) / (n + h + 1) - nb * (n + h + 2) / 2, g2 from "
            f"(select *, ((n + h - 1) * bn + 6 * (g2 - mean) / (n + h + 1)) / (n + h + 2) as nb from (select key, n, h, l, mean, bn, an, l + {share}e0 * (an * power({1 - a}e0, n + h) + bn * (1 - power({1 - a}e0, n + h + 1)) / {a}e0) as g2 from d where h < {h}) c) c2) "
            f"select d.key, 'dynamic_theta' as model, cast(d.h as integer) as h, {rounded('g * f.f', 'yhat')}, {rounded(f'g * f.f - {grow}', 'lo')}, {rounded(f'g * f.f + {grow}', 'hi')}, 'ok' as status from d join v on v.key = d.key join f on f.key = d.key and f.ph = (d.n + d.h - 1) % {m} where d.h > 0")


def fitted_ses(p: str, h: int, points: int, rounds: int, z: float) -> str:
    """Simple smoothing whose rate is found on narrowing grids; ``p`` has key, i and y."""
    path = "list_reduce(list_transform(ys, lambda v: {'y': v, 'l': v, 's': 0.0e0}), lambda m, v: {'y': v.y, 'l': m.l + a * (v.y - m.l), 's': m.s + (v.y - m.l) * (v.y - m.l)})"
    out = f"with r0 as (select key, list(y order by i) as ys, 1.0e-4 as lo, 0.9999e0 as hi from ({p}) p where y is not null group by key)"
    for k in range(rounds):
        out += (f", t{k} as (select key, ys, lo, hi, lo + (hi - lo) * cast(j as double) / {points - 1} as a from r{k} cross join (select unnest(range({points})) as j) g), f{k} as (select *, {path} as f from t{k}), "
                f"b{k} as (select *, row_number() over (partition by key order by f.s, a) as pick from f{k}), "
                f"r{k + 1} as (select key, ys, greatest(1.0e-4, a - (hi - lo) / {points - 1}) as lo, least(0.9999e0, a + (hi - lo) / {points - 1}) as hi, a, f from b{k} where pick = 1)")
    half = f"{z!r} * sqrt(f.s / len(ys) * (1 + power(1 - a, 2) * (1 - power(power(1 - a, 2), h - 1)) / (1 - power(1 - a, 2))))"
    return (f"{out} select key, h, {rounded('f.l', 'yhat')}, {rounded(f'f.l - {half}', 'lo')}, {rounded(f'f.l + {half}', 'hi')}, {rounded('a', 'alpha')}, cast(len(ys) as bigint) as n "
            f"from r{rounds} cross join (select cast(unnest(range(1, {h + 1})) as integer) as h) g")
