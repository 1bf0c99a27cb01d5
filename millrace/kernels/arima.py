"""ARIMA, seasonal ARIMA and their automatic choice, by conditional sums of squares."""

from __future__ import annotations

import itertools
import math

import numpy as np

from .numeric import nelder_mead
from .smoothing import Fit, need


def difference(y: np.ndarray, d: int, lag: int = 1) -> np.ndarray:
    for _ in range(d):
        y = y[lag:] - y[:-lag] if len(y) > lag else y[:0]
    return y


def suggest_d(y: np.ndarray) -> int:
    """0, 1 or 2 by the ratio of (sample) variances after differencing."""
    if len(y) < 4:
        return 0
    v = [difference(y, k).var(ddof=1) if len(y) - k > 1 else math.nan for k in range(3)]
    if v[0] > 0 and v[1] / v[0] < 0.9:
        return 2 if v[1] > 0 and len(y) >= 4 and v[2] / v[1] < 0.9 and v[2] < v[0] else 1
    return 0


def suggest_seasonal_d(y: np.ndarray, s: int) -> int:
    if s < 2 or len(y) < 2 * s:
        return 0
    v = y.var()
    return int(v > 0 and difference(y, 1, s).var() < 0.7 * v)


class _Polynomials:
    """Lags and coefficients of the product of plain and seasonal polynomials."""

    def __init__(self, order: tuple[int, int], seasonal: tuple[int, int], s: int):
        self.p, self.q = order
        self.sp, self.sq = seasonal
        self.s = s
        self.start = max(self.p + self.sp * s, self.q + self.sq * s)
        self.count = 1 + self.p + self.q + self.sp + self.sq

    def split(self, x: list[float]) -> tuple[float, list[tuple[int, float]], list[tuple[int, float]]]:
        c, at = x[0], 1
        ar = list(x[at:at + self.p])
        at += self.p
        ma = list(x[at:at + self.q])
        at += self.q
        sar = list(x[at:at + self.sp])
        sma = list(x[at + self.sp:])

        def product(a: list[float], b: list[float], sign: float) -> list[tuple[int, float]]:
            out = [(i + 1, v) for i, v in enumerate(a)] + [((j + 1) * self.s, w) for j, w in enumerate(b)]
            return out + [(i + 1 + (j + 1) * self.s, sign * v * w) for i, v in enumerate(a) for j, w in enumerate(b)]

        return c, product(ar, sar, -1.0), product(ma, sma, 1.0)

    def residuals(self, w: np.ndarray, x: list[float]) -> np.ndarray:
        """Conditional residuals; zero before ``start``."""
        c, ar, ma = self.split(x)
        n, d = len(w), w - c
        u = d[self.start:].copy()
        for lag, a in ar:
            u -= a * d[self.start - lag:n - lag]
        e = np.zeros(n)
        if not ma:
            e[self.start:] = u
            return e
        back = [0.0] * self.start
        for t, v in enumerate(u.tolist(), self.start):
            for lag, b in ma:
                v -= b * back[t - lag]
            if abs(v) > 1e150:
                raise OverflowError
            back.append(v)
        return np.array(back)


def sarima(y: np.ndarray, h: int, order: tuple[int, int, int] = (1, 1, 1), seasonal: tuple[int, int, int] = (0, 0, 0), period: int = 1, iterations: int | None = None) -> Fit:
    """Fits are one-step forecasts on the scale of y (NaN in the warm-up).

    Autoregressive terms are centred on the mean in both the plain and the
    seasonal case; the plain interval variance grows with the horizon, the
    seasonal one by a tenth a step.
    """
    p, d, q = order
    sp, sd, sq = seasonal
    s = period if any(seasonal) else 1
    need(y, d + sd * s + max(p, q, max(sp, sq) * s) + 2)
    w = difference(difference(y, d), sd, s)
    poly = _Polynomials((p, q), (sp, sq), s)
    values = w.tolist()
    n_eff = len(values) - poly.start
    if n_eff < 1:
        raise ValueError("no values left after differencing")

    def css(x: list[float]) -> float:
        try:
            e = poly.residuals(w, x)
            return float(e @ e)
        except OverflowError:
            return 1e300

    mean = float(w.mean())
    x0 = [mean] + [0.1 / (i + 1) for i in range(p)] + [0.1 / (i + 1) for i in range(q)] + [0.1 / (i + 1) for i in range(sp)] + [0.1 / (i + 1) for i in range(sq)]
    spread = 10 * float(np.abs(w).max()) + 1
    box = [(-spread, spread)] + [(-0.99, 0.99)] * (len(x0) - 1)
    x, sse = nelder_mead(css, x0, box, iterations or (2000 if any(seasonal) else 1000), 1e-8) if len(x0) > 1 else (x0, css(x0))
    try:
        e = poly.residuals(w, x)
    except OverflowError as why:
        raise ValueError("diverges") from why
    c, ar, ma = poly.split(x)
    # forecasts of the differenced series, then of the levels it came from
    ext, err = list(values), list(e)
    for _ in range(h):
        t = len(ext)
        f = c + sum(a * (ext[t - lag] - c) for lag, a in ar if t >= lag) + sum(b * err[t - lag] for lag, b in ma if t >= lag)
        ext.append(f)
        err.append(0.0)
    future = np.array(ext[len(values):])
    levels = [y]
    for _ in range(d):
        levels.append(difference(levels[-1], 1))
    for k in range(sd):
        base = difference(levels[d], k, s)
        joined = list(base) if k == sd - 1 else None
        if joined is not None:
            for v in future:
                joined.append(v + joined[len(joined) - s])
            future = np.array(joined[len(base):])
    for k in range(d - 1, -1, -1):
        future = levels[k][-1] + np.cumsum(future)
    resid = e.copy()
    resid[:poly.start] = np.nan
    fitted = np.full(len(y), np.nan)
    fitted[len(y) - len(resid):] = y[len(y) - len(resid):] - resid
    s2 = sse / n_eff
    k = len(x0)
    ll = -0.5 * n_eff * (math.log(max(s2, 1e-300)) + 1 + math.log(2 * math.pi))
    steps = np.arange(1, h + 1)
    variance = s2 * ((1 + 0.1 * steps) if any(seasonal) else steps)
    return Fit(fitted, future, variance, {"order": order, "seasonal": seasonal, "period": s, "coefficients": x, "aic": -2 * ll + 2 * k, "bic": -2 * ll + k * math.log(n_eff), "sigma2": s2})


def arima(y: np.ndarray, h: int, order: tuple[int, int, int] = (1, 1, 1)) -> Fit:
    return sarima(y, h, order)


#: Steps of the optimiser after which orders are screened, and how far behind the best
#: an order may be then (in units of the criterion) to be fitted fully. On eight
#: series, where all 226 to 339 orders were fitted fully, the best had been 9 to 24 behind.
SEARCH_ITERATIONS = 150
NEAR = 40.0
# The grid's orders (p, q), alone and beside a seasonal part (P, Q).
PLAIN = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2))
BESIDE = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (3, 0), (0, 3), (2, 2), (3, 1), (1, 3))
SEASONAL = ((0, 1), (1, 0), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2))
Order = tuple[tuple[int, int, int], tuple[int, int, int]]


def candidates(y: np.ndarray, period: int = 1, max_p: int = 5, max_q: int = 5, max_d: int = 2, max_sp: int = 2, max_sq: int = 2, max_sd: int = 1, exhaustive: bool = False) -> list[Order]:
    """Orders to try: differences at and beside the suggested ones, with the grid's
    orders or, if exhaustive, all."""
    d0 = min(suggest_d(y), max_d)
    ds = {max(0, min(max_d, d0 + k)) for k in (-1, 0, 1)}
    seasons = period > 1 and len(y) >= 3 * period
    sds = {0, min(max_sd, suggest_seasonal_d(y, period))} if seasons else {0}
    if exhaustive:
        plain = beside = tuple(itertools.product(range(max_p + 1), range(max_q + 1)))
        pairs = tuple(itertools.product(range(max_sp + 1), range(max_sq + 1)))
    else:
        plain, beside, pairs = PLAIN, BESIDE, SEASONAL
    tried = {((p, d, q), (0, sd, 0)) for p, q in plain for d in ds for sd in sds}
    if seasons:
        tried |= {((p, d, q), (a, sd, b)) for p, q in beside for a, b in pairs if a <= max_sp and b <= max_sq for d in ds for sd in sds}
    return sorted(((p, d, q), z) for (p, d, q), z in tried if p <= max_p and q <= max_q)


def auto_arima(y: np.ndarray, h: int, period: int = 1, criterion: str = "aic", search: str = "grid", **limits) -> Fit:
    """The best order by AIC or BIC: ``grid`` tries all candidates, ``exhaustive``
    all orders, ``stepwise`` climbs from three starts by single changes of order.

    Likelihoods of different differences are compared as they are. Orders are
    screened after ``SEARCH_ITERATIONS`` of the optimiser; those within ``NEAR`` of
    the best are fitted fully and compared again.
    """
    need(y, max(10, 3 * period if period > 1 else 10))
    tried: dict[Order, Fit | None] = {}

    def attempt(o: Order) -> float:
        if o not in tried:
            try:
                tried[o] = sarima(y, h, o[0], o[1], period, SEARCH_ITERATIONS)
            except (ValueError, OverflowError, ZeroDivisionError):
                tried[o] = None
        fit = tried[o]
        return fit.info[criterion] if fit is not None and math.isfinite(fit.info[criterion]) else math.inf

    if search != "stepwise":
        for o in candidates(y, period, exhaustive=search == "exhaustive", **limits):
            attempt(o)
    else:
        d = min(suggest_d(y), limits.get("max_d", 2))
        sd = min(suggest_seasonal_d(y, period), limits.get("max_sd", 1)) if period > 1 and len(y) >= 3 * period else 0
        top = (limits.get("max_p", 5), limits.get("max_q", 5), limits.get("max_sp", 2), limits.get("max_sq", 2))
        seasonal = period > 1 and len(y) >= 3 * period
        for p, q in ((0, 0), (1, 1), (2, 2)):
            here: Order = ((p, d, q), (int(seasonal and p > 0), sd, int(seasonal and q > 0)))
            while True:
                (a, d_, b), (c, e, f) = here
                moves = [((a + i, d_, b + j), (c + k, e, f + m)) for i, j, k, m in ((1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 0), (0, -1, 0, 0), (0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 1), (0, 0, 0, -1))
                         if 0 <= a + i <= top[0] and 0 <= b + j <= top[1] and (seasonal or not k and not m) and 0 <= c + k <= top[2] and 0 <= f + m <= top[3]]
                best = min([here, *moves], key=attempt)
                if best == here:
                    break
                here = best
    ok = {o: f for o, f in tried.items() if f is not None and math.isfinite(f.info[criterion])}
    if not ok:
        raise ValueError("no order can be fitted")
    least = min(f.info[criterion] for f in ok.values())
    full: list[Fit] = []
    for o in sorted(o for o, f in ok.items() if f.info[criterion] <= least + NEAR):
        try:
            full.append(sarima(y, h, o[0], o[1], period))
        except (ValueError, OverflowError, ZeroDivisionError):
            continue
    fit = min((f for f in full if math.isfinite(f.info[criterion])), key=lambda f: f.info[criterion], default=None)
    if fit is None:
        raise ValueError("no order can be fitted")
    fit.info |= {"tried": len(tried), "refitted": len(full)}
    return fit
