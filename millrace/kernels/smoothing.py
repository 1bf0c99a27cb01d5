"""Baselines, exponential smoothing and intermittent demand."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .numeric import line, nelder_mead


class TooShort(ValueError):
    """The series is shorter than the model needs."""

    def __init__(self, needed: int, got: int):
        super().__init__(f"needs {needed} values, has {got}")


@dataclass
class Fit:
    """What every model returns: one-step fits on the scale of y (NaN where there
    is none), forecasts, and the variance of each step's interval."""

    fitted: np.ndarray
    point: np.ndarray
    variance: np.ndarray
    info: dict = field(default_factory=dict)
    lower: np.ndarray | None = None
    upper: np.ndarray | None = None


def need(y: np.ndarray, n: int) -> None:
    if len(y) < n:
        raise TooShort(n, len(y))


def sigma2(y: np.ndarray, fitted: np.ndarray, skip: int = 0) -> float:
    """Mean squared residual where there is a fit."""
    r = (y - fitted)[skip:]
    r = r[np.isfinite(r)]
    return float(r @ r / len(r)) if len(r) else 0.0


def _steps(h: int) -> np.ndarray:
    return np.arange(1, h + 1, dtype=float)


def _shifted(y: np.ndarray, m: int) -> np.ndarray:
    return np.concatenate((np.full(min(m, len(y)), np.nan), y[:-m] if m < len(y) else y[:0]))


# --- baselines ---------------------------------------------------------------


def naive(y: np.ndarray, h: int) -> Fit:
    need(y, 1)
    fitted = _shifted(y, 1)
    return Fit(fitted, np.full(h, y[-1]), sigma2(y, fitted) * _steps(h))


def drift(y: np.ndarray, h: int) -> Fit:
    need(y, 2)
    slope = (y[-1] - y[0]) / (len(y) - 1)
    fitted = _shifted(y, 1) + slope
    return Fit(fitted, y[-1] + slope * _steps(h), sigma2(y, fitted) * _steps(h), {"drift": slope})


def seasonal_naive(y: np.ndarray, h: int, period: int = 12) -> Fit:
    need(y, period)
    fitted = _shifted(y, period)
    k = np.arange(h)
    return Fit(fitted, y[len(y) - period + k % period], sigma2(y, fitted) * (k // period + 1.0))


def seasonal_window_average(y: np.ndarray, h: int, period: int = 12, window: int = 2) -> Fit:
    """Mean of the same phase over up to ``window`` earlier cycles; cycles beyond
    the data are skipped, and the last value stands in for none."""
    need(y, period)
    n = len(y)

    def mean_at(t: int) -> float:
        back = [y[t - c * period] for c in range(1, window + 1) if 0 <= t - c * period < n]
        return float(np.mean(back)) if back else math.nan

    fitted = np.array([mean_at(t) for t in range(n)])
    k = np.arange(h)
    cycle = []
    for p in range(min(h, period)):
        v = mean_at(n + p)
        cycle.append(v if math.isfinite(v) else y[-1])
    return Fit(fitted, np.array([cycle[i % period] for i in range(h)]), sigma2(y, fitted) * (k // period + 1.0))


def moving_average(y: np.ndarray, h: int, window: int = 0) -> Fit:
    """Mean of the last ``window`` values (0: all)."""
    need(y, max(1, window))
    total = np.concatenate(([0.0], np.cumsum(y)))
    t = np.arange(len(y))
    fitted = np.full(len(y), np.nan)
    if window == 0:
        fitted[1:] = total[1:-1] / t[1:]
        point = y.mean()
    else:
        fitted[window:] = (total[window:-1] - total[:-window - 1]) / window
        point = y[-window:].mean()
    return Fit(fitted, np.full(h, point), np.full(h, sigma2(y, fitted)))


def historic_average(y: np.ndarray, h: int) -> Fit:
    return moving_average(y, h, 0)


def window_average(y: np.ndarray, h: int, window: int = 7) -> Fit:
    return moving_average(y, h, max(1, window))


# --- exponential smoothing -------------------------------------------------------


def ses_path(y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """One-step forecasts (the first is the first value) and the last level."""
    out, level, keep = [], float(y[0]), 1 - alpha
    for v in y.tolist():
        out.append(level)
        level = alpha * v + keep * level
    return np.array(out), level


def ses_sse(values: list[float], alpha: float) -> float:
    level, keep, total = values[0], 1 - alpha, 0.0
    for v in values:
        e = v - level
        total += e * e
        level = alpha * v + keep * level
    return total


def ses_variance(alpha: float, s2: float, h: int, textbook: bool = False) -> np.ndarray:
    """Growth of the variance with the horizon; ``textbook``: 1 + (h - 1) alpha^2."""
    k = np.arange(h)
    if textbook:
        return s2 * (1 + k * alpha * alpha)
    b2 = (1 - alpha) ** 2
    return s2 * (1 + (b2 * (1 - b2**k) / (1 - b2) if b2 < 1 - 1e-12 else k.astype(float)))


def ses(y: np.ndarray, h: int, alpha: float | None = None, textbook: bool = False) -> Fit:
    need(y, 1)
    if alpha is None:
        values = y.tolist()
        (alpha,), _ = nelder_mead(lambda p: ses_sse(values, p[0]), [0.5], [(1e-4, 0.9999)], 500, 1e-8)
    fitted, level = ses_path(y, alpha)
    return Fit(fitted, np.full(h, level), ses_variance(alpha, sigma2(y, fitted), h, textbook), {"alpha": alpha})


def _holt_path(values: list[float], a: float, b: float, phi: float) -> tuple[list[float], float, float]:
    level, trend, out = values[0], values[1] - values[0], [values[0]]
    for v in values[1:]:
        f = level + phi * trend
        out.append(f)
        new = a * v + (1 - a) * f
        trend = b * (new - level) + (1 - b) * phi * trend
        level = new
    return out, level, trend


def holt(y: np.ndarray, h: int, alpha: float | None = None, beta: float | None = None, phi: float = 1.0, damped: bool = False) -> Fit:
    need(y, 2)
    values = y.tolist()
    if alpha is None or beta is None:
        start, bounds = [0.3, 0.1], [(1e-4, 0.9999)] * 2
        if damped:
            start, bounds = [*start, 0.98], [*bounds, (0.8, 1.0)]

        def sse(p: list[float]) -> float:
            out, _, _ = _holt_path(values, p[0], p[1], p[2] if damped else 1.0)
            return sum((v - f) ** 2 for v, f in zip(values, out, strict=True))

        p, _ = nelder_mead(sse, start, bounds, 1000, 1e-8)
        alpha, beta, phi = p[0], p[1], p[2] if damped else 1.0
    out, level, trend = _holt_path(values, alpha, beta, phi)
    fitted = np.array(out)
    damp = np.cumsum(phi ** _steps(h))
    s2 = sigma2(y, fitted)
    psi = alpha + alpha * beta * damp
    variance = s2 * (1 + np.concatenate(([0.0], np.cumsum(psi**2)))[:h])
    return Fit(fitted, level + trend * damp, variance, {"alpha": alpha, "beta": beta, "phi": phi})


def seasonal_start(y: np.ndarray, m: int, multiplicative: bool, normalise: bool) -> tuple[float, float, np.ndarray]:
    level = float(y[:m].mean())
    trend = float((y[m:2 * m] - y[:m]).sum() / m**2) if len(y) >= 2 * m else 0.0
    season = y[:m] / level if multiplicative and level else y[:m] - level
    if normalise:
        season = season / season.mean() if multiplicative and season.mean() else season - season.mean()
    return level, trend, season.astype(float)


def _hw_path(values: list[float], m: int, mult: bool, start: tuple, a: float, b: float, g: float) -> tuple[list[float], float, float, list[float]]:
    level, trend, season = start[0], start[1], list(start[2])
    out = values[:m]
    for t in range(m, len(values)):
        v, s, base = values[t], season[t % m], level + trend
        if mult:
            out.append(base * s)
            new = a * (v / s if abs(s) > 1e-10 else v) + (1 - a) * base
            season[t % m] = g * (v / new if abs(new) > 1e-10 else 1.0) + (1 - g) * s
        else:
            out.append(base + s)
            new = a * (v - s) + (1 - a) * base
            season[t % m] = g * (v - new) + (1 - g) * s
        trend = b * (new - level) + (1 - b) * trend
        level = new
    return out, level, trend, season


def holt_winters(y: np.ndarray, h: int, period: int = 12, multiplicative: bool = False, alpha: float | None = None, beta: float | None = None, gamma: float | None = None) -> Fit:
    need(y, 2 * period)
    start = seasonal_start(y, period, multiplicative, True)
    start = (start[0], start[1], start[2].tolist())
    values = y.tolist()
    if alpha is None or beta is None or gamma is None:
        def sse(p: list[float]) -> float:
            out = _hw_path(values, period, multiplicative, start, *p)[0]
            return sum((v - f) ** 2 for v, f in zip(values, out, strict=True))

        (alpha, beta, gamma), _ = nelder_mead(sse, [0.3, 0.1, 0.1], [(1e-4, 0.9999)] * 3, 1000, 1e-8)
    out, level, trend, season = _hw_path(values, period, multiplicative, start, alpha, beta, gamma)
    fitted = np.array(out)
    k, n = np.arange(h), len(y)
    s = np.array([season[(n + i) % period] for i in range(h)])
    base = level + trend * (k + 1)
    s2 = sigma2(y, fitted, period)
    return Fit(fitted, base * s if multiplicative else base + s, s2 * (k // period + 1.0), {"alpha": alpha, "beta": beta, "gamma": gamma})


def seasonal_es(y: np.ndarray, h: int, period: int = 12, alpha: float | None = 0.3) -> Fit:
    """Simple smoothing of each phase on its own; the oldest ``n % period`` values are left out."""
    need(y, period)
    n = len(y)
    cut = n % period
    table = y[cut:].reshape(-1, period)
    fitted, levels = np.full(n, np.nan), []
    for p in range(period):
        a = alpha
        if a is None:
            values = table[:, p].tolist()
            (a,), _ = nelder_mead(lambda q, values=values: ses_sse(values, q[0]), [0.5], [(1e-4, 0.9999)], 500, 1e-8)
        path, level = ses_path(table[:, p], a)
        fitted[cut + p::period] = path
        levels.append(level)
    fitted[cut:cut + period] = np.nan
    k = np.arange(h)
    return Fit(fitted, np.array([levels[i % period] for i in range(h)]), sigma2(y, fitted) * np.sqrt(1 + 0.1 * k), {"alpha": alpha})


# --- ETS ---------------------------------------------------------------------------


def _ets_start(y: np.ndarray, trend: str, season: str, m: int) -> tuple[float, float, list[float]]:
    if season != "N":
        level, b, s = seasonal_start(y, m, season == "M", False)
        return level, (b if trend != "N" else 0.0), s.tolist()
    if trend != "N":
        head = y[:min(len(y), max(10, 2 * m))]
        a, b = line(head)
        return a, b, []
    return float(y[0]), 0.0, []


def _ets_path(values: list[float], error: str, trend: str, season: str, m: int, p: dict, first: tuple) -> tuple[list[float], float, float, list[float]]:
    level, b, s = first[0], first[1], list(first[2])
    a, be, g, phi = p["alpha"], p.get("beta", 0.0), p.get("gamma", 0.0), p.get("phi", 1.0)
    out = []
    for t, v in enumerate(values):
        base = level + phi * b if trend != "N" else level
        k = t % m if season != "N" else 0
        f = base + s[k] if season == "A" else base * s[k] if season == "M" else base
        out.append(f)
        if season == "M":
            w = v / s[k] if abs(s[k]) > 1e-10 else v
        elif season == "A":
            w = v - s[k]
        else:
            w = v
        new = base + a * (w - base)
        if trend != "N":
            b = phi * b + be * (new - base)
        if season == "A":
            s[k] += g * (v - base - s[k])
        elif season == "M":
            s[k] += g * ((v / base if abs(base) > 1e-10 else 1.0) - s[k])
        level = new
    return out, level, b, s


def ets_specs() -> list[str]:
    """All 18: error, trend (N, A, Ad) and season as in ``MAdM``."""
    return [e + t + s for e in "AM" for t in ("N", "A", "Ad") for s in "NAM"]


def ets(y: np.ndarray, h: int, spec: str = "ANN", period: int = 1, criterion: str = "textbook") -> Fit:
    """Parameters by likelihood; ``info`` has aic, aicc, bic.

    ``criterion='compat'`` scores by the plain residual variance over all points
    and without counting sigma; ``textbook`` uses the optimised likelihood and
    counts it.
    """
    error, season, trend = spec[0], spec[-1], spec[1:-1]
    m = period if season != "N" else 1
    need(y, 2 * m if season != "N" else 2)
    values = y.tolist()
    first = _ets_start(y, trend, season, m)
    skip = m if season != "N" else 1
    names = ["alpha", *(["beta"] if trend != "N" else []), *(["gamma"] if season != "N" else []), *(["phi"] if trend == "Ad" else [])]
    # fixed values: where the search starts, and its bounds
    start = {"alpha": 0.3, "beta": 0.1, "gamma": 0.1, "phi": 0.98}
    limits = {"alpha": (1e-4, 0.9999), "beta": (1e-4, 0.9999), "gamma": (1e-4, 0.9999), "phi": (0.8, 0.98)}
    free = trend == "A" and season == "N"  # level and trend are estimated too

    def unpack(p: list[float]) -> tuple[dict, tuple]:
        d = dict(zip(names, p, strict=False))
        return d, (p[len(names)], p[len(names) + 1], []) if free else first

    def loss(p: list[float]) -> float:
        d, f0 = unpack(p)
        out = _ets_path(values, error, trend, season, m, d, f0)[0]
        total = logs = 0.0
        n = 0
        for v, f in zip(values[skip:], out[skip:], strict=True):
            e = v - f
            if error == "M":
                if abs(f) < 1e-10:
                    return 1e300
                e /= f
                logs += math.log(abs(f))
            total += e * e
            n += 1
        return 0.5 * n * (1 + math.log(max(total / max(n, 1), 1e-300)) + math.log(2 * math.pi)) + logs

    x0 = [start[k] for k in names] + ([first[0], first[1]] if free else [])
    span = float(np.abs(y).max()) * 10 + 10
    box = [limits[k] for k in names] + ([(-span, span)] * 2 if free else [])
    starts = [x0]
    if free:  # fixed values: further rates to start from
        starts += [[a, b, *x0[2:]] for a, b in ((0.1, 0.05), (0.5, 0.2), (0.8, 0.1), (0.2, 0.01))]
    best, nll = min((nelder_mead(loss, s, box, 2000, 1e-8) for s in starts), key=lambda r: r[1])
    params, f0 = unpack(best)
    out, level, b, s = _ets_path(values, error, trend, season, m, params, f0)
    fitted = np.array(out)
    n = len(y)
    k = len(names) + 1 + (trend != "N") + (m if season != "N" else 0)
    if criterion == "compat":
        ll = -0.5 * n * (1 + math.log(max(sigma2(y, fitted), 1e-300)) + math.log(2 * math.pi))
    else:
        ll, k, n = -nll, k + 1, n - skip
    aic = -2 * ll + 2 * k
    info = {**params, "loglik": ll, "aic": aic, "aicc": -2 * ll + 2 * k * n / max(n - k - 1, 1), "bic": -2 * ll + k * math.log(max(n, 1)), "spec": spec}
    steps = _steps(h)
    phi = params.get("phi", 1.0)
    base = level + (b * np.cumsum(phi**steps) if trend != "N" else 0.0) * np.ones(h)
    at = np.arange(h)
    if season != "N":
        f = np.array([s[(len(y) + i) % m] for i in range(h)])
        base = base * f if season == "M" else base + f
    return Fit(fitted, base, sigma2(y, fitted, skip) * ((at // m + 1.0) if season != "N" else steps), info)


def auto_ets(y: np.ndarray, h: int, period: int = 1, criterion: str = "aicc", additive_only: bool = False, allow_damped: bool = True) -> Fit:
    """The best of the allowed specs by an information criterion."""
    need(y, 4)
    best = None
    positive = (y > 0).all()
    for spec in ets_specs():
        error, season, trend = spec[0], spec[-1], spec[1:-1]
        if spec in ("MAA", "MAdA") or (season != "N" and (period < 2 or len(y) < 2 * period)):
            continue
        if "M" in spec and (additive_only or not positive) or trend == "Ad" and not allow_damped:
            continue
        try:
            fit = ets(y, h, spec, period, "compat")
        except (ValueError, OverflowError, ZeroDivisionError):
            continue
        if math.isfinite(fit.info[criterion]) and (best is None or fit.info[criterion] < best.info[criterion]):
            best = fit
    if best is None:
        return ets(y, h, "ANN", 1, "compat")
    return best


# --- intermittent demand ----------------------------------------------------------------


def croston(y: np.ndarray, h: int, variant: str = "classic", alpha: float | None = 0.1) -> Fit:
    """Sizes and intervals of demands, smoothed apart; ``variant`` classic or sba;
    ``alpha=None`` optimises it. The first interval counts from the start."""
    need(y, 4)
    at = np.flatnonzero(y > 0)
    if len(at) < 2:
        raise TooShort(2, len(at))

    def path(a: float) -> tuple[np.ndarray, float]:
        out, size, gap, last = np.full(len(y), np.nan), None, None, -1
        for t, v in enumerate(y.tolist()):
            if size is not None:
                out[t] = size / max(gap, 0.001)
            if v > 0:
                g = float(t - last)
                size, gap = (v, g) if size is None else (a * v + (1 - a) * size, a * g + (1 - a) * gap)
                last = t
        return out, size / max(gap, 0.001)

    if alpha is None:
        (alpha,), _ = nelder_mead(lambda p: sigma2(y, path(p[0])[0]), [0.1], [(0.01, 0.99)], 500, 1e-4)
    fitted, rate = path(alpha)
    factor = 1 - alpha / 2 if variant == "sba" else 1.0
    fitted = fitted * factor
    r = (y - fitted)[np.isfinite(fitted)]
    var = float(r.var(ddof=1)) if len(r) > 1 else 0.0
    return Fit(fitted, np.full(h, rate * factor), np.full(h, var), {"alpha": alpha})


def tsb(y: np.ndarray, h: int, alpha: float = 0.1, beta: float = 0.1) -> Fit:
    """Smoothed size times smoothed chance of demand, the latter in every period."""
    need(y, 2)
    demand = y > 0
    if not demand.any():
        return Fit(np.zeros(len(y)), np.zeros(h), np.zeros(h))
    size, chance = float(y[demand][0]), float(demand[0])
    out = []
    for v, d in zip(y.tolist(), demand.tolist(), strict=True):
        out.append(size * chance)
        if d:
            size = alpha * v + (1 - alpha) * size
        chance = beta * d + (1 - beta) * chance
    fitted = np.array(out)
    r = y - fitted
    return Fit(fitted, np.full(h, size * chance), np.full(h, float(r.var(ddof=1))), {"alpha": alpha, "beta": beta})


def _mean_interval(y: np.ndarray) -> int:
    at = np.flatnonzero(y != 0)
    gaps = np.diff(at)
    return max(1, int(math.floor(gaps.mean() + 0.5))) if len(gaps) else 1


def _aggregated(y: np.ndarray, k: int) -> float:
    """SES level of block sums, alpha of 101 from 0.1 to 0.3, over the block size."""
    blocks = y[len(y) % k:].reshape(-1, k).sum(1)
    values = blocks.tolist()
    if not values:
        return float(y.mean())
    grid = 0.1 + 0.002 * np.arange(101)
    alpha = min(grid.tolist(), key=lambda a: ses_sse(values, a))
    return ses_path(blocks, alpha)[1] / k


def adida(y: np.ndarray, h: int, level: int | None = None) -> Fit:
    need(y, 4)
    point = _aggregated(y, level or _mean_interval(y))
    fitted = np.full(len(y), point)
    return Fit(fitted, np.full(h, point), np.full(h, float((y - fitted).var(ddof=1))), {"level": level or _mean_interval(y)})


def imapa(y: np.ndarray, h: int, max_level: int | None = None) -> Fit:
    need(y, 4)
    top = max_level or _mean_interval(y)
    point = float(np.mean([_aggregated(y, k) for k in range(1, top + 1) if k <= len(y)]))
    fitted = np.full(len(y), point)
    return Fit(fitted, np.full(h, point), np.full(h, float((y - fitted).var(ddof=1))), {"levels": top})


# --- the same for many series of one length, a row each ---------------------------------


def _sample_variance(r: np.ndarray) -> np.ndarray:
    """Of each column over what is finite; 0 of fewer than two values."""
    ok = np.isfinite(r)
    c = ok.sum(0)
    mean = np.where(ok, r, 0.0).sum(0) / np.maximum(c, 1)
    d = np.where(ok, r - mean, 0.0)
    return np.where(c > 1, (d * d).sum(0) / np.maximum(c - 1, 1), 0.0)


def croston_batch(y: np.ndarray, variant: str = "classic", alpha: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, n = y.shape
    rows = np.ascontiguousarray(y.T)
    demand = rows > 0
    fitted = np.full((n, s), np.nan)
    size, gap, last = np.full(s, np.nan), np.full(s, np.nan), np.full(s, -1.0)
    for t in range(n):
        fitted[t] = size / np.maximum(gap, 0.001)
        v, g, new = rows[t], t - last, np.isnan(size)
        size = np.where(demand[t], np.where(new, v, alpha * v + (1 - alpha) * size), size)
        gap = np.where(demand[t], np.where(new, g, alpha * g + (1 - alpha) * gap), gap)
        last = np.where(demand[t], t, last)
    factor = 1 - alpha / 2 if variant == "sba" else 1.0
    return (demand.sum(0) >= 2) & (n >= 4), size / np.maximum(gap, 0.001) * factor, _sample_variance(rows - fitted * factor)


def tsb_batch(y: np.ndarray, alpha: float = 0.1, beta: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, n = y.shape
    rows = np.ascontiguousarray(y.T)
    demand = rows > 0
    some = demand.any(0)
    size = rows[demand.argmax(0), np.arange(s)] if n else np.zeros(s)
    chance = demand[0].astype(float) if n else np.zeros(s)
    fitted = np.empty((n, s))
    for t in range(n):
        fitted[t] = size * chance
        size = np.where(demand[t], alpha * rows[t] + (1 - alpha) * size, size)
        chance = beta * demand[t] + (1 - beta) * chance
    return np.full(s, n >= 2), np.where(some, size * chance, 0.0), np.where(some, _sample_variance(rows - fitted), 0.0)


def _mean_intervals(y: np.ndarray) -> np.ndarray:
    some = y != 0
    c, n = some.sum(1), y.shape[1]
    span = (n - 1 - some[:, ::-1].argmax(1)) - some.argmax(1)
    return np.where(c > 1, np.maximum(1, np.floor(span / np.maximum(c - 1, 1) + 0.5)), 1).astype(np.int64)


def _aggregated_batch(y: np.ndarray, k: int) -> np.ndarray:
    s, n = y.shape
    if k > n:
        return y.mean(1)
    blocks = y[:, n % k:].reshape(s, -1, k).sum(2)
    grid = 0.1 + 0.002 * np.arange(101)
    keep = 1 - grid
    level = np.repeat(blocks[:, :1], len(grid), axis=1)
    total, e, step = np.zeros_like(level), np.empty_like(level), np.empty_like(level)
    for v in blocks.T[:, :, None]:
        np.subtract(v, level, out=e)
        np.multiply(e, e, out=e)
        total += e
        np.multiply(grid, v, out=step)
        np.multiply(keep, level, out=level)
        np.add(step, level, out=level)
    return level[np.arange(s), total.argmin(1)] / k


def adida_batch(y: np.ndarray, level: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    levels = np.full(len(y), level) if level else _mean_intervals(y)
    point = np.empty(len(y))
    for k in np.unique(levels).tolist():
        point[levels == k] = _aggregated_batch(y[levels == k], k)
    return np.full(len(y), y.shape[1] >= 4), point, _sample_variance((y - point[:, None]).T)


def imapa_batch(y: np.ndarray, max_level: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = np.minimum(np.full(len(y), max_level) if max_level else _mean_intervals(y), y.shape[1])
    total = np.zeros(len(y))
    for k in range(1, int(top.max(initial=0)) + 1):
        total[top >= k] += _aggregated_batch(y[top >= k], k)
    point = total / np.maximum(top, 1)
    return np.full(len(y), y.shape[1] >= 4), point, _sample_variance((y - point[:, None]).T)
