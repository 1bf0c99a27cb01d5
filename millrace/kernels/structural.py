"""Boosted, trigonometric, decomposition-based and volatility models."""

from __future__ import annotations

import math

import numpy as np

from .decompose import mstl
from .numeric import boxcox_lambda, line, nelder_mead, ols
from .smoothing import Fit, auto_ets, naive, need, ses, sigma2


def _fourier(t: np.ndarray, m: int, order: int) -> np.ndarray:
    k = np.arange(1, min(order, m // 2) + 1)
    a = 2 * np.pi * np.outer(t, k) / m
    return np.concatenate((np.sin(a), np.cos(a)), axis=1)


def _siegel(y: np.ndarray) -> tuple[float, float]:
    """Repeated-medians line."""
    n = len(y)
    t = np.arange(n)
    slopes = np.empty(n)
    for i in range(n):
        d = t - i
        d[i] = 1
        s = (y - y[i]) / d
        slopes[i] = np.median(np.delete(s, i)) if n > 1 else 0.0
    b = float(np.median(slopes))
    return float(np.median(y - b * t)), b


def mfles(y: np.ndarray, h: int, periods: tuple[int, ...] = (12,), max_rounds: int = 50, seasonal_rate: float = 0.9, trend_rate: float = 0.9, robust: bool | None = None, multiplicative: bool | None = None) -> Fit:
    """Gradient-boosted decomposition: median, Fourier seasons, linear or robust
    trend and short rolling means, each accepted only if it lowers the error."""
    need(y, 4)
    n = len(y)
    logged = bool((y > 0).all()) if multiplicative is None else multiplicative and bool((y > 0).all())
    z = np.log(y) if logged else y
    center, sd = (0.0, 1.0) if logged else (float(y.mean()), float(y.std()) or 1.0)
    z = (z - center) / sd
    t, future = np.arange(n), np.arange(n, n + h)
    use_robust = (float(y.std() / abs(y.mean())) > 0.7 if abs(y.mean()) > 1e-10 else False) if robust is None else robust
    fitted = np.full(n, np.median(z))
    trend, season = np.full(n, np.median(z)), np.zeros(n)
    ahead = np.zeros(h)
    mse, stale, first_r2 = float(((z - fitted) ** 2).mean()), 0, None
    usable = [m for m in periods if 1 < m <= n // 2]
    for k in range(max_rounds):
        better = False

        def accept(part: np.ndarray, fitted: np.ndarray = None) -> bool:
            return float(((z - fitted - part) ** 2).mean()) < mse - 1e-12

        for m in usable:
            order = 5 if m < 10 else 10 if m < 70 else 15
            x = _fourier(t, m, order)
            beta = ols(x, z - fitted)
            part = seasonal_rate * (x @ beta[1:])
            if accept(part, fitted):
                fitted, season = fitted + part, season + part
                ahead = ahead + seasonal_rate * (_fourier(future, m, order) @ beta[1:])
                mse, better = float(((z - fitted) ** 2).mean()), True
        r = z - fitted
        if k % 2:
            a, b = _siegel(r) if use_robust else line(r)
            part = trend_rate * (a + b * t)
            if first_r2 is None:
                total = float(((r - r.mean()) ** 2).sum())
                first_r2 = max(0.0, 1 - float(((r - a - b * t) ** 2).sum()) / total) if total > 1e-12 else 0.0
        elif k > 4:
            part = np.convolve(r, [0.5, 0.5], "full")[:n]
            part[0] = r[0]
        else:
            part = None
        if part is not None and accept(part, fitted):
            fitted, trend = fitted + part, trend + part
            mse, better = float(((z - fitted) ** 2).mean()), True
        stale = 0 if better else stale + 1
        if stale >= 5:
            break
    slope = (trend[-1] - trend[-2]) * (first_r2 or 0.0) if n > 1 else 0.0
    point = (trend[-1] + slope * np.arange(1, h + 1) + ahead) * sd + center
    fitted = fitted * sd + center
    if logged:
        point, fitted = np.exp(np.minimum(point, 700)), np.exp(fitted)
    r = y - fitted
    return Fit(fitted, point, float(r.var(ddof=1)) * np.arange(1, h + 1), {"multiplicative": logged, "robust": use_robust})


def mstl_forecaster(y: np.ndarray, h: int, periods: tuple[int, ...] = (12,), trend_model: str = "auto_ets", season: str = "last", robust: bool = False) -> Fit:
    """Decomposition, a model of the trend, and each season carried on from its
    last cycle (``last``) or the mean of its cycles (``mean``).

    Fits are the trend model's one-step fits plus the seasons, so residuals are
    those of the forecaster and not of the decomposition.
    """
    parts = mstl(y, periods, robust=robust)
    base = parts.trend + parts.remainder
    if trend_model == "auto_ets":
        fit = auto_ets(base, h, 1, additive_only=True)
    elif trend_model == "ses":
        fit = ses(base, h, 0.3)
    elif trend_model == "linear":
        a, b = line(base)
        fit = Fit(a + b * np.arange(len(y)), a + b * (len(y) + np.arange(h)), np.zeros(h))
    elif trend_model == "naive":
        fit = naive(base, h)
    else:
        raise ValueError(f"unknown trend model {trend_model}")
    point = fit.point.copy()
    for p, s in parts.seasonal.items():
        if season == "mean":
            cycle = np.array([s[k::p].mean() for k in range(p)])
            point += cycle[(len(y) + np.arange(h)) % p]
        else:
            point += s[len(y) - p + np.arange(h) % p]
    fitted = fit.fitted + parts.season
    return Fit(fitted, point, sigma2(y, fitted) * (1 + 0.1 * np.arange(h)), {"trend": trend_model})


def _box(y: np.ndarray, lam: float | None) -> np.ndarray:
    return y if lam is None else np.log(y) if abs(lam) < 1e-10 else (y**lam - 1) / lam


def _unbox(z: np.ndarray, lam: float | None) -> np.ndarray:
    if lam is None:
        return z
    if abs(lam) < 1e-10:
        return np.exp(np.minimum(z, 700))
    return np.maximum(lam * z + 1, 0.0) ** (1 / lam)


def _harmonics(z: np.ndarray, m: int) -> int:
    """Number of harmonics with the lowest AIC on the detrended series."""
    w = min(2 * m, len(z))
    total = np.concatenate(([0.0], np.cumsum(z)))
    t = np.arange(len(z))
    a, b = np.maximum(0, t - w // 2), np.minimum(len(z), t + w - w // 2)
    d = z - (total[b] - total[a]) / (b - a)
    best = (math.inf, 1)
    for k in range(1, max(1, min(m // 2, 6)) + 1):
        x = _fourier(t, m, k)
        beta = ols(x, d)
        rss = float(((d - beta[0] - x @ beta[1:]) ** 2).sum())
        best = min(best, (len(z) * math.log(max(rss / len(z), 1e-300)) + 2 * (2 * k), k))
    return best[1]


def tbats(y: np.ndarray, h: int, periods: tuple[int, ...] = (12,), box_cox: bool | float = False, trend: bool = True, damped: bool = False, fourier_k: tuple[int, ...] | None = None) -> Fit:
    """Trigonometric seasons in innovations form, with an optional Box-Cox
    transformation, (damped) trend and given numbers of harmonics.

    Bounds are formed on the transformed scale and carried back, which keeps
    them in order; series with values not above 0 are not transformed.
    """
    periods = tuple(m for m in periods if m > 1)
    need(y, max(10, max(periods, default=1)))
    lam = None
    if box_cox is not False and (y > 0).all():
        lam = boxcox_lambda(y) if box_cox is True else float(box_cox)
    z = _box(y, lam)
    ks = tuple(fourier_k) if fourier_k is not None else tuple(_harmonics(z, m) for m in periods)
    spin = [(2 * math.pi * j / m) for m, k in zip(periods, ks, strict=True) for j in range(1, k + 1)]
    cos, sin = np.cos(spin), np.sin(spin)
    owner = np.repeat(np.arange(len(periods)), ks) if periods else np.zeros(0, int)
    names = ["alpha", *(["beta"] if trend else []), *(["phi"] if trend and damped else [])]
    x0 = [0.09, *([0.05] if trend else []), *([0.98] if trend and damped else []), *[0.0] * (2 * len(periods))]
    box = [(1e-4, 0.99), *([(1e-4, 0.99)] if trend else []), *([(0.8, 0.999)] if trend and damped else []), *[(-0.3, 0.3)] * (2 * len(periods))]
    values = z.tolist()

    def run(p: list[float]) -> tuple[list[float], float, float, np.ndarray, np.ndarray]:
        q = dict(zip(names, p, strict=False))
        a, be, phi = q["alpha"], q.get("beta", 0.0), q.get("phi", 1.0)
        g = np.array(p[len(names):]).reshape(-1, 2)[owner] if len(owner) else np.zeros((0, 2))
        level, b, c, s = float(z.mean()), 0.0, np.zeros(len(spin)), np.zeros(len(spin))
        out = []
        for v in values:
            f = level + phi * b
            c, s = c * cos + s * sin, s * cos - c * sin
            total = f + float(c.sum())
            out.append(total)
            e = v - total
            level, b = f + a * e, phi * b + be * e
            c, s = c + g[:, 0] * e, s + g[:, 1] * e
            if abs(e) > 1e100:
                raise OverflowError
        return out, level, b, c, s

    def loss(p: list[float]) -> float:
        try:
            return sum((v - f) ** 2 for v, f in zip(values, run(p)[0], strict=True))
        except OverflowError:
            return 1e300

    best, _ = nelder_mead(loss, x0, box, 300, 1e-8)
    out, level, b, c, s = run(best)
    phi = dict(zip(names, best, strict=False)).get("phi", 1.0)
    inner = []
    for _ in range(h):
        level, b = level + phi * b, phi * b
        c, s = c * cos + s * sin, s * cos - c * sin
        inner.append(level + float(c.sum()))
    inner = np.array(inner)
    fit = np.array(out)
    s2 = sigma2(z, fit)
    k = len(best) + 1 + trend + 2 * len(spin) + (lam is not None)
    jac = (lam - 1) * float(np.log(y).sum()) if lam is not None else 0.0
    ll = -0.5 * len(z) * (1 + math.log(max(s2, 1e-300)) + math.log(2 * math.pi)) + jac
    result = Fit(_unbox(fit, lam), _unbox(inner, lam), s2 * np.arange(1, h + 1), {"aic": -2 * ll + 2 * k, "lambda": lam, "harmonics": ks, "trend": trend, "damped": damped})
    if lam is not None:
        def bounds(zq: float) -> tuple[np.ndarray, np.ndarray]:
            half = zq * np.sqrt(s2 * np.arange(1, h + 1))
            return _unbox(inner - half, lam), _unbox(inner + half, lam)

        result.info["bounds"] = bounds
    return result


def auto_tbats(y: np.ndarray, h: int, periods: tuple[int, ...] = (12,)) -> Fit:
    """Lowest AIC over trend, no trend, damped trend, with and without Box-Cox,
    and one harmonic fewer or more."""
    best = None
    positive = bool((y > 0).all())
    for trend, damped in ((True, False), (False, False), (True, True)):
        for bc in (False, True) if positive else (False,):
            fit = tbats(y, h, periods, bc, trend, damped)
            if best is None or fit.info["aic"] < best[0].info["aic"]:
                best = (fit, trend, damped, bc)
    fit, trend, damped, bc = best
    for step in (-1, 1):
        ks = tuple(max(1, min(m // 2, k + step)) for m, k in zip([m for m in periods if m > 1], fit.info["harmonics"], strict=True))
        other = tbats(y, h, periods, bc, trend, damped, ks)
        if other.info["aic"] < best[0].info["aic"]:
            best = (other, trend, damped, bc)
    return best[0]


def garch(y: np.ndarray, h: int, p: int = 1, q: int = 1) -> Fit:
    """Gaussian likelihood of conditional variance s2 = w + sum a e^2 + sum b s2
    about the mean. The point forecast is the mean; ``variance`` is the forecast
    of the conditional variance."""
    need(y, p + q + 10)
    mean = float(y.mean())
    e2 = ((y - mean) ** 2).tolist()
    v0 = float(np.mean(e2))
    if v0 < 1e-20:
        return Fit(np.full(len(y), mean), np.full(h, mean), np.zeros(h), {"omega": 0.0, "alpha": [0.0] * p, "beta": [0.0] * q})

    def path(x: list[float]) -> list[float]:
        s: list[float] = []
        for t in range(len(e2)):
            v = x[0]
            for i in range(p):
                v += x[1 + i] * (e2[t - 1 - i] if t > i else v0)
            for j in range(q):
                v += x[1 + p + j] * (s[t - 1 - j] if t > j else v0)
            s.append(max(v, 1e-12))
        s[0] = v0
        return s

    def loss(x: list[float]) -> float:
        if sum(x[1:]) >= 0.9999:
            return 1e300
        return 0.5 * sum(math.log(s) + e / s for s, e in zip(path(x), e2, strict=True))

    box = [(1e-8 * v0, 10 * v0)] + [(0.0, 0.999)] * (p + q)
    starts = []
    for a, b in ((0.1, 0.8), (0.05, 0.9), (0.2, 0.6), (0.15, 0.7), (0.3, 0.3), (0.05, 0.5)):
        starts.append([max(1e-8, 1 - a - b) * v0, *[a / p] * p, *[b / max(q, 1)] * q])
    x, nll = min((nelder_mead(loss, s, box, 1000, 1e-10) for s in starts), key=lambda r: r[1])
    s = path(x)
    es, ss, out = list(e2), list(s), []
    for _ in range(h):
        v = x[0] + sum(x[1 + i] * es[-1 - i] for i in range(p)) + sum(x[1 + p + j] * ss[-1 - j] for j in range(q))
        out.append(v)
        es.append(v)
        ss.append(v)
    share = sum(x[1:])
    info = {"omega": x[0], "alpha": x[1:1 + p], "beta": x[1 + p:], "loglik": -nll, "stationary": share < 1, "unconditional": x[0] / (1 - share) if share < 1 else None, "conditional": s}
    return Fit(np.full(len(y), mean), np.full(h, mean), np.array(out), info)
