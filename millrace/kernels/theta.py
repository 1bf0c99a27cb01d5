"""The Theta family: standard, optimised and dynamic, with seasonal adjustment."""

from __future__ import annotations

import math

import numpy as np

from .numeric import biased_acf, line, nelder_mead, normal_quantile
from .smoothing import Fit, need, ses_path, ses_variance, sigma2


def is_seasonal(y: np.ndarray, m: int) -> bool:
    """The autocorrelation at the period against its one-sided 95 % bound."""
    if m < 4 or len(y) < 2 * m:
        return False
    r = biased_acf(y, m)
    return abs(r[m]) / math.sqrt((1 + 2 * float((r[1:m] ** 2).sum())) / len(y)) > normal_quantile(0.95)


def decompose(y: np.ndarray, m: int, multiplicative: bool = True) -> tuple[np.ndarray, bool]:
    """Seasonal factors by phase and whether they multiply (additive where a
    value is not positive or a factor is under 0.01)."""
    n, half = len(y), m // 2
    if m % 2:
        kernel = np.full(m, 1 / m)
    else:
        kernel = np.concatenate(([0.5], np.ones(m - 1), [0.5])) / m
    trend = np.full(n, np.nan)
    trend[half:n - half] = np.convolve(y, kernel, "valid")
    multiplicative = multiplicative and bool((y > 0).all())
    while True:
        ratio = y / trend if multiplicative else y - trend
        phase = np.array([np.nanmean(ratio[p::m]) if np.isfinite(ratio[p::m]).any() else (1.0 if multiplicative else 0.0) for p in range(m)])
        phase = phase / phase.mean() if multiplicative else phase - phase.mean()
        if multiplicative and (phase < 0.01).any():
            multiplicative = False
            continue
        return phase, multiplicative


class _Adjusted:
    """A series without its season, and the way back."""

    def __init__(self, y: np.ndarray, period: int, seasonal: bool | None, multiplicative: bool):
        n = len(y)
        use = is_seasonal(y, period) if seasonal is None else seasonal and period > 1 and n >= 2 * period
        self.m = period if use else 1
        self.factors, self.mult = decompose(y, period, multiplicative) if use else (np.zeros(1), False)
        f = self.factors[np.arange(n) % self.m]
        self.y, self.f = (y / f if self.mult else y - f), f

    def back(self, x: np.ndarray, first: int) -> np.ndarray:
        f = self.factors[(first + np.arange(len(x))) % self.m]
        return x * f if self.mult else x + f


def _curve(level: float, b: float, alpha: float, theta: float, h: int) -> np.ndarray:
    return level + (1 - 1 / theta) * b * (1 / alpha + np.arange(h))


def theta(y: np.ndarray, h: int, period: int = 1, seasonal: bool | None = None, alpha: float = 0.1, theta: float = 2.0, multiplicative: bool = True) -> Fit:
    """Standard model: smoothing at ``alpha`` plus a share of the linear trend."""
    need(y, 4)
    a = _Adjusted(y, period, seasonal, multiplicative)
    path, level = ses_path(a.y, alpha)
    _, b = line(a.y)
    fitted = a.back(path, 0)
    return Fit(fitted, a.back(_curve(level, b, alpha, theta, h), len(y)), ses_variance(alpha, sigma2(y, fitted), h), {"alpha": alpha, "theta": theta})


# fixed values: where the search for alpha and theta starts
STARTS = ((0.1, 2.0), (0.3, 2.0), (0.5, 2.0), (0.1, 3.0), (0.3, 1.5))
_BOX = [(0.01, 0.99), (1.0, 10.0)]


def optimized_theta(y: np.ndarray, h: int, period: int = 1, seasonal: bool | None = None, multiplicative: bool = True) -> Fit:
    """Alpha and theta by the mean squared error of 1- to 3-step forecasts."""
    need(y, 4)
    a = _Adjusted(y, period, seasonal, multiplicative)
    values, n = a.y.tolist(), len(y)
    _, b = line(a.y)

    def loss(p: list[float]) -> float:
        alpha, th = p
        level, total, count = values[0], 0.0, 0
        step = (1 - 1 / th) * b
        for t, v in enumerate(values):
            if t:
                for k in range(min(3, n - t)):
                    e = values[t + k] - (level + step * (1 / alpha + k))
                    total += e * e
                    count += 1
            level = alpha * v + (1 - alpha) * level
        return total / max(count, 1)

    (alpha, th), _ = min((nelder_mead(loss, s, _BOX, 200, 1e-6) for s in STARTS), key=lambda r: r[1])
    path, level = ses_path(a.y, alpha)
    inner = path + (1 - 1 / th) * b / alpha
    inner[0] = path[0]
    fitted = a.back(inner, 0)
    return Fit(fitted, a.back(_curve(level, b, alpha, th, h), n), ses_variance(alpha, sigma2(y, fitted), h), {"alpha": alpha, "theta": th})


def _dynamic(values: list[float], alpha: float, th: float, slope: float) -> tuple[list[float], float, float, float, float]:
    level = mean = values[0]
    bn, an = slope, values[0] - slope / 2
    out, power = [], 1.0
    for i, v in enumerate(values):
        out.append(values[0] if i == 0 else level + (1 - 1 / th) * (an * power + bn * (1 - power * (1 - alpha)) / alpha))
        level = alpha * v + (1 - alpha) * level
        mean_next = (i * mean + v) / (i + 1)
        if i:
            bn = ((i - 1) * bn + 6 * (v - mean) / (i + 1)) / (i + 2)
            an = mean_next - bn * (i + 2) / 2
        mean = mean_next
        power *= 1 - alpha
    return out, level, an, bn, mean


def dynamic_theta(y: np.ndarray, h: int, period: int = 1, seasonal: bool | None = None, optimize: bool = False, alpha: float = 0.1, theta: float = 2.0, multiplicative: bool = True) -> Fit:
    """The trend line is estimated anew at each step; ``optimize`` finds alpha and theta."""
    need(y, 4)
    a = _Adjusted(y, period, seasonal, multiplicative)
    values, n = a.y.tolist(), len(y)
    _, slope = line(a.y[:10])
    alpha_, th = alpha, theta
    if optimize:
        def loss(p: list[float]) -> float:
            out = _dynamic(values, p[0], p[1], slope)[0]
            return sum((v - f) ** 2 for v, f in zip(values[3:], out[3:], strict=True)) / max(1, n - 3)

        (alpha_, th), _ = min((nelder_mead(loss, s, _BOX, 200, 1e-6) for s in STARTS), key=lambda r: r[1])
    out, level, an, bn, mean = _dynamic(values, alpha_, th, slope)
    point, i, power = [], n, (1 - alpha_) ** n
    for _ in range(h):
        f = level + (1 - 1 / th) * (an * power + bn * (1 - power * (1 - alpha_)) / alpha_)
        point.append(f)
        level = alpha_ * f + (1 - alpha_) * level
        nxt = (i * mean + f) / (i + 1)
        bn = ((i - 1) * bn + 6 * (f - mean) / (i + 1)) / (i + 2)
        an = nxt - bn * (i + 2) / 2
        mean, power, i = nxt, power * (1 - alpha_), i + 1
    fitted = a.back(np.array(out), 0)
    return Fit(fitted, a.back(np.array(point), n), ses_variance(alpha_, sigma2(y, fitted), h), {"alpha": alpha_, "theta": th})


def dynamic_optimized_theta(y: np.ndarray, h: int, period: int = 1, seasonal: bool | None = None, multiplicative: bool = True) -> Fit:
    return dynamic_theta(y, h, period, seasonal, True, multiplicative=multiplicative)


def auto_theta(y: np.ndarray, h: int, period: int = 1, seasonal: bool | None = None) -> Fit:
    """The one of the four with the lowest in-sample mean squared error, all with
    the same seasonal adjustment; ``info`` has the winner's own score."""
    need(y, 6)
    fits = {"STM": theta(y, h, period, seasonal), "OTM": optimized_theta(y, h, period, seasonal), "DSTM": dynamic_theta(y, h, period, seasonal), "DOTM": dynamic_optimized_theta(y, h, period, seasonal)}
    scores = {k: sigma2(y, f.fitted) for k, f in fits.items()}
    best = min(scores, key=lambda k: scores[k])
    fits[best].info |= {"model": best, "mse": scores[best]}
    return fits[best]
