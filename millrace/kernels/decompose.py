"""Seasonal decomposition by tricube-weighted local means, for one or several periods."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .numeric import next_odd
from .smoothing import need


@dataclass
class Parts:
    trend: np.ndarray
    seasonal: dict[int, np.ndarray]
    remainder: np.ndarray

    @property
    def season(self) -> np.ndarray:
        return sum(self.seasonal.values())

    def seasonal_strength(self, period: int | None = None) -> float:
        s = self.season if period is None else self.seasonal[period]
        return strength(self.remainder, s)

    def trend_strength(self) -> float:
        return strength(self.remainder, self.trend)


def strength(remainder: np.ndarray, part: np.ndarray) -> float:
    """1 - var(remainder) / var(part + remainder), within 0..1."""
    whole = (part + remainder).var(ddof=1)
    return float(min(1.0, max(0.0, 1 - remainder.var(ddof=1) / whole))) if whole > 1e-10 else 0.0


def smooth(y: np.ndarray, span: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Weighted mean over ``span`` neighbours, cut off at the edges; tricube
    weights of distance times robustness weights."""
    half = span // 2
    d = np.abs(np.arange(-half, half + 1))
    kernel = (1 - (d / (half + 1)) ** 3) ** 3
    w = np.ones(len(y)) if weights is None else weights
    total = np.convolve(w, kernel, "full")[half:half + len(y)]
    out = np.convolve(w * y, kernel, "full")[half:half + len(y)]
    return np.where(total > 1e-10, out / np.maximum(total, 1e-10), y)


def _average(y: np.ndarray, window: int) -> np.ndarray:
    """Centred mean, partial at the edges."""
    total = np.concatenate(([0.0], np.cumsum(y)))
    t = np.arange(len(y))
    a, b = np.maximum(0, t - window // 2), np.minimum(len(y), t + window - window // 2)
    return (total[b] - total[a]) / (b - a)


def stl(y: np.ndarray, period: int, seasonal_span: int | None = None, trend_span: int | None = None, robust: bool = False, inner: int = 2, outer: int | None = None) -> Parts:
    """Trend, season and remainder. Spans default to the period (made odd) and to
    the next odd number from 1.5 p / (1 - 1.5 / seasonal span)."""
    need(y, 2 * period)
    ns = seasonal_span or period | 1
    nt = trend_span or next_odd(1.5 * period / max(1e-9, 1 - 1.5 / ns))
    nl = next_odd(period)
    rounds = (6 if robust else 0) if outer is None else outer
    n = len(y)
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    for k in range(rounds + 1):
        for _ in range(inner):
            rest = y - trend
            cycle = np.empty(n)
            for p in range(period):
                cycle[p::period] = smooth(rest[p::period], ns, weights[p::period])
            low = smooth(_average(_average(_average(cycle, period), period), 3), nl)
            season = cycle - low
            trend = smooth(y - season, nt, weights)
        if k < rounds:
            r = np.abs(y - trend - season)
            h = 6 * np.median(r)
            u = r / h if h > 1e-10 else np.zeros(n)
            weights = np.where(u < 1, (1 - u**2) ** 2, 0.0)
    return Parts(trend, {period: season}, y - trend - season)


def mstl(y: np.ndarray, periods: tuple[int, ...], iterations: int = 2, robust: bool = False) -> Parts:
    """Several periods, shortest first; each season from what the others leave,
    the trend from the longest."""
    periods = tuple(sorted({p for p in periods if p > 1}))
    if not periods:
        raise ValueError("no period")
    need(y, 2 * periods[-1])
    seasons = {p: np.zeros(len(y)) for p in periods}
    trend = np.zeros(len(y))
    for _ in range(iterations):
        for p in periods:
            rest = y - sum(s for q, s in seasons.items() if q != p)
            parts = stl(rest, p, robust=robust)
            seasons[p] = parts.seasonal[p]
            if p == periods[-1]:
                trend = parts.trend
    return Parts(trend, seasons, y - trend - sum(seasons.values()))
