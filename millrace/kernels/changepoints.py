"""Changepoints by pruned optimal partitioning under eight costs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


class Costs:
    """Costs of segments [s, t) of one series; sums give most of them at once."""

    def __init__(self, y: np.ndarray):
        self.y = y
        n = len(y)
        x = np.arange(n, dtype=float)

        def sums(v: np.ndarray) -> np.ndarray:
            return np.concatenate(([0.0], np.cumsum(v)))

        mean = y.mean() if n else 0.0
        self.mean, self.s, self.ss, self.sx = mean, sums(y - mean), sums((y - mean) ** 2), sums((y - mean) * x)

    def l2(self, s: int, t: int) -> float:
        n = t - s
        d = self.s[t] - self.s[s]
        return max(0.0, float(self.ss[t] - self.ss[s] - d * d / n)) if n else 0.0

    def l1(self, s: int, t: int) -> float:
        p = self.y[s:t]
        return float(np.abs(p - np.median(p)).sum()) if t > s else 0.0

    def normal(self, s: int, t: int) -> float:
        n = t - s
        v = self.l2(s, t) / n if n else 0.0
        return n * math.log(v) if n >= 2 and v >= 1e-10 else 0.0

    def mean_variance(self, s: int, t: int) -> float:
        n = t - s
        v = self.l2(s, t) / n if n else 0.0
        return n * (1 + math.log(v)) if n >= 2 and v >= 1e-10 else 0.0

    def poisson(self, s: int, t: int) -> float:
        total = float(self.s[t] - self.s[s]) + self.mean * (t - s)
        m = total / (t - s) if t > s else 0.0
        return total - total * math.log(m) if m >= 1e-10 else 0.0

    def linear_trend(self, s: int, t: int) -> float:
        n = t - s
        if n < 3:
            return 0.0
        syy = self.l2(s, t)
        d = self.s[t] - self.s[s]
        sxy = float(self.sx[t] - self.sx[s] - d * (s + t - 1) / 2)
        return max(0.0, syy - sxy * sxy * 12 / (n * (n * n - 1.0)))

    def cusum(self, s: int, t: int) -> float:
        p = self.y[s:t]
        return float(np.abs(np.cumsum(p - p.mean())).max()) if t > s else 0.0

    def periodicity(self, s: int, t: int) -> float:
        """The sum of squares less up to 90 % of the share of the three strongest frequencies."""
        base = self.l2(s, t)
        if t - s < 8:
            return base
        power = np.sort(np.abs(np.fft.rfft(self.y[s:t]))[1:] ** 2)[::-1]
        total = power.sum()
        return base * (1 - 0.9 * float(power[:3].sum() / total)) if total > 1e-10 else base


COSTS = ("l1", "l2", "normal", "poisson", "linear_trend", "mean_variance", "cusum", "periodicity")


def total_cost(y: np.ndarray, changes: list[int], cost: str = "l2") -> float:
    f = getattr(Costs(y), cost)
    bounds = [0, *changes, len(y)]
    return sum(f(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def pelt(y: np.ndarray, cost: str = "l2", penalty: float = 1.0, min_size: int = 2) -> tuple[list[int], float]:
    """Changepoints (starts of later segments) that minimise cost plus a penalty
    for each, and the cost without penalties; none in fewer than two segments' length."""
    n = len(y)
    if cost not in COSTS:
        raise ValueError(f"unknown cost {cost}")
    f: Callable[[int, int], float] = getattr(Costs(y), cost)
    if n < 2 * min_size:
        return [], f(0, n) if n else 0.0
    best, last = [math.inf] * (n + 1), [0] * (n + 1)
    best[0] = -penalty
    open_ = [0]
    for t in range(min_size, n + 1):
        values = [(s, best[s] + f(s, t)) for s in open_ if t - s >= min_size]
        if values:
            s, v = min(values, key=lambda x: (x[1], x[0]))
            best[t], last[t] = v + penalty, s
            dropped = {s for s, v in values if v > best[t]}
            open_ = [s for s in open_ if s not in dropped]
        open_.append(t)
    changes, t = [], n
    while t > 0:
        t = last[t]
        if t:
            changes.append(t)
    changes.reverse()
    return changes, total_cost(y, changes, cost)
