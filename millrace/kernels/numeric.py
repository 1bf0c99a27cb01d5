"""Numerical helpers of the kernels: optimiser, quantiles, least squares, ACF."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np


def nelder_mead(f: Callable[[list[float]], float], start: Sequence[float], bounds: Sequence[tuple[float, float]] | None = None, iterations: int = 1000, tol: float = 1e-8) -> tuple[list[float], float]:
    """Downhill simplex with reflection 1, expansion 2, contraction and shrinkage
    one half, first steps of 5 % (0.05 from zero); points are clamped to bounds.
    It ends when the simplex's values agree within ``tol``, relative to their size."""
    n = len(start)

    def clamp(x: list[float]) -> list[float]:
        return x if bounds is None else [min(max(v, lo), hi) for v, (lo, hi) in zip(x, bounds, strict=True)]

    def value(x: list[float]) -> float:
        v = f(x)
        return v if math.isfinite(v) else 1e300

    points = [clamp(list(start))]
    for i in range(n):
        x = list(points[0])
        x[i] += 0.05 * x[i] if x[i] else 0.05
        points.append(clamp(x))
    simplex = sorted(((value(x), k, x) for k, x in enumerate(points)), key=lambda t: t[:2])
    for _ in range(iterations):
        best, worst = simplex[0], simplex[-1]
        if abs(worst[0] - best[0]) < tol * (1 + abs(best[0])):
            break
        center = [sum(s[2][i] for s in simplex[:-1]) / n for i in range(n)]

        def along(t: float, center: list[float] = center, worst: tuple = worst) -> tuple[float, int, list[float]]:
            x = clamp([c + t * (c - w) for c, w in zip(center, worst[2], strict=True)])
            return value(x), n, x

        r = along(1.0)
        if r[0] < best[0]:
            e = along(2.0)
            simplex[-1] = e if e[0] < r[0] else r
        elif r[0] < simplex[-2][0]:
            simplex[-1] = r
        else:
            c = along(0.5) if r[0] < worst[0] else along(-0.5)
            if c[0] < min(r[0], worst[0]):
                simplex[-1] = c
            else:
                moved = [[b + 0.5 * (v - b) for b, v in zip(best[2], s[2], strict=True)] for s in simplex[1:]]
                simplex = [best, *((value(clamp(x)), n, clamp(x)) for x in moved)]
        simplex.sort(key=lambda t: t[0])
    return simplex[0][2], simplex[0][0]


def normal_quantile(p: float) -> float:
    """Rational approximation of the standard normal quantile (error under 4.5e-4)."""
    if not 0 < p < 1:
        return math.nan
    if p == 0.5:
        return 0.0
    tail = p if p < 0.5 else 1 - p
    t = math.sqrt(-2 * math.log(tail))
    # fixed values: numerator and denominator of the published approximation
    num = 2.515517 + 0.802853 * t + 0.010328 * t * t
    den = 1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3
    z = t - num / den
    return -z if p < 0.5 else z


def interval_z(level: float) -> float:
    """Half width, in standard deviations, of a central interval (level 0..1 or percent)."""
    level = level / 100 if level > 1 else level
    return normal_quantile((1 + level) / 2)


def ols(x: np.ndarray, y: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """Intercept and coefficients by normal equations with a small ridge."""
    a = np.column_stack([np.ones(len(y)), x]) if x.size else np.ones((len(y), 1))
    return np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ y)


def biased_acf(y: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelations 0..lags, divisor n."""
    d = y - y.mean()
    c0 = float(d @ d)
    if c0 < 1e-10:
        return np.concatenate(([1.0], np.zeros(lags)))
    return np.array([1.0] + [float(d[k:] @ d[:-k]) / c0 if k < len(d) else 0.0 for k in range(1, lags + 1)])


def line(y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope over positions 0, 1, ..."""
    n = len(y)
    if n < 2:
        return (float(y[0]) if n else 0.0), 0.0
    t = np.arange(n) - (n - 1) / 2
    slope = float(t @ y / (t @ t))
    return float(y.mean() - slope * (n - 1) / 2), slope


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(500):
            k += 1
            term *= x / k
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_upper(x: float, df: int) -> float:
    """Upper tail of chi-squared; Wilson-Hilferty beyond 30 degrees of freedom."""
    if x <= 0:
        return 1.0
    if df > 30:
        k = 2 / (9 * df)
        return normal_upper(((x / df) ** (1 / 3) - (1 - k)) / math.sqrt(k))
    return gamma_upper(df / 2, x / 2)


def next_odd(x: float) -> int:
    n = math.ceil(x)
    return n if n % 2 else n + 1


def boxcox_lambda(y: np.ndarray) -> float:
    """Lambda of the best profile likelihood: grid -2..2 by 0.01, then +-0.1 in 101 steps."""
    x = y[y > 0]
    if not len(x):
        return 1.0
    logs = np.log(x)

    def best(grid: np.ndarray) -> float:
        v = np.array([(logs if abs(g) < 1e-10 else (x**g - 1) / g).var() for g in grid])
        return float(grid[np.argmax(-len(x) / 2 * np.log(np.maximum(v, 1e-300)) + (grid - 1) * logs.sum())])

    return best(best(np.arange(-200, 201) / 100) - 0.1 + np.arange(101) * 0.002)
