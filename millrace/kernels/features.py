"""Features without a closed SQL form, over one series as a NumPy array."""

from __future__ import annotations

import math

import numpy as np


def undefined(x: float | None) -> float | None:
    """NaN and infinities as None."""
    return None if x is None or not math.isfinite(x) else float(x)


def unbiased_acf(y: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelations 0..lags with divisor n - k and population variance."""
    n, d = len(y), y - y.mean()
    var = d @ d / n
    if var < 1e-10:
        return np.concatenate(([1.0], np.zeros(lags)))
    return np.array([1.0] + [d[k:] @ d[:-k] / ((n - k) * var) for k in range(1, lags + 1)])


def levinson(r: np.ndarray) -> list[np.ndarray]:
    """Coefficients of every order 1..len(r)-1 from autocorrelations."""
    out, phi, err = [], np.zeros(0), 1.0
    for k in range(1, len(r)):
        if abs(err) < 1e-12:
            break
        a = (r[k] - phi @ r[k - 1:0:-1]) / err
        phi = np.append(phi - a * phi[::-1], a)
        err *= 1 - a * a
        out.append(phi)
    return out


def partial_autocorrelation(y: np.ndarray, lag: int = 1) -> float | None:
    if lag == 0:
        return 1.0
    if len(y) <= lag:
        return None
    phi = levinson(unbiased_acf(y, lag))
    return phi[lag - 1][-1] if len(phi) >= lag else 0.0


def fourier_entropy(y: np.ndarray) -> float | None:
    """Entropy of the power at frequencies 0..n/2-1, the mean's included."""
    n = len(y)
    if n < 4:
        return None
    power = np.abs(np.fft.rfft(y)[:n // 2]) ** 2 / n
    total = power.sum()
    if total < 1e-10:
        return 0.0
    p = power / total
    p = p[p > 1e-10]
    return float(-(p * np.log(p)).sum())


def lempel_ziv_complexity(y: np.ndarray, bins: int = 10) -> float | None:
    """Number of new phrases of an incremental parse of the series in ``bins``
    equal bins, over n; an unfinished last phrase does not count."""
    n = len(y)
    if n < 2 or bins == 0:
        return 0.0
    lo, hi = y.min(), y.max()
    if hi - lo < 1e-10:
        return 1.0 / n
    symbols = np.minimum(np.floor((y - lo) / ((hi - lo) / bins)).astype(int), bins - 1).tolist()
    seen: set[tuple[int, ...]] = set()
    phrase: tuple[int, ...] = ()
    for s in symbols:
        phrase = (*phrase, s)
        if phrase not in seen:
            seen.add(phrase)
            phrase = ()
    return len(seen) / n


def lempel_ziv_complexity_binary(y: np.ndarray) -> float | None:
    """Number of components of the series at or above its median, each the
    shortest not found in what precedes it, over n / log2 n. The first three
    values count as two components; an unfinished last one does not count."""
    n = len(y)
    if n < 2:
        return 0.0
    middle = np.median(y)
    s = "".join("1" if v >= middle else "0" for v in y)
    count, at = (2, 3) if n >= 3 else (1, n)
    while at < n:
        size = 1
        while at + size <= n and s[at:at + size] in s[:at]:
            size += 1
        if at + size > n:
            break
        count += 1
        at += size
    return count * math.log2(n) / n


def ar_coefficient(y: np.ndarray, k: int = 10, coeff: int = 1) -> float | None:
    """Least squares AR(k) with intercept (coefficient 0)."""
    n = len(y)
    if n - k < k + 2 or not 0 <= coeff <= k:
        return None
    x = np.column_stack([np.ones(n - k), *(y[k - j:n - j] for j in range(1, k + 1))])
    a = x.T @ x
    if np.linalg.matrix_rank(a) <= k:
        return None
    return float(np.linalg.solve(a, x.T @ y[k:])[coeff])


def ar_coefficient_yule_walker(y: np.ndarray, k: int = 2) -> float | None:
    """The last coefficient of order k from biased autocorrelations."""
    n = len(y)
    if n <= k or k == 0:
        return None
    d = y - y.mean()
    c0 = d @ d
    if c0 / n < 1e-10:
        return 0.0
    phi = levinson(np.array([1.0] + [d[j:] @ d[:-j] / c0 for j in range(1, k + 1)]))
    return phi[k - 1][-1] if len(phi) >= k else None
