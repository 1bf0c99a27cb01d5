"""Spectra and period detectors over one series. Results are lists of
(period, score), best first; ties go to the smaller period."""

from __future__ import annotations

import math

import numpy as np

from .numeric import biased_acf

Found = list[tuple[int, float]]


def periodogram(y: np.ndarray) -> Found:
    """(period, power) of every frequency but zero, longest period first. A
    period is the integer part of n over the frequency, so it may repeat."""
    n = len(y)
    if n < 2:
        return []
    power = np.abs(np.fft.rfft(y)) ** 2 / n
    return [(n // k, float(power[k])) for k in range(1, n // 2 + 1)]


def spectral_peaks(y: np.ndarray, threshold: float = 3.0, low: int = 2, high: int = 365) -> Found:
    """Periods in range whose power exceeds ``threshold`` times the median power there, strongest first."""
    inside = [(p, v) for p, v in periodogram(y) if low <= p <= high]
    if not inside:
        return []
    floor = float(np.median([v for _, v in inside])) * threshold
    return sorted((x for x in inside if x[1] > floor), key=lambda x: (-x[1], x[0]))


def welch(y: np.ndarray, window: int, overlap: float = 0.5) -> Found:
    """Mean power by period over Hann-windowed, overlapping segments."""
    if len(y) < window or window < 4:
        return periodogram(y)
    hop = max(1, math.ceil((1 - min(0.9, max(0.0, overlap))) * window))
    taper = 0.5 * (1 - np.cos(2 * np.pi * np.arange(window) / window))
    sums: dict[int, list[float]] = {}
    for s in range(0, len(y) - window + 1, hop):
        for p, v in periodogram(y[s:s + window] * taper):
            sums.setdefault(p, []).append(v)
    return sorted(((p, float(np.mean(v))) for p, v in sums.items()), reverse=True)


def _peaks(r: np.ndarray, low: int, high: int, least: float) -> Found:
    """Local maxima of an autocorrelation above ``least``, highest first."""
    out = [(k, float(r[k])) for k in range(max(1, low), min(len(r) - 1, high)) if r[k] > r[k - 1] and r[k] > r[k + 1] and r[k] > least]
    return sorted(out, key=lambda x: (-x[1], x[0]))


def _clip(found: Found) -> Found:
    return [(p, min(1.0, max(0.0, s))) for p, s in found]


def acf_detector(y: np.ndarray, low: int = 2, high: int = 365, threshold: float = 0.3) -> Found:
    """Autocorrelation peaks without multiples of stronger ones."""
    if len(y) < 2 * low:
        return []
    kept: Found = []
    for p, s in _peaks(biased_acf(y, min(high, len(y) // 2)), low, high, threshold):
        ratios = [p / q for q, _ in kept]
        if not any(abs(r - round(r)) < 0.1 and round(r) > 1 for r in ratios):
            kept.append((p, s))
    return _clip(kept)


def fft_detector(y: np.ndarray, low: int = 2, high: int = 365, threshold: float = 3.0) -> Found:
    """Spectral peaks, scored against the strongest."""
    if len(y) < 2 * low:
        return []
    found = spectral_peaks(y, threshold, low, high)
    return [(p, v / found[0][1]) for p, v in found] if found and found[0][1] > 0 else found


def autoperiod(y: np.ndarray, low: int = 2, high: int = 365, power: float = 3.0, acf: float = 0.2) -> Found:
    """Spectral hints that lie on, or within ten steps climb to, a hill of the
    autocorrelation; periods within one of a better one are dropped."""
    n = len(y)
    if n < 2 * low:
        return []
    r = biased_acf(y, n - 1)
    r = np.append(r, 0.0)
    got = []
    for hint, _ in spectral_peaks(y, power, low, high):
        if hint >= n or r[hint] < acf:
            continue
        at = hint
        if r[at] < r[at - 1] or r[at] < r[at + 1]:
            for _ in range(10):
                left = r[at - 1] if at > low else 0.0
                right = r[at + 1] if at < high and at + 1 < n // 2 else 0.0
                if left > r[at] and left > right:
                    at -= 1
                elif right > r[at]:
                    at += 1
                else:
                    break
        if r[at] >= acf:
            got.append((at, float(r[at])))
    kept: Found = []
    for p, s in sorted(got, key=lambda x: (-x[1], x[0])):
        if all(abs(p - q) > 1 for q, _ in kept):
            kept.append((p, s))
    return _clip(kept)


def cfd_autoperiod(y: np.ndarray, low: int = 2, high: int = 365, eps: float = 2.0, power: float = 2.0) -> Found:
    """Hints from the differenced series, clustered; centres checked on the original."""
    n = len(y)
    if n < 2 * low + 1:
        return []
    hints = sorted(p for p, _ in spectral_peaks(np.diff(y), power, low, high))
    clusters: list[list[int]] = []
    for p in hints:
        if clusters and p - clusters[-1][-1] <= eps:
            clusters[-1].append(p)
        else:
            clusters.append([p])
    r = biased_acf(y, n // 2)
    centres = [sum(c) // len(c) for c in clusters]
    return _clip(sorted(((p, float(r[p])) for p in centres if p < n // 2 and r[p] > 0.2), key=lambda x: (-x[1], x[0])))


def sazed(y: np.ndarray, low: int = 2, high: int = 365, tolerance: int = 1) -> Found:
    """A vote of the three strongest spectral and autocorrelation peaks, the mean
    peak, the mean distance of zero crossings, and each one's shorter divisors.

    Votes within ``tolerance`` of an earlier candidate count for it; of equal
    counts the smallest period wins.
    """
    n = len(y)
    if n < 2 * low:
        return []
    top = min(high, n // 2)
    r = biased_acf(y, top)
    names = [p for p, _ in spectral_peaks(y, 2.0, low, high)[:3]]
    names += [p for p, _ in _peaks(r, low, high, 0.2)[:3]]
    hills = _peaks(r, low, high, 0.0)
    if hills:
        names.append(int(math.floor(sum(p * s for p, s in hills) / sum(s for _, s in hills) + 0.5)))
    sign = r >= 0
    crossings = np.flatnonzero(sign[1:] != sign[:-1]) + 1
    if len(crossings) >= 2:
        names.append(int(math.floor(2 * float(np.diff(crossings).mean()) + 0.5)))
    names = [p for p in names if low <= p <= high]
    if not names:
        return []

    def shorter(p: int) -> int:
        best, value = p, float(r[p]) if p < len(r) else 0.0
        for k in range(2, 6):
            q = p // k
            if p % k == 0 and low <= q < len(r) and r[q] > 0.9 * value:
                best, value = q, float(r[q])
        return best

    votes: dict[int, int] = {}
    every = names + [shorter(p) for p in names]
    for p in every:
        near = next((q for q in votes if abs(p - q) <= tolerance), p)
        votes[near] = votes.get(near, 0) + 1
    first = min(votes, key=lambda p: (-votes[p], p))
    out = {first: votes[first] / len(every)}
    for p in names:
        if p not in out and p < len(r) and r[p] > 0.3:
            out[p] = min(1.0, float(r[p]))
    rest = sorted(((p, s) for p, s in out.items() if p != first), key=lambda x: (-x[1], x[0]))
    return [(first, out[first]), *rest]


def seasonality(y: np.ndarray, low: int = 2, high: int = 365, threshold: float = 0.3) -> Found:
    """Autocorrelation peaks strictly inside low..min(high, n/2)."""
    n = len(y)
    top = min(high, n // 2)
    if n < 2 * low or top <= low:
        return []
    return _clip(_peaks(biased_acf(y, top), low + 1, top, threshold))


DETECTORS = {"acf": acf_detector, "fft": fft_detector, "autoperiod": autoperiod, "cfd": cfd_autoperiod, "sazed": sazed, "seasonality": seasonality}
