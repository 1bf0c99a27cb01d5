"""Periods of one series from standard input: ``python -m millrace --method autoperiod < values``."""

from __future__ import annotations

import argparse
import json
import math
import sys
from collections.abc import Iterable

import numpy as np

from .kernels.periods import DETECTORS

#: ``single`` and ``ensemble`` are the defaults that the detection operators use.
METHODS = {**DETECTORS, "single": DETECTORS["autoperiod"], "ensemble": DETECTORS["sazed"]}


def values(lines: Iterable[str]) -> np.ndarray:
    """One number a line; other lines, and numbers that are not finite, are left out."""
    out = []
    for line in lines:
        try:
            x = float(line)
        except ValueError:
            continue
        if math.isfinite(x):
            out.append(x)
    return np.array(out)


def signal(period: int, length: int, noise: float) -> np.ndarray:
    """A sine with reproducible noise, to try a detector on."""
    t = np.arange(length)
    return np.sin(2 * np.pi * t / period) + noise * np.random.default_rng(0).standard_normal(length)


def report(method: str, y: np.ndarray, low: int, high: int) -> dict:
    found = METHODS[method](y, low, high)
    return {"method": method, "n": len(y), "period": found[0][0] if found else None, "periods": [{"period": int(p), "score": float(s)} for p, s in found]}


def main(args: list[str] | None = None, lines: Iterable[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="millrace", description=__doc__)
    a.add_argument("--method", choices=sorted(METHODS), default="autoperiod")
    a.add_argument("--min-period", type=int, default=2)
    a.add_argument("--max-period", type=int, default=365)
    a.add_argument("--json", action="store_true")
    a.add_argument("--all-methods", action="store_true", help="every detector, as JSON")
    a.add_argument("--test", action="store_true", help="a sine instead of standard input")
    a.add_argument("--period", type=int, default=12)
    a.add_argument("--length", type=int, default=240)
    a.add_argument("--noise", type=float, default=0.0)
    o = a.parse_args(args)
    y = signal(o.period, o.length, o.noise) if o.test else values(sys.stdin if lines is None else lines)
    if not len(y):
        print("no values", file=sys.stderr)
        return 1
    reports = [report(m, y, o.min_period, o.max_period) for m in (sorted(DETECTORS) if o.all_methods else [o.method])]
    if o.json or o.all_methods:
        print(json.dumps(reports if o.all_methods else reports[0]))
        return 0
    for r in reports:
        print(f"{r['method']}: {r['period'] if r['period'] is not None else 'no period'} ({r['n']} values)")
        for x in r["periods"]:
            print(f"  {x['period']}\t{x['score']:.4f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
