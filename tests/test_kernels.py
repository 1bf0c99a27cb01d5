"""NumPy kernels against definitions, brute force and known cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.kernels import arima, changepoints, decompose, features, numeric, periods, registry, smoothing, structural, theta


def sine(n, m, noise=0.0, trend=0.0, seed=0):
    t = np.arange(n)
    return 50 + 10 * np.sin(2 * np.pi * t / m) + trend * t + np.random.default_rng(seed).normal(0, noise, n)


def test_nelder_mead():
    x, v = numeric.nelder_mead(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2, [0.0, 0.0], None, 2000, 1e-12)
    assert x == pytest.approx([3, -1], abs=1e-3) and v < 1e-5
    x, _ = numeric.nelder_mead(lambda p: (p[0] - 3) ** 2, [0.5], [(0, 1)], 500)
    assert x == pytest.approx([1.0], abs=1e-3)


def test_quantiles_and_tails():
    for p, z in ((0.975, 1.959964), (0.9, 1.281552), (0.5, 0.0), (0.05, -1.644854)):
        assert numeric.normal_quantile(p) == pytest.approx(z, abs=5e-4)
    assert numeric.interval_z(0.95) == numeric.interval_z(95)
    for k in (2, 4, 10):
        for x in (0.5, 3.0, 12.0, 40.0):
            want = math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(k // 2))
            assert numeric.chi2_upper(x, k) == pytest.approx(want, rel=1e-10)
    assert numeric.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert numeric.chi2_upper(50.0, 40) == pytest.approx(0.1336, abs=2e-3)


def test_fourier_entropy_by_definition():
    y = np.random.default_rng(1).integers(0, 4, 60).astype(float)
    power = [abs(sum(y * np.exp(-2j * np.pi * k * np.arange(60) / 60))) ** 2 for k in range(30)]
    p = np.array(power) / sum(power)
    assert features.fourier_entropy(y) == pytest.approx(-sum(v * math.log(v) for v in p if v > 1e-10))


def test_parses():
    assert features.lempel_ziv_complexity(np.array([0.0, 0, 1, 1, 0, 1, 0, 0]), 2) == 4 / 8  # 0 | 01 | 1 | 010 | (0)
    assert features.lempel_ziv_complexity(np.ones(5)) == 1 / 5
    assert features.lempel_ziv_complexity(np.ones(1)) == 0
    assert features.lempel_ziv_complexity_binary(np.ones(1)) == 0
    assert features.lempel_ziv_complexity_binary(np.arange(64.0)) < features.lempel_ziv_complexity_binary(np.random.default_rng(0).normal(size=64))


def test_autoregressions():
    rng = np.random.default_rng(2)
    y = np.zeros(3000)
    for t in range(2, 3000):
        y[t] = 0.5 * y[t - 1] - 0.3 * y[t - 2] + rng.normal()
    assert features.ar_coefficient(y, 2, 1) == pytest.approx(0.5, abs=0.05)
    assert features.ar_coefficient(y, 2, 2) == pytest.approx(-0.3, abs=0.05)
    assert features.ar_coefficient_yule_walker(y, 2) == pytest.approx(-0.3, abs=0.05)
    assert features.partial_autocorrelation(y, 3) == pytest.approx(0, abs=0.06)
    assert features.ar_coefficient(np.ones(50), 2, 1) is None and features.ar_coefficient(y[:5], 2, 1) is None
    fit = arima.sarima(y[:600], 5, (2, 0, 0))
    assert fit.info["coefficients"][1:] == pytest.approx([0.5, -0.3], abs=0.1)


def test_baselines_by_hand():
    y = np.array([1.0, 3, 2, 5, 4, 6, 8])
    assert smoothing.naive(y, 2).point.tolist() == [8, 8]
    assert smoothing.naive(y, 2).variance[1] == pytest.approx(2 * np.mean(np.diff(y) ** 2))
    assert smoothing.drift(y, 2).point == pytest.approx([8 + 7 / 6, 8 + 14 / 6])
    assert smoothing.seasonal_naive(y, 5, 3).point.tolist() == [4, 6, 8, 4, 6]
    assert smoothing.seasonal_naive(y, 5, 3).variance[3] == pytest.approx(2 * smoothing.seasonal_naive(y, 5, 3).variance[0])
    assert smoothing.seasonal_window_average(y, 3, 3, 2).point == pytest.approx([3.5, 4, 6.5])
    assert smoothing.moving_average(y, 1, 3).point == pytest.approx([6])
    f, level = smoothing.ses_path(y, 0.5)
    assert f[:3].tolist() == [1, 1, 2] and level == pytest.approx(0.5 * 8 + 0.5 * f[-1])
    with pytest.raises(smoothing.TooShort):
        smoothing.seasonal_naive(y, 1, 8)


def test_croston_by_hand():
    y = np.array([0.0, 2, 0, 0, 4, 0])
    size, gap = 0.1 * 4 + 0.9 * 2, 0.1 * 3 + 0.9 * 2
    assert smoothing.croston(y, 1).point[0] == pytest.approx(size / gap)
    assert smoothing.croston(y, 1, "sba").point[0] == pytest.approx(0.95 * size / gap)
    assert smoothing.tsb(np.zeros(5), 2).point.tolist() == [0, 0]
    assert smoothing.imapa(np.tile([0.0, 0, 3], 10), 1).point[0] == pytest.approx(1, abs=0.6)


def test_smoothing_finds_structure():
    y = 3 + 2.0 * np.arange(60)
    assert smoothing.holt(y, 3).point == pytest.approx([123, 125, 127], rel=1e-3)
    s = sine(96, 12, 0.1, 0.2)
    future = 50 + 10 * np.sin(2 * np.pi * np.arange(96, 108) / 12) + 0.2 * np.arange(96, 108)
    for fit in (smoothing.holt_winters(s, 12, 12), smoothing.ets(s, 12, "AAA", 12), theta.optimized_theta(s, 12, 12), structural.mfles(s, 12, (12,)), structural.tbats(s, 12, (12,)),
                structural.mstl_forecaster(s, 12, (12,)), arima.auto_arima(s, 12, 12, search="grid")):
        assert np.abs(fit.point - future).mean() < 5, fit.info
    assert len(smoothing.ets_specs()) == 18


def test_differences_invert():
    y = np.cumsum(np.cumsum(np.random.default_rng(3).normal(size=80)))
    fit = arima.sarima(y, 4, (0, 2, 0))
    c = fit.info["coefficients"][0]
    want, a, b = [], y[-1], y[-1] - y[-2]
    for _ in range(4):
        b += c
        a += b
        want.append(a)
    assert fit.point == pytest.approx(want)
    s = np.tile([1.0, 5, 2, 8], 10) + np.repeat(np.arange(10.0), 4)
    assert arima.sarima(s, 4, (0, 0, 0), (0, 1, 0), 4).point == pytest.approx(s[-4:] + 1, abs=1e-6)


def test_decomposition():
    y = sine(120, 12, 0.5, 0.3)
    for p in (decompose.stl(y, 12), decompose.stl(y, 12, robust=True), decompose.mstl(y, (12, 4))):
        assert p.trend + p.season + p.remainder == pytest.approx(y)
        assert p.seasonal_strength() > 0.8 and p.trend_strength() > 0.8
    with pytest.raises(smoothing.TooShort):
        decompose.stl(y[:20], 12)


@pytest.mark.parametrize("cost", changepoints.COSTS)
def test_costs_and_partition(cost):
    rng = np.random.default_rng(4)
    y = np.concatenate((rng.poisson(3, 8), rng.poisson(9, 7))).astype(float) + 0.5
    f = getattr(changepoints.Costs(y), cost)
    best = min((f(0, a) + f(a, b) + f(b, 15) + 6.0, [a, b]) if b else (f(0, a) + f(a, 15) + 3.0, [a]) if a else (f(0, 15), []) for a, b in
               [(0, 0), *((a, 0) for a in range(2, 14)), *((a, b) for a in range(2, 12) for b in range(a + 2, 14))])
    changes, total = changepoints.pelt(y, cost, 3.0, 2)
    if len(changes) <= 2 and cost not in ("cusum", "periodicity"):  # pruning is exact for additive costs
        assert total + 3.0 * len(changes) <= best[0] + 1e-9
    assert total == pytest.approx(changepoints.total_cost(y, changes, cost))


def test_pelt_finds_break():
    y = np.concatenate((np.full(50, 50.0), np.full(50, 70.0))) + np.random.default_rng(5).normal(0, 1, 100)
    assert changepoints.pelt(y, "l2", 50.0)[0] == [50]
    assert changepoints.pelt(np.ones(3), "l2")[0] == []
    c = changepoints.Costs(y)
    s = y[10:60]
    assert c.l2(10, 60) == pytest.approx(((s - s.mean()) ** 2).sum())
    a, b = np.polyfit(np.arange(50), s, 1)
    assert c.linear_trend(10, 60) == pytest.approx(((s - b - a * np.arange(50)) ** 2).sum())
    assert c.poisson(10, 60) == pytest.approx(s.sum() - s.sum() * math.log(s.mean()))


@pytest.mark.parametrize("method", list(periods.DETECTORS))
@pytest.mark.parametrize("m", [7, 12, 30])
def test_detectors(method, m):
    found = periods.DETECTORS[method](sine(20 * m, m, 0.0 if method == "cfd" else 0.5), 2, 365)
    # differencing shortens the series, so its spectrum leaks and multiples of the period survive
    assert found and any(abs(p - k * m) <= 1 for p, _ in found[:1] for k in range(1, 2 if method != "cfd" else 20))
    assert periods.DETECTORS[method](np.ones(100)) == [] or method == "sazed"
    assert periods.DETECTORS[method](np.ones(1)) == []


def test_garch():
    rng = np.random.default_rng(6)
    v, y = 1.0, []
    for _ in range(1500):
        y.append(math.sqrt(v) * rng.normal())
        v = 0.1 + 0.15 * y[-1] ** 2 + 0.75 * v
    fit = structural.garch(np.array(y), 200)
    assert fit.info["stationary"] and fit.info["alpha"][0] + fit.info["beta"][0] == pytest.approx(0.9, abs=0.12)
    assert fit.variance[-1] == pytest.approx(fit.info["unconditional"], rel=0.1)


FAST = [m for m in registry.MODELS if not m.startswith("auto_") and m not in ("tbats", "mstl", "garch", "sarima")]
values = st.lists(st.floats(1, 1000), min_size=40, max_size=60)


@pytest.mark.parametrize("model", FAST)
@settings(max_examples=4, deadline=None)
@given(y=values)
def test_properties(model, y):
    """Length, finiteness, ordered bounds, and the same answer twice."""
    y = np.array(y)
    spec = registry.MODELS[model].with_period(12)
    a, b = registry.run(spec, y, 5), registry.run(spec, y, 5)
    assert a.status == "ok" and len(a.fit.point) == len(a.lower) == 5 and len(a.fit.fitted) == len(y)
    assert np.isfinite(a.fit.point).all() and (a.lower <= a.fit.point + 1e-9).all() and (a.fit.point <= a.upper + 1e-9).all()
    assert np.array_equal(a.fit.point, b.fit.point)


@pytest.mark.parametrize("model", [m for m in registry.MODELS if m not in ("garch",)])
def test_constant_in_constant_out(model):
    out = registry.run(registry.MODELS[model].with_period(4), np.full(40, 7.0), 6)
    assert out.status == "ok", out.status
    assert out.fit.point == pytest.approx(np.full(6, 7.0), rel=0.06)


def test_statuses():
    assert registry.run(registry.MODELS["seasonal_naive"], np.ones(3), 2).status == "insufficient_data"
    assert registry.run(registry.MODELS["naive"], np.array([1.0, np.nan]), 2).status == "missing_values"
    assert registry.run(registry.MODELS["naive"], np.zeros(0), 2).status == "empty"
    assert registry.run(registry.MODELS["ses"], np.ones(5), 2, x=np.ones((5, 1)), future=np.ones((2, 1))).status == "regressors_unsupported"
    assert registry.run(registry.MODELS["naive"], np.ones(5), 2, x=np.ones((5, 1)), future=np.ones((1, 1))).status == "bad_regressors"
    x = np.arange(50.0)[:, None]
    out = registry.run(registry.MODELS["naive"], 5 + 3 * x[:, 0], 2, x=x, future=np.array([[50.0], [51.0]]))
    assert out.fit.point == pytest.approx([155, 158], rel=1e-6)
