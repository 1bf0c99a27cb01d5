"""The 30 forecasting models by name, and one way to call them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import arima as a
from . import smoothing as s
from . import structural as c
from . import theta as t
from .numeric import interval_z, ols
from .smoothing import Fit, TooShort


@dataclass(frozen=True)
class ModelSpec:
    """A model: its kernel (series, horizon, options -> Fit), default options, and
    whether it takes regressors or a period. ``batch`` does the kernel's work for
    many series of one length (matrix, options -> whether each is long enough,
    its forecast, the same for every step, and the variance)."""

    kernel: Callable[..., Fit]
    options: dict = field(default_factory=dict)
    exog: bool = False
    period: str | None = None
    batch: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def with_options(self, **options) -> ModelSpec:
        return ModelSpec(self.kernel, {**self.options, **options}, self.exog, self.period, self.batch)

    def batched(self) -> bool:
        """Whether the work can be done for many series at once."""
        return self.batch is not None and all(v is not None for v in self.options.values())

    def with_period(self, period: int) -> ModelSpec:
        return self if self.period is None else self.with_options(**{self.period: (period,) if self.period == "periods" else period})


MODELS: dict[str, ModelSpec] = {
    "naive": ModelSpec(s.naive, exog=True), "random_walk_with_drift": ModelSpec(s.drift), "seasonal_naive": ModelSpec(s.seasonal_naive, period="period"),
    "seasonal_window_average": ModelSpec(s.seasonal_window_average, period="period"), "simple_moving_average": ModelSpec(s.moving_average, {"window": 0}),
    "historic_average": ModelSpec(s.historic_average), "window_average": ModelSpec(s.window_average),
    "ses": ModelSpec(s.ses), "holt": ModelSpec(s.holt), "holt_winters": ModelSpec(s.holt_winters, period="period"), "seasonal_es": ModelSpec(s.seasonal_es, period="period"),
    "ets": ModelSpec(s.ets, period="period"), "auto_ets": ModelSpec(s.auto_ets, period="period"),
    "arima": ModelSpec(a.arima, exog=True), "sarima": ModelSpec(a.sarima, {"seasonal": (1, 0, 1)}, True, "period"), "auto_arima": ModelSpec(a.auto_arima, exog=True, period="period"),
    "theta": ModelSpec(t.theta, exog=True, period="period"), "optimized_theta": ModelSpec(t.optimized_theta, exog=True, period="period"),
    "dynamic_theta": ModelSpec(t.dynamic_theta, exog=True, period="period"), "dynamic_optimized_theta": ModelSpec(t.dynamic_optimized_theta, exog=True, period="period"),
    "auto_theta": ModelSpec(t.auto_theta, exog=True, period="period"),
    "croston": ModelSpec(s.croston, batch=s.croston_batch), "croston_sba": ModelSpec(s.croston, {"variant": "sba"}, batch=s.croston_batch), "tsb": ModelSpec(s.tsb, batch=s.tsb_batch),
    "adida": ModelSpec(s.adida, batch=s.adida_batch), "imapa": ModelSpec(s.imapa, batch=s.imapa_batch),
    "mfles": ModelSpec(c.mfles, exog=True, period="periods"), "mstl": ModelSpec(c.mstl_forecaster, period="periods"),
    "tbats": ModelSpec(c.tbats, period="periods"), "auto_tbats": ModelSpec(c.auto_tbats, period="periods"), "garch": ModelSpec(c.garch),
}


@dataclass
class Outcome:
    """A fit with bounds, or why there is none."""

    status: str
    fit: Fit | None = None
    lower: np.ndarray | None = None
    upper: np.ndarray | None = None


def run(spec: ModelSpec, y: np.ndarray, h: int, level: float = 0.95, x: np.ndarray | None = None, future: np.ndarray | None = None) -> Outcome:
    """Fit and forecast one series; trouble becomes a status, not an exception.

    Regressors are taken out by least squares first and put back into fits and
    forecasts, so everything is on the scale of y.
    """
    if not len(y):
        return Outcome("empty")
    if not np.isfinite(y).all():
        return Outcome("missing_values")
    part = ahead = None
    if x is not None and x.size:
        if not spec.exog:
            return Outcome("regressors_unsupported")
        if future is None or future.shape != (h, x.shape[1]) or not np.isfinite(x).all() or not np.isfinite(future).all():
            return Outcome("bad_regressors")
        beta = ols(x, y)
        part, ahead = x @ beta[1:], future @ beta[1:]
        y = y - part
    try:
        fit = spec.kernel(y, h, **spec.options)
    except TooShort:
        return Outcome("insufficient_data")
    except (ValueError, OverflowError, ZeroDivisionError, FloatingPointError, np.linalg.LinAlgError) as why:
        return Outcome(f"failed: {why}"[:200])
    z = interval_z(level)
    if "bounds" in fit.info:
        lower, upper = fit.info["bounds"](z)
    else:
        half = z * np.sqrt(np.maximum(fit.variance, 0.0))
        lower, upper = fit.point - half, fit.point + half
    if part is not None:
        fit.fitted, fit.point, lower, upper = fit.fitted + part, fit.point + ahead, lower + ahead, upper + ahead
    return Outcome("ok", fit, lower, upper)
