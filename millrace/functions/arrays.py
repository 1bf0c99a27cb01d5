"""Vector operations on ordered arrays of doubles, and scalar functions, in the JVM.

Each takes and returns columns. Where an array is empty or a divisor is zero
the result is NULL (element-wise: a NULL element).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: inside a lambda an expression
    would be computed anew for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def sum_of_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def _spread(a: Column, less: int) -> Column:
    n = F.size(a)
    return _let(mean(a), lambda m: F.when(n > less, total(F.transform(a, lambda x: (x - m) * (x - m))) / F.nullif(n - less, F.lit(0))))


def variance(a: Column) -> Column:
    return _spread(a, 0)


def variance_sample(a: Column) -> Column:
    return _spread(a, 1)


def stddev(a: Column) -> Column:
    return F.sqrt(variance(a))


def maximum(a: Column) -> Column:
    return F.array_max(F.filter(a, lambda x: ~F.isnan(x)))


def minimum(a: Column) -> Column:
    return F.array_min(F.filter(a, lambda x: ~F.isnan(x)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def div(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, by: float | Column) -> Column:
    k = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(a, lambda x: x * k)


def zscore(a: Column) -> Column:
    """Less the mean, over the population deviation; 0 where that is under 1e-10."""
    both = F.struct(mean(a).alias("m"), stddev(a).alias("s"))
    return _let(both, lambda c: F.transform(a, lambda x: F.when(c["s"] < 1e-10, 0.0).otherwise(F.try_divide(x - c["m"], c["s"]))))


def minmax_normalize(a: Column) -> Column:
    ends = F.struct(minimum(a).alias("lo"), (maximum(a) - minimum(a)).alias("r"))
    return _let(ends, lambda c: F.transform(a, lambda x: F.when(c["r"] < 1e-10, 0.0).otherwise(F.try_divide(x - c["lo"], c["r"]))))


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2)


def autocorrelation(a: Column, lag: int) -> Column:
    """Biased: divisor n; 0 without variation."""
    n = F.size(a)

    def ratio(d: Column) -> Column:
        c0 = sum_of_squares(d)
        return F.when(c0 < 1e-10, 0.0).otherwise(F.try_divide(dot(F.slice(d, F.lit(1), n - lag), F.slice(d, F.lit(lag + 1), n - lag)), c0))

    return F.when(n > lag, _let(_let(mean(a), lambda m: F.transform(a, lambda x: x - m)), ratio))


def normal_quantile(p: Column) -> Column:
    """Rational approximation of the standard normal quantile; NULL outside 0..1."""
    q = F.when(p < 0.5, p).otherwise(1 - p)
    t = F.sqrt(-2 * F.ln(F.when((p > 0) & (p < 1), q)))
    # fixed values: numerator and denominator of the published approximation
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p == 0.5, 0.0).when(p < 0.5, -z).otherwise(z)


def erf(x: Column) -> Column:
    """Error function by a published polynomial (absolute error under 1.5e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-a * a)
    return F.signum(x) * y


def period_of_frequency(k: Column, n: Column) -> Column:
    """Whole period of frequency ``k`` of ``n`` values; NULL for 0."""
    return F.floor(n / F.nullif(k, F.lit(0))).cast("long")


def frequency_of_period(period: Column, n: Column) -> Column:
    return F.floor(n / F.nullif(period, F.lit(0))).cast("long")
