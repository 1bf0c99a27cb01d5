"""The series contract and core operators: rows of (keys, time, value).

A frame holds many series at once; a series is the rows of one key. Missing
values are NULL: NaN and infinities become NULL on input. Every operator takes
a frame and a :class:`Series` that names its columns, and keeps other columns
only where it says so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """Names of the columns that make up series."""

    keys: tuple[str, ...] = ("key",)
    ts: str = "ds"
    value: str = "y"
    regressors: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(self.keys) if not isinstance(self.keys, str) else (self.keys,))

    def by_time(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def with_value(self, value: str) -> Series:
        return replace(self, value=value)


def cleaned(value: Column) -> Column:
    """The value as a double, NULL where it is NaN or infinite."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def prepare(df: DataFrame, s: Series, extra: tuple[str, ...] = ()) -> DataFrame:
    """Keys, ``ds``, ``y``, ``i`` (position from 0), ``n`` (length) and ``extra``.

    One exchange and one sort by (keys, time), which every later window over
    the same keys reuses.
    """
    w = Window.partitionBy(*s.keys).orderBy("ds")
    out = df.select(*s.keys, F.col(s.ts).alias("ds"), cleaned(F.col(s.value)).alias("y"), *s.regressors, *extra)
    return out.withColumn("i", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*s.keys)))


def validate(df: DataFrame, s: Series) -> DataFrame:
    """Rows that break the contract, with ``problem``: null_time, repeated_time or null_key."""
    prev = F.lag(s.ts).over(s.by_time())
    problem = (
        F.when(F.array_contains(F.array(*(F.col(k).isNull() for k in s.keys)), True), "null_key")
        .when(F.col(s.ts).isNull(), "null_time").when(F.col(s.ts) == prev, "repeated_time"))
    return df.withColumn("problem", problem).where("problem is not null")


def has_missing(df: DataFrame, s: Series) -> DataFrame:
    """Keys and ``has_missing``: any NULL, NaN or infinite value."""
    return df.groupBy(*s.keys).agg(F.bool_or(cleaned(F.col(s.value)).isNull()).alias("has_missing"))


def sanitize(df: DataFrame, s: Series, policy: str = "drop", fill: float = 0.0) -> DataFrame:
    """Deal with missing values in the value column (and, for ``drop``, in the
    regressors): ``drop`` the row, ``fill`` with a number, ``forward`` fill
    (gaps at the start stay) or ``error``."""
    y = cleaned(F.col(s.value))
    if policy == "drop":
        ok = y.isNotNull()
        for r in s.regressors:
            ok = ok & cleaned(F.col(r)).isNotNull()
        return df.where(ok)
    if policy == "fill":
        return df.withColumn(s.value, F.coalesce(y, F.lit(float(fill))))
    if policy == "forward":
        w = s.by_time().rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(s.value, F.last(y, ignorenulls=True).over(w))
    if policy == "error":
        return df.withColumn(s.value, F.when(y.isNull(), F.raise_error(F.lit("missing value"))).otherwise(y))
    raise ValueError(f"unknown policy {policy}")


def interpolate(df: DataFrame, s: Series, fill_edges: bool = False) -> DataFrame:
    """Fill inner gaps linearly by position (not by time); edges only if asked,
    with the nearest value."""
    before = s.by_time().rowsBetween(Window.unboundedPreceding, 0)
    after = s.by_time().rowsBetween(0, Window.unboundedFollowing)
    x = df.withColumn("__y", cleaned(F.col(s.value))).withColumn("__i", F.row_number().over(s.by_time()))
    at = F.when(F.col("__y").isNotNull(), F.struct("__i", "__y"))
    x = x.withColumn("__a", F.last(at, ignorenulls=True).over(before)).withColumn("__b", F.first(at, ignorenulls=True).over(after))
    a, b = F.col("__a"), F.col("__b")
    inner = a["__y"] + (F.col("__i") - a["__i"]) / F.nullif(b["__i"] - a["__i"], F.lit(0)) * (b["__y"] - a["__y"])
    edge = F.coalesce(b["__y"], a["__y"]) if fill_edges else F.lit(None).cast("double")
    y = F.when(F.col("__y").isNotNull(), F.col("__y")).when(a.isNotNull() & b.isNotNull(), inner).otherwise(edge)
    return x.withColumn(s.value, y).drop("__y", "__i", "__a", "__b")


_UNITS = {  # fixed values: unit names of frequency strings
    "s": ("s", "sec", "secs", "second", "seconds"), "m": ("m", "min", "mins", "minute", "minutes"), "h": ("h", "hr", "hrs", "hour", "hours"),
    "d": ("d", "day", "days"), "w": ("w", "wk", "week", "weeks"), "mo": ("mo", "mon", "month", "months"), "q": ("q", "quarter", "quarters"), "y": ("y", "yr", "year", "years"),
}
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_MONTHS = {"mo": 1, "q": 3, "y": 12}


@dataclass(frozen=True)
class Frequency:
    """A step of ``seconds`` or of ``months``, one of which is 0."""

    seconds: int = 0
    months: int = 0


def parse_frequency(text: str | int) -> Frequency:
    """``30m``, ``1h``, ``1d``, ``1w``, ``1mo``, ``1q``, ``1y`` and long forms; the
    number is mandatory, and an integer alone is seconds."""
    if isinstance(text, int):
        if text <= 0:
            raise ValueError("a step must be positive")
        return Frequency(seconds=text)
    m = re.fullmatch(r"\s*([0-9]+)\s*([A-Za-z]+)\s*", text)
    if not m or int(m[1]) == 0:
        raise ValueError(f"no frequency: {text!r}")
    unit = next((u for u, names in _UNITS.items() if m[2].lower() in names), None)
    if unit is None:
        raise ValueError(f"unknown unit {m[2]!r}")
    n = int(m[1])
    return Frequency(seconds=n * _SECONDS[unit]) if unit in _SECONDS else Frequency(months=n * _MONTHS[unit])


def infer_frequency(df: DataFrame, s: Series, tolerance: float = 0.5, holidays: DataFrame | None = None, business_days: bool = False) -> DataFrame:
    """Keys, ``step_seconds`` (the modal gap, the smallest on ties), ``share`` of
    gaps that agree and ``status`` (``ok``, ``irregular`` below the tolerance,
    ``insufficient_data`` under two rows).

    With ``business_days``, weekends and the dates in ``holidays`` (column
    ``holiday``) are left out first.
    """
    rows = df.where(is_business_day(F.col(s.ts))) if business_days else df
    if business_days and holidays is not None:
        rows = rows.join(holidays.select(F.col("holiday").cast("date").alias("__h")), F.to_date(s.ts) == F.col("__h"), "left_anti")
    seconds = F.unix_timestamp(F.col(s.ts).cast("timestamp"))
    gap = rows.select(*s.keys, (seconds - F.lag(seconds).over(s.by_time())).alias("gap"))
    counts = gap.where("gap is not null").groupBy(*s.keys, "gap").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(*s.keys).agg(F.max_by("gap", F.struct(F.col("c"), -F.col("gap"))).alias("step_seconds"), F.max("c").alias("c"), F.sum("c").alias("t"))
    out = df.select(*s.keys).distinct().join(best, list(s.keys), "left")
    share = F.col("c") / F.col("t")
    return out.select(*s.keys, "step_seconds", share.alias("share"), F.when(F.col("t").isNull(), "insufficient_data").when(share < tolerance, "irregular").otherwise("ok").alias("status"))


def _month_steps(first: Column, last: Column, months: int) -> Column:
    """Steps of whole months from ``first`` on, each from the one before: once a
    short month has cut the day, it stays cut."""
    n = F.floor(F.months_between(last, first) / months) + 1
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int")))
    grown = F.aggregate(steps, F.array(first), lambda acc, _: F.array_append(acc, F.add_months(F.element_at(acc, -1), months).cast("timestamp")))
    return F.filter(grown, lambda t: t <= last)


#: Grid points that are made at once.
_GRID = 10_000


def fill_gaps(df: DataFrame, s: Series, frequency: str | int | Frequency) -> DataFrame:
    """Keys, time and value on the regular grid from each series' first to last
    row; grid points without a row get NULL, rows off the grid are left out.

    A grid of seconds is made ``_GRID`` points at a time, so that its length
    costs no memory; one of months is an array of a series' months.
    """
    f = frequency if isinstance(frequency, Frequency) else parse_frequency(frequency)
    ts = F.col(s.ts).cast("timestamp")
    ends = df.groupBy(*s.keys).agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    if f.seconds:
        step = f.seconds * 1_000_000
        sized = ends.where("__first is not null").withColumn("__n", F.expr(f"(unix_micros(__last) - unix_micros(__first)) div {step}"))
        blocks = sized.withColumn("__b", F.explode(F.expr(f"sequence(0L, __n div {_GRID})")))
        points = blocks.withColumn("__i", F.explode(F.expr(f"sequence(__b * {_GRID}, least(__n, __b * {_GRID} + {_GRID - 1}))")))
        steps = points.select(*s.keys, F.timestamp_micros(F.unix_micros("__first") + F.col("__i") * step).alias(s.ts))
    else:
        steps = ends.select(*s.keys, F.explode(_month_steps(F.col("__first"), F.col("__last"), f.months)).alias(s.ts))
    rows = df.select(*s.keys, ts.alias(s.ts), cleaned(F.col(s.value)).alias(s.value), *s.regressors)
    return steps.join(rows, [*s.keys, s.ts], "left")


def is_business_day(ts: Column) -> Column:
    """Monday to Friday."""
    return ~F.dayofweek(ts).isin(1, 7)


def calendar_flags(df: DataFrame, s: Series, holidays: DataFrame) -> DataFrame:
    """The frame with ``is_holiday`` and ``is_business_day`` (Monday to Friday,
    not a holiday); ``holidays`` has a column ``holiday``, at most a few
    thousand dates, which is checked before it is broadcast."""
    days = holidays.select(F.col("holiday").cast("date").alias("__h")).distinct()
    if days.limit(100_001).count() <= 100_000:
        days = F.broadcast(days)
    out = df.withColumn("__d", F.to_date(s.ts)).join(days, F.col("__d") == F.col("__h"), "left")
    return out.withColumn("is_holiday", F.col("__h").isNotNull()).withColumn("is_business_day", is_business_day(F.col("__d")) & F.col("__h").isNull()).drop("__d", "__h")


def slice_rows(df: DataFrame, s: Series, start: int, end: int) -> DataFrame:
    """Rows at positions ``start`` (from 0) up to, not including, ``end`` of each series."""
    if not 0 <= start <= end:
        raise ValueError("0 <= start <= end is needed")
    return df.withColumn("__i", F.row_number().over(s.by_time()) - 1).where(f"__i >= {start} and __i < {end}").drop("__i")


def to_long(df: DataFrame, ids: list[str], values: list[str], dim: str = "dim", value: str = "y") -> DataFrame:
    """Wide (a column per dimension) to long."""
    return df.unpivot(ids, values, dim, value)


def to_wide(df: DataFrame, ids: list[str], dim: str, value: str, dims: list[str]) -> DataFrame:
    """Long to wide; ``dims`` are listed, so no pass is needed to find them."""
    return df.groupBy(*ids).pivot(dim, dims).agg(F.first(value))
