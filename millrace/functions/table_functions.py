"""Table functions for SQL: polymorphic, row by row, in constant memory."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.series import Frequency, Series, parse_frequency

FILLS = ("null", "previous", "linear")
_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


def add_months(t: datetime, n: int) -> datetime:
    """``n`` months on; a day that the month does not have becomes its last."""
    months = t.year * 12 + t.month - 1 + n
    first = t.replace(year=months // 12, month=months % 12 + 1, day=1)
    upto = (first + timedelta(days=31)).replace(day=1) - timedelta(days=1)
    return first.replace(day=min(t.day, upto.day))


class Clock:
    """Times of a column type as numbers that a step can be added to."""

    def __init__(self, kind: str, step: Frequency, zone: str = "UTC"):
        self.kind, self.step, self.zone = kind, step, ZoneInfo(zone)

    def number(self, t) -> int:
        """Microseconds from 1970 on; a bigint counts seconds."""
        if self.kind == "bigint":
            return t * 1_000_000
        if self.kind == "timestamp":  # a naive local time, whose fold tells the hour that a change of clocks repeats
            return int(t.replace(microsecond=0).timestamp()) * 1_000_000 + t.microsecond
        if self.kind == "date":
            t = datetime(t.year, t.month, t.day)
        return (t - _EPOCH) // _MICRO

    def time(self, n: int):
        if self.kind == "bigint":
            return n // 1_000_000
        t = _EPOCH + timedelta(microseconds=n)
        return t.replace(tzinfo=UTC) if self.kind == "timestamp" else t.date() if self.kind == "date" else t

    def after(self, n: int) -> int:
        if self.step.seconds:
            return n + self.step.seconds * 1_000_000
        t = _EPOCH + timedelta(microseconds=n)
        if self.kind != "timestamp":
            return (add_months(t, self.step.months) - _EPOCH) // _MICRO
        there = add_months(t.replace(tzinfo=UTC).astimezone(self.zone), self.step.months).astimezone(UTC)
        return (there.replace(tzinfo=None) - _EPOCH) // _MICRO


@dataclass
class GridPlan(AnalyzeResult):
    """What the arguments say, checked once, for the tasks."""

    keys: tuple[str, ...] = ()
    time: str = ""
    value: str = ""
    fill: str = "null"
    clock: Clock | None = None


class RegularGrid:
    """``regular_grid(TABLE(t), keys => array('key'), time => 'ds', value => 'y',
    step => '1h', fill => 'linear', zone => 'UTC')``

    The keys, the time and the value (a double) of each series on the regular
    grid from its first row to its last. The function itself asks for rows by
    keys in order of time and value, so a caller cannot leave that out; it holds
    one point at a time, however long a series or a gap is. A series is one task:
    :func:`millrace.operators.series.fill_gaps` deals the grid of a long one out.

    Rows off the grid and rows without a time are left out; a series without any
    time gives no rows. Rows of one time are one point with the smallest value;
    null keys are a series of their own. NaN and infinities are null. Points without
    a value stay null, take the previous value (``previous``; null before the first) or lie on
    the line between their neighbours, by steps (``linear``; null at both ends).
    Other columns are dropped. Times are of type timestamp, timestamp_ntz, date
    (steps of whole days) or bigint (seconds; no months). ``zone`` says where months
    of timestamps begin and end; each step goes from the one before, so a day
    that a short month has cut stays cut.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, time: AnalyzeArgument, value: AnalyzeArgument, step: AnalyzeArgument,
                fill: AnalyzeArgument | None = None, zone: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument has to be TABLE(...)")
        for name, x in (("keys", keys), ("time", time), ("value", value), ("step", step), ("fill", fill), ("zone", zone)):
            if x is not None and (not x.isConstantExpression or x.value is None):
                raise ValueError(f"{name} has to be a constant")
        columns = {f.name: f.dataType for f in table.dataType.fields}
        names = [*keys.value, time.value, value.value]
        missing = [x for x in names if x not in columns]
        if missing or len(set(names)) < len(names):
            raise ValueError(f"no such columns: {missing}" if missing else f"columns named twice: {names}")
        kind, f = columns[time.value].simpleString(), parse_frequency(step.value)
        if kind not in ("timestamp", "timestamp_ntz", "date", "bigint"):
            raise ValueError(f"times of type {kind}")
        if kind == "date" and f.seconds % 86400 or kind == "bigint" and f.months:
            raise ValueError(f"a step of {step.value} does not suit times of type {kind}")
        if not isinstance(columns[value.value], T.NumericType):
            raise ValueError(f"values of type {columns[value.value].simpleString()}")
        fill, zone = "null" if fill is None else fill.value, "UTC" if zone is None else zone.value
        if fill not in FILLS:
            raise ValueError(f"fill is one of {', '.join(FILLS)}")
        schema = T.StructType([*(T.StructField(k, columns[k]) for k in keys.value), T.StructField(time.value, columns[time.value]), T.StructField(value.value, T.DoubleType())])
        return GridPlan(
            schema, withSinglePartition=not keys.value, partitionBy=[PartitioningColumn(_quoted(k)) for k in keys.value],
            orderBy=[OrderingColumn(_quoted(x)) for x in (time.value, value.value)],
            keys=tuple(keys.value), time=time.value, value=value.value, fill=fill, clock=Clock(kind, f, zone))

    def __init__(self, plan: GridPlan):
        self.plan, self.clock = plan, plan.clock
        self.at: int | None = None  # the point that rows are still being read for
        self.y: float | None = None
        self.last: float | None = None  # the last known value, and points without one since
        self.waiting = 0
        self.since = 0

    def eval(self, row: Row, *settings, **named) -> Iterator[tuple]:
        t, y = row[self.plan.time], row[self.plan.value]
        if t is None:
            return
        now = self.clock.number(t)
        if self.at is None:
            self.key, self.at = tuple(row[k] for k in self.plan.keys), now
        while (after := self.clock.after(self.at)) <= now:
            yield from self._point()
            self.at, self.y = after, None
        if now == self.at and self.y is None and y is not None and math.isfinite(y):
            self.y = float(y)

    def terminate(self) -> Iterator[tuple]:
        if self.at is not None:
            yield from self._point()
            yield from self._between(None)

    def _row(self, n: int, y: float | None) -> tuple:
        return (*self.key, self.clock.time(n), y)

    def _point(self) -> Iterator[tuple]:
        if self.y is None and self.plan.fill == "linear":
            self.since = self.since if self.waiting else self.at
            self.waiting += 1
            return
        yield from self._between(self.y)
        if self.y is not None:
            self.last = self.y
        yield self._row(self.at, self.last if self.plan.fill == "previous" else self.y)

    def _between(self, upto: float | None) -> Iterator[tuple]:
        """The points that wait for a value after them."""
        n, at = self.waiting, self.since
        known = self.last is not None and upto is not None
        for i in range(1, n + 1):
            yield self._row(at, self.last + (upto - self.last) * i / (n + 1) if known else None)
            at = self.clock.after(at)
        self.waiting = 0


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("regular_grid", F.udtf(RegularGrid, useArrow=False))


def regular_grid(df: DataFrame, s: Series, step: str, fill: str = "null", zone: str = "UTC") -> DataFrame:
    """:class:`RegularGrid` for a frame."""
    settings = {"keys": F.array(*map(F.lit, s.keys)), "time": F.lit(s.ts), "value": F.lit(s.value), "step": F.lit(step), "fill": F.lit(fill), "zone": F.lit(zone)}
    return F.udtf(RegularGrid, useArrow=False)(df.asTable(), **settings)
