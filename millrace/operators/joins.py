"""As-of and interval joins of keyed tables, without a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ROWS, _cell, cell_width, micros

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_ts: str, right_ts: str, values: tuple[str, ...], direction: str = "backward",
              tolerance: int | None = None, exact: bool = True, prefix: str = "", rows: int = ROWS, width: int | None = None) -> DataFrame:
    """Every row of ``left``, with the time and ``values`` of the row of
    ``right`` with the same keys that is last before it (``backward``), first
    after it (``forward``) or the nearer of both (``nearest``; backward if tied).

    ``exact`` says whether a row at the same time counts, ``tolerance`` how far
    away a match may be, in microseconds (or units of a whole-number time).
    Among rows of one time the one greatest by ``values``, in their order,
    matches. The new columns are named ``prefix`` with ``right_ts`` and each
    value, and are NULL where nothing matches; their names must not occur in
    ``left``. NULL keys or times match nothing; such rows of ``left`` stay.
    Repeated rows of ``left`` stay repeated. ``values`` need an order (no maps).

    Both sides meet as one tagged union by (keys, time cell); the last value is
    carried on inside a cell, and a header row brings the one carried there
    from the cells before. What a task holds is a cell, and the cells of a key,
    one row each, are scanned for the headers.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"no direction {direction}: {', '.join(DIRECTIONS)}")
    named = [f"{prefix}{c}" for c in (right_ts, *values)]
    if clash := set(named) & set(left.columns):
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}; give a prefix")
    ks = [f"__k{n}" for n in range(len(keys))]

    def side(df: DataFrame, ts: str, rank: int, payload: Column, name: str) -> DataFrame:
        return df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), micros(df, ts).alias("__t"), F.lit(rank).alias("__side"), payload.alias(name))

    # at one time, what is looked for stands before what looks for it, or behind it if it does not count
    lefts = side(left, left_ts, 2, F.struct(*(F.col(c) for c in left.columns)), "__left")
    rights = side(right, right_ts, 1 if exact else 3, F.struct(micros(right, right_ts).alias("t"), F.struct(F.col(right_ts), *(F.col(v) for v in values)).alias("row")), "__right")
    rights = rights.where(" and ".join(f"{c} is not null" for c in ("__t", *ks)))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    width = width or cell_width(both.select(*ks, "__t"), ks, "__t", rows)
    both = both.withColumn("__cell", _cell("__t", width))
    # latest row of each cell, and its first: the greatest by time turned round
    cells = both.groupBy(*ks, "__cell").agg(F.max("__right").alias("last"), F.max(F.when(F.col("__right").isNotNull(), F.struct((-F.col("__t")).alias("t"), F.col("__right").alias("r")))).alias("first"))
    by = Window.partitionBy(*ks).orderBy("__cell")
    heads = cells.select(*ks, "__cell", F.lit(0).alias("__side"), F.last("last", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
                         F.first("first.r", True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    rows_ = both.unionByName(heads, allowMissingColumns=True)
    head_first = F.when(F.col("__side") == 0, 0).otherwise(1)
    inside = Window.partitionBy(*ks, "__cell").rowsBetween(Window.unboundedPreceding, 0)
    found = {}
    if direction != "forward":
        found["__b"] = F.last(F.coalesce("__right", "__before"), True).over(inside.orderBy(head_first, "__t", "__side", "__right"))
    if direction != "backward":
        found["__f"] = F.last(F.coalesce("__right", "__after"), True).over(inside.orderBy(head_first, F.desc("__t"), "__side", "__right"))
    out = rows_.withColumns(found).where("__side = 2")

    def near(c: str) -> Column:
        distance = F.abs(F.col("__t") - F.col(f"{c}.t"))
        return F.when(F.col("__t").isNotNull() if tolerance is None else distance <= tolerance, F.col(c))

    if direction == "nearest":
        nearer = F.col("__b").isNull() | (F.col("__f.t") - F.col("__t") < F.col("__t") - F.col("__b.t"))
        out = out.withColumn("__b", F.when(F.coalesce(nearer, F.lit(False)), F.col("__f")).otherwise(F.col("__b")))
    match = out.withColumn("__m", near("__f" if direction == "forward" else "__b"))
    return match.select("__left.*", *(F.col(f"__m.row.{c}").alias(n) for c, n in zip((right_ts, *values), named, strict=True)))


#: Widths of cells are powers of this; an interval touches two cells of its level at most.
GROWTH = 4
#: Least width, as a power of GROWTH, where bounds are no whole numbers.
LEAST = -10


def _line(df: DataFrame, column: str) -> Column:
    """A bound or point as a number: microseconds of a time, else the number itself."""
    return F.col(column).cast("double") if dict(df.dtypes)[column] in ("float", "double") else micros(df, column)


def interval_join(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...], at: str, start: str, end: str, closed: bool = False) -> DataFrame:
    """Rows of ``points`` with every row of ``intervals`` of the same keys that
    holds them: ``start <= at < end``, or ``<= end`` if ``closed``.

    All columns of ``points`` stay, and those of ``intervals`` but the keys;
    other names must differ. NULL keys, points or bounds and empty intervals
    match nothing; repeated rows give repeated matches.

    Each interval belongs to the level whose cells are just as wide as it is
    long or wider, by less than ``GROWTH`` times, and stands in the one or two
    cells it touches; a point stands in its cell of every level there is (of
    some tens at most, as widths are powers). So neither side is multiplied by
    an interval's length, and as intervals fill a good part of their cells, what
    meets in a cell is mostly a match. The join is by equality of (keys, level,
    cell): Spark splits what is crowded.
    """
    clash = (set(intervals.columns) - set(keys)) & set(points.columns)
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    low, high = _line(intervals, start), _line(intervals, end)
    whole = "double" not in (x[1] for x in intervals.select(low.alias("a"), high.alias("b")).dtypes)
    spans = intervals.withColumn("__a", low).withColumn("__z", high).where(F.col("__a") <= F.col("__z") if closed else F.col("__a") < F.col("__z"))
    length = (F.col("__z") - F.col("__a")).cast("double")
    level = F.greatest(F.lit(0 if whole else LEAST), F.when(length > 0, F.ceil(F.log(length) / F.log(F.lit(float(GROWTH))) - 1e-9)).otherwise(0)).cast("int")
    # an error of the logarithm's last digits must not make a cell narrower than its interval
    spans = spans.withColumn("__level", level).withColumn("__level", F.when(F.pow(F.lit(float(GROWTH)), F.col("__level")) < length, F.col("__level") + 1).otherwise(F.col("__level")))

    def cell(x: Column, lev: Column) -> Column:
        return F.floor(x / F.pow(F.lit(float(GROWTH)), lev))

    spans = spans.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col("__a"), F.col("__level")), cell(F.col("__z"), F.col("__level"))))))
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())
    stood = points.withColumn("__p", _line(points, at)).where("__p is not null")
    stood = stood.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)"))).withColumn("__cell", cell(F.col("__p"), F.col("__level")))
    inside = (F.col("__a") <= F.col("__p")) & (F.col("__p") <= F.col("__z") if closed else F.col("__p") < F.col("__z"))
    met = stood.join(spans, [*keys, "__level", "__cell"]).where(inside)
    return met.select(*points.columns, *(c for c in intervals.columns if c not in keys))
