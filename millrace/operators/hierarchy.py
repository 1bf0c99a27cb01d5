"""Hierarchies of series: sums at every level, and forecasts that add up.

A hierarchy is a list of key columns from the top down, as in ("region",
"nation"): its nodes are the whole, each region and each nation. A node is
named by all the columns, NULL below its level, and ``level`` (0 is the whole),
which tells a NULL of the data from one of a higher level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import Series, cleaned


def _names(path: tuple[str, ...], level: int) -> list[Column]:
    """The columns of a node of a level: NULL below it."""
    return [F.col(c) if k < level else F.lit(None).alias(c) for k, c in enumerate(path)]


def aggregate(df: DataFrame, s: Series, path: tuple[str, ...]) -> DataFrame:
    """``path`` columns, ``level``, ``ds``, ``y`` (sum) and ``n`` (values) of every node at every time.

    One pass of grouping sets: partial sums of all levels leave the tasks that
    read the rows. NULL, NaN and infinite values are left out, a node without a
    value at a time has NULL there; a NULL in a ``path`` column is a node of its
    own. An empty frame gives no rows.
    """
    base = df.select(*path, F.col(s.ts).alias("ds"), cleaned(F.col(s.value)).alias("y"))
    sets = [["ds", *path[:k]] for k in range(len(path) + 1)]
    # grouping_id has a bit for each column that a set leaves out, the lowest for the last
    level = sum((F.lit(1) - F.grouping(c) for c in path), F.lit(0)).cast("int")
    out = base.groupingSets([[F.col(c) for c in x] for x in sets], F.col("ds"), *(F.col(c) for c in path)).agg(level.alias("level"), F.sum("y").alias("y"), F.count("y").alias("n"))
    return out.select(*path, "level", "ds", "y", "n")


def summing(df: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """The summing relation, sparse: each node (``path`` columns, ``level``) with
    every bottom node (``b_`` columns) that it sums, itself at the bottom level."""
    bottom = df.select(*path).distinct()
    parts = [bottom.select(*_names(path, k), F.lit(k).alias("level"), *(F.col(c).alias(f"b_{c}") for c in path)) for k in range(len(path) + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bottom_up(forecasts: DataFrame, path: tuple[str, ...], value: str = "y") -> DataFrame:
    """All levels as sums of the bottom level's forecasts (as :func:`aggregate` names them)."""
    bottom = forecasts.where(F.col("level") == len(path))
    return aggregate(bottom, Series(path, "ds", value), path).drop("n").withColumnRenamed("y", value)


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def reconcile(forecasts: DataFrame, path: tuple[str, ...], value: str = "y", weight: str | None = None) -> DataFrame:
    """Forecasts of all nodes, ``reconciled`` so that every node is the sum of
    its children, at the least sum of squared changes.

    ``forecasts`` has the ``path`` columns, ``level``, ``ds`` and ``value``, one
    row a node and time; ``weight`` names a column of error variances that
    squares are divided by (none: all alike). A node without a forecast, or with
    a variance that is not positive, takes what its children give; bottom nodes
    need both, and a time is left out where one of them has none.

    The least squares of a tree need no matrix: going up, a node's own forecast
    and its children's sum are averaged by their precision; going down, what a
    parent gained beyond its children's sum is shared out by their variance.
    Each level is one aggregate by parent on the way up and one join on the way
    down, for all times at once, so work grows with rows times levels and no
    task holds a hierarchy.
    """
    depth = len(path)
    v = cleaned(F.col(value))
    w = F.lit(1.0) if weight is None else cleaned(F.col(weight))
    base = forecasts.select(*path, "level", "ds", F.when(w > 0, v).alias("f"), F.when(w > 0, w).alias("w"))
    bad = base.where((F.col("level") == depth) & F.col("f").isNull()).select(F.col("ds").alias("b_ds")).distinct()
    base = base.join(bad, F.col("ds").eqNullSafe(F.col("b_ds")), "left_anti")
    # going up: m and v are a node's best guess from its subtree, sum_m and sum_v those of its children
    known = base.where(F.col("level") == depth).select(*path, "ds", F.col("f").alias("m"), F.col("w").alias("v"))
    levels = {depth: known}
    for k in range(depth - 1, -1, -1):
        names = list(path[:k])
        sums = levels[k + 1].groupBy("ds", *names).agg(F.sum("m").alias("sum_m"), F.sum("v").alias("sum_v"))
        own = base.where(F.col("level") == k).select("ds", *names, "f", "w")
        o = own.select(*(F.col(c).alias(f"o_{c}") for c in ("ds", *names)), "f", "w")
        both = sums.join(o, _same(["ds", *names], [f"o_{c}" for c in ("ds", *names)]), "left")
        has = F.col("f").isNotNull()
        var = F.when(has, 1 / (1 / F.col("w") + 1 / F.col("sum_v"))).otherwise(F.col("sum_v"))
        mean = F.when(has, var * (F.col("f") / F.col("w") + F.col("sum_m") / F.col("sum_v"))).otherwise(F.col("sum_m"))
        levels[k] = both.select(*names, "ds", mean.alias("m"), var.alias("v"), "sum_m", "sum_v")
    # going down
    done = {0: levels[0].withColumn("reconciled", F.col("m"))}
    for k in range(1, depth + 1):
        names = list(path[:k - 1])
        parent = done[k - 1].select(*(F.col(c).alias(f"p_{c}") for c in ("ds", *names)), F.col("reconciled").alias("p_r"), F.col("sum_m").alias("p_m"), F.col("sum_v").alias("p_v"))
        down = levels[k].join(parent, _same(["ds", *names], [f"p_{c}" for c in ("ds", *names)]))
        done[k] = down.withColumn("reconciled", F.col("m") + F.col("v") / F.col("p_v") * (F.col("p_r") - F.col("p_m"))).drop("p_r", "p_m", "p_v", *(f"p_{c}" for c in ("ds", *names)))
    out = None
    for k in range(depth + 1):
        rows = done[k].select(*_names(path, k), F.lit(k).alias("level"), "ds", "reconciled")
        out = rows if out is None else out.unionByName(rows)
    return out
