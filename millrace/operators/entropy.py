"""Sample and approximate entropy: a neighbour join of templates over cells.

A template is a stretch of ``m`` values and the one behind it. Equal templates
of a series become one row with counts. Rows are dealt to cells of the first
two values, a little wider than the tolerance ``r``, so that two templates
within ``r`` of each other lie in one cell or in cells that touch. A cell's
templates ask in pieces, those of all cells that touch it answer in pieces, and
two pieces meet as one group of bounded size; nothing else is compared. A group counts by
bitmaps: for each value, the templates of a block that lie below every place in
its order, of which two make an interval, so a word stands for 64 comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import Series

#: Different templates of a piece on average: a group compares about the square of that many at most.
PIECE = 16384
#: Templates of a block of bitmaps.
BLOCK = 4096
#: Shares in which a cell's rows learn of the cells beside it.
SALTS = 16
#: Cells are counted up to here on both sides of zero; values beyond share the last one.
FAR = float(1 << 45)


def templates(p: DataFrame, keys: tuple[str, ...], ahead: list[Column], m: int) -> DataFrame:
    """``__key``, ``d0`` .. ``d<m>`` (the last is NULL at the end of a series)
    and how often: ``w_all``, ``w_full`` (with the last value) and ``w_short``
    (and one more behind it)."""
    d = [a.alias(f"d{j}") for j, a in enumerate(ahead[:m + 1])]
    rows = p.select(F.struct(*keys).alias("__key"), *d, ahead[m + 1].alias("__next")).where(f"d{m - 1} is not null")
    return rows.groupBy("__key", *(f"d{j}" for j in range(m + 1))).agg(F.count(F.lit(1)).alias("w_all"), F.count(f"d{m}").alias("w_full"), F.count("__next").alias("w_short"))


def packed(bits: np.ndarray) -> np.ndarray:
    """Flags as 64-bit words."""
    out = np.zeros(-(-len(bits) // 64) * 8, np.uint8)
    out[:-(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
    return out.view("<u8")


def within(values: np.ndarray, r: float):
    """A function that gives, for numbers, bitmaps of the ``values`` whose
    difference to each is ``r`` at most, as doubles subtract; NaN is near nothing."""
    n = len(values)
    order = np.argsort(values, kind="stable")[:n - int(np.isnan(values).sum())]
    table = np.zeros((len(order) + 1, -(-n // 64)), np.uint64)
    table[np.arange(1, len(order) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    np.bitwise_or.accumulate(table, axis=0, out=table)
    u, first = np.unique(values[order], return_index=True)
    at = np.append(first, len(order))

    def bitmaps(x: np.ndarray) -> np.ndarray:
        if not len(u):
            return np.zeros((len(x), table.shape[1]), np.uint64)
        lo, hi = np.searchsorted(u, x - r, "left"), np.searchsorted(u, x + r, "right")
        # sums round, so a bound may be a few values off
        for bound, step, back in ((lo, 1, 0), (hi, -1, 1)):
            while (off := (bound - back >= 0) & (bound - back < len(u)) & ~(np.abs(u[np.clip(bound - back, 0, len(u) - 1)] - x) <= r) & ((u[np.clip(bound - back, 0, len(u) - 1)] - x) * step < 0)).any():
                bound[off] += step
            while (off := (bound - 1 + back >= 0) & (bound - 1 + back < len(u)) & (np.abs(u[np.clip(bound - 1 + back, 0, len(u) - 1)] - x) <= r)).any():
                bound[off] -= step
        nothing = np.isnan(x) | (hi <= lo)
        lo[nothing] = hi[nothing] = 0
        return table[at[hi]] ^ table[at[lo]]

    return bitmaps


def weighed(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the non-negative ``weights`` that each bitmap holds."""
    out = np.zeros(len(found), np.int64)
    for b in range(int(weights.max(initial=0)).bit_length()):
        out += np.bitwise_count(found & packed(weights >> b & 1)).sum(1, dtype=np.int64) << b
    return out


def counted(asks: list[np.ndarray], answers: list[np.ndarray], weights: list[np.ndarray], r: float) -> np.ndarray:
    """For templates ``asks``, the sums of ``weights`` (all, full, short) of the
    ``answers`` near them: all and full by all values but the last, full and
    short by every value."""
    out = np.zeros((4, len(asks[0])), np.int64)
    for s in range(0, len(answers[0]), BLOCK):
        near = [within(v[s:s + BLOCK], r) for v in answers]
        w_all, w_full, w_short = (w[s:s + BLOCK] for w in weights)
        for a in range(0, len(asks[0]), BLOCK):
            found = near[0](asks[0][a:a + BLOCK])
            for f, x in zip(near[1:-1], asks[1:-1], strict=True):
                found &= f(x[a:a + BLOCK])
            to = slice(a, a + BLOCK)
            out[0, to] += (short := weighed(found, w_all))
            out[1, to] += short if np.array_equal(w_all, w_full) else weighed(found, w_full)
            found &= near[-1](asks[-1][a:a + BLOCK])
            out[2, to] += (whole := weighed(found, w_full))
            out[3, to] += whole if np.array_equal(w_full, w_short) else weighed(found, w_short)
    return out


def neighbours(t: DataFrame, m: int, r: float, piece: int = PIECE) -> DataFrame:
    """``t`` with the templates within ``r`` of each, itself included, in every
    value: ``c_all`` and ``c_full`` by the first ``m``, ``c1_full`` and
    ``c1_short`` by ``m + 1``. A template that no other is near has itself; a
    negative ``r`` leaves no rows."""
    # 1.01: rounding of differences and quotients never parts neighbours by two cells
    side, dims = (1.01 * r if r > 0 else 1.0), range(min(m, 2))
    cells = [f"q{j}" for j in dims]
    values = [f"d{j}" for j in range(m + 1)]
    t = t.withColumns({f"q{j}": F.floor(F.greatest(F.least(F.col(f"d{j}") / F.lit(side), F.lit(FAR)), F.lit(-FAR))) for j in dims}).withColumn("__h", F.xxhash64(*values))
    census = t.groupBy("__key", *cells).agg(F.count(F.lit(1)).alias("own"))

    def touching(own: DataFrame, other: DataFrame, found: list[Column]) -> DataFrame:
        """``own`` cells with what is found in those of ``other`` that touch them, nine at most."""
        for j in dims:
            own = own.withColumn(f"s{j}", F.explode(F.array(*(F.col(f"q{j}") + o for o in (-1, 0, 1)))))
        beside = other.select(F.col("__key"), *(F.col(f"q{j}").alias(f"s{j}") for j in dims), *(F.col(c).alias(f"other_{c}") for c in other.columns if c not in ("__key", *cells)))
        return own.join(beside, ["__key", *(f"s{j}" for j in dims)]).groupBy("__key", *cells, *(c for c in own.columns if c not in ("__key", *cells, *(f"s{j}" for j in dims)))).agg(*found)

    # a cell's templates ask in pieces, and all around them answer in pieces
    sizes = touching(census, census, [F.sum("other_own").alias("around")]).select("__key", *cells, F.ceil(F.col("own") / F.lit(piece)).alias("asking"), F.ceil(F.col("around") / F.lit(piece)).alias("answering"))
    near = touching(sizes, sizes, [F.collect_list(F.struct(*(f"s{j}" for j in dims), "other_asking", "other_answering")).alias("near")])
    near = near.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the low bits of the hash choose the salt, the others the piece
    dealt = t.withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int")).join(near, ["__key", *cells, "__salt"]).withColumn("__rest", F.expr(f"__h div {SALTS}"))

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    # a group is (cell, piece that asks, piece that answers)
    group = [*(f"g{j}" for j in dims), "ga", "gb"]
    weights = ["w_all", "w_full", "w_short"]
    asks = dealt.select("__key", *(F.col(f"q{j}").alias(f"g{j}") for j in dims), F.pmod("__rest", "asking").alias("ga"), upto("answering").alias("gb"), *values, *weights)
    met = dealt.withColumn("near", F.explode("near")).withColumn("__piece", upto("near.other_asking"))
    answers = met.select(F.col("__key").alias("__okey"), *(F.col(f"near.s{j}").alias(f"og{j}") for j in dims), F.col("__piece").alias("oga"), F.pmod("__rest", F.col("near.other_answering")).alias("ogb"),
                         *(F.col(v).alias(f"o{v}") for v in values), *(F.col(w).alias(f"o{w}") for w in weights))
    counts = ["c_all", "c_full", "c1_full", "c1_short"]
    schema = T.StructType([*(asks.schema[c] for c in ("__key", *values, *weights)), *(T.StructField(c, T.LongType()) for c in counts)])

    def column(x: pa.Table, name: str) -> np.ndarray:
        return x.column(name).to_numpy()

    def group_counts(here: pa.Table, there: pa.Table) -> pa.Table:
        if not here.num_rows or not there.num_rows:
            here = here.slice(0, 0)
        got = counted([column(here, v).astype(float) for v in values], [column(there, f"o{v}").astype(float) for v in values], [column(there, f"o{w}") for w in weights], r)
        out = here.select(schema.names[:-4])
        for name, x in zip(counts, got, strict=True):
            out = out.append_column(name, pa.array(x))
        return out.filter(pa.array(got[0] > 0))

    both = asks.groupBy("__key", *group).cogroup(answers.groupBy("__okey", *(f"o{g}" for g in group))).applyInArrow(group_counts, schema)
    return both.groupBy("__key", *values, *weights).agg(*(F.sum(c).alias(c) for c in counts))


def of_templates(series: DataFrame, t: DataFrame, keys: tuple[str, ...], m: int, r: float, piece: int = PIECE) -> DataFrame:
    """Keys, ``sample_entropy``, ``approximate_entropy`` and ``sample_entropy_limit``
    of the ``series`` (keys, ``__n`` rows, ``__v`` values) whose templates are ``t``."""
    def mean_log(w: str, c: str) -> Column:
        total = F.sum(w)
        return F.sum(F.col(w) * F.log(F.when(F.col(c) > 0, F.col(c)))) / F.when(total > 0, total) - F.log(F.when(total > 0, total))

    sums = neighbours(t, m, r, piece).groupBy("__key").agg(
        (F.sum(F.col("w_full") * F.col("c_full")) - F.sum("w_full")).alias("__b"), (F.sum(F.col("w_short") * F.col("c1_short")) - F.sum("w_short")).alias("__a"),
        (mean_log("w_all", "c_all") - mean_log("w_full", "c1_full")).alias("__apen"))
    out = series.withColumn("__key", F.struct(*keys)).join(sums, "__key", "left")
    whole = F.col("__n") == F.col("__v")
    sample = F.when(whole & (F.col("__n") >= m + 2) & (F.col("__b") > 0), F.coalesce(-F.log(F.col("__a") / F.col("__b")), F.lit(float("inf"))))  # the logarithm of 0 is NULL
    return out.select(*keys, F.when(F.col("__a") > 0, sample).alias("sample_entropy"), F.when(whole & (F.col("__n") >= m + 1), F.col("__apen")).alias("approximate_entropy"), sample.alias("sample_entropy_limit"))


def of_prepared(p: DataFrame, keys: tuple[str, ...], m: int = 2, r: float = 0.2, piece: int = PIECE) -> DataFrame:
    """As :func:`entropies`, of a prepared frame (keys, ``i``, ``y``): templates
    come from a window by key, which other features share."""
    if m < 1:
        raise ValueError("a template has one value at least")
    w = Window.partitionBy(*keys).orderBy("i")
    ahead = [F.col("y"), *(F.lead("y", j).over(w) for j in range(1, m + 2))]
    return of_templates(p.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count("y").alias("__v")), templates(p, keys, ahead, m), keys, m, r, piece)


def entropies(df: DataFrame, s: Series, m: int = 2, r: float = 0.2, piece: int = PIECE, rows: int | None = None) -> DataFrame:
    """Keys, ``sample_entropy``, ``approximate_entropy`` and
    ``sample_entropy_limit`` with templates of ``m`` values and an absolute
    tolerance ``r``; no task holds a whole series. The last is infinite where
    templates of ``m`` values match and none of ``m + 1`` do, as the logarithm
    of nothing is.

    NULL where a series has a missing value, is shorter than ``m + 2``
    (approximate: ``m + 1``) or, for sample entropy, has no two templates of
    either length within ``r``. A key that is NULL is a series of its own; an
    empty frame gives no rows. Work grows with the templates' counts in cells
    that touch, so with the pairs that match, not with all pairs.
    """
    from .chunks import ROWS, lagged

    if m < 1:
        raise ValueError("a template has one value at least")
    inner = [f"__series{j}" for j in range(len(s.keys))]  # names that no column of the chunks has
    named = df.select(*(F.col(k).alias(x) for k, x in zip(s.keys, inner)), F.col(s.ts).alias("__ts"), F.col(s.value).alias("__value"))
    p = lagged(named, Series(keys=tuple(inner), ts="__ts", value="__value"), tuple(-j for j in range(1, m + 2)), rows or ROWS)
    ahead = [F.col("y"), *(F.col(f"lag_{-j}") for j in range(1, m + 2))]
    out = of_templates(p.groupBy(*inner).agg(F.count(F.lit(1)).alias("__n"), F.count("y").alias("__v")), templates(p, tuple(inner), ahead, m), tuple(inner), m, r, piece)
    return out.select(*(F.col(x).alias(k) for k, x in zip(s.keys, inner)), "sample_entropy", "approximate_entropy", "sample_entropy_limit")
