"""Groups of consecutive equal keys in a stream of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed


def map_runs(df: DataFrame, keys: list[str], order: list[str], f: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], schema, least: int = 2, even: bool = False) -> DataFrame:
    """Call ``f`` with the columns (NumPy, in ``df``'s order) of each group of
    rows that agree in the long columns ``keys``, groups of under ``least`` rows
    left out.

    Unlike grouped pandas calls, a task meets its groups as slices of large
    batches, so millions of tiny groups cost little. A group is held in memory:
    callers bound its size. ``even`` says that the first key numbers groups of
    about one size; these are dealt out in turn, where hashing would put several
    into one task.
    """
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def groups(cols: list[np.ndarray], whole: bool) -> Iterator:
            n = len(cols[0])
            new = np.zeros(n, bool)
            if n:
                new[0] = True
            for k in at:
                new[1:] |= cols[k][1:] != cols[k][:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            stop = len(starts) if whole else len(starts) - 1
            big = np.flatnonzero(ends[:stop] - starts[:stop] >= least)
            for g in big.tolist():
                yield from f([c[starts[g]:ends[g]] for c in cols])
            held[:] = [] if whole or not n else [[c[starts[-1]:] for c in cols]]

        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held and all(held[0][k][0] == cols[k][-1] for k in at):  # one group goes on
                held.append(cols)
                continue
            if held:
                cols = [np.concatenate(x) for x in zip(*held, cols, strict=True)]
            yield from groups(cols, False)
        if held:
            yield from groups([np.concatenate(x) for x in zip(*held, strict=True)], True)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionById(tasks, df[keys[0]].cast("int")) if even else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(trimmed(run), schema)


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of 0..n-1's component under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
