"""Sums at every level, and reconciled forecasts against the matrix solution."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import hierarchy
from millrace.operators.series import Series

PATH = ("a", "b", "c")
S = Series(("a", "b", "c"))


def leaves(rng, n=25):
    return sorted({(rng.choice("xyz"), rng.choice(["p", "q", None]), f"n{rng.randrange(6)}") for _ in range(n)}, key=repr)


def nodes_of(bottom):
    """(node, level) with the bottom nodes below it, level by level."""
    out = {}
    for k in range(len(PATH) + 1):
        for x in bottom:
            out.setdefault((x[:k] + (None,) * (len(PATH) - k), k), []).append(x)
    return out


def test_aggregate_adds_up(spark):
    rng = random.Random(1)
    rows = [(*x, t, rng.choice([None, float("nan"), 1.5, 2.0, -3.0])) for x in leaves(rng) for t in range(4) for _ in range(2)]
    df = spark.createDataFrame(rows, "a string, b string, c string, ds long, y double")
    got = {((r["a"], r["b"], r["c"]), r["level"], r["ds"]): (r["y"], r["n"]) for r in hierarchy.aggregate(df, S, PATH).collect()}
    want = {}
    for (node, k), below in nodes_of(sorted({r[:3] for r in rows}, key=repr)).items():
        for t in range(4):
            ys = [r[4] for r in rows if r[:3] in below and r[3] == t and r[4] is not None and r[4] == r[4]]
            want[node, k, t] = (sum(ys) if ys else None, len(ys))
    assert got == want
    assert hierarchy.aggregate(df.where("false"), S, PATH).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_reconcile_equals_matrix(spark, weighted):
    rng = random.Random(2)
    bottom = leaves(rng)
    tree = nodes_of(bottom)
    rows, want = [], {}
    for t in range(3):
        nodes = [k for k in tree if t != 1 or k[1] != 1 or rng.random() < 0.5]  # at one time some middle nodes have no forecast
        f = {k: rng.uniform(-5, 20) * len(tree[k]) for k in nodes}
        w = {k: rng.uniform(0.5, 4) if weighted else 1.0 for k in nodes}
        rows += [(*k[0], k[1], t, f[k], w[k]) for k in nodes]
        s = np.array([[float(x in tree[k]) for x in bottom] for k in nodes])
        p = np.diag([1 / w[k] for k in nodes])
        x = np.linalg.solve(s.T @ p @ s, s.T @ p @ np.array([f[k] for k in nodes]))
        for k, below in tree.items():
            want[(*k, t)] = sum(x[bottom.index(b)] for b in below)
    rows += [(*k[0], k[1], 9, None if k[1] == 3 and k[0] == bottom[0] else 1.0, 1.0) for k in tree]  # a bottom node without a forecast: no result at that time
    df = spark.createDataFrame(rows, "a string, b string, c string, level int, ds long, y double, w double")
    got = {((r["a"], r["b"], r["c"]), r["level"], r["ds"]): r["reconciled"] for r in hierarchy.reconcile(df, PATH, weight="w" if weighted else None).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-7 for k, v in want.items())


def test_summing_and_bottom_up(spark):
    bottom = leaves(random.Random(3))
    df = spark.createDataFrame([(*x, 3, 0, float(i)) for i, x in enumerate(bottom)], "a string, b string, c string, level int, ds long, y double")
    pairs = {((r["a"], r["b"], r["c"]), r["level"], (r["b_a"], r["b_b"], r["b_c"])) for r in hierarchy.summing(df, PATH).collect()}
    assert pairs == {(*k, b) for k, below in nodes_of(bottom).items() for b in below}
    top = hierarchy.bottom_up(df, PATH).where("level = 0").first()
    assert top["y"] == sum(range(len(bottom)))
    again = hierarchy.reconcile(hierarchy.bottom_up(df, PATH), PATH)  # what adds up stays as it is
    assert again.join(hierarchy.bottom_up(df, PATH).withColumnRenamed("level", "l"), (F.col("level") == F.col("l")) & F.expr("level = 0")).select(F.abs(F.col("reconciled") - F.col("y")) < 1e-9).first()[0]
