"""Cases that take the whole job: none is left out by caps, samples or radii."""

import random

import numpy as np
import pytest

from millrace.llm import nearcopies

ROWS = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def groups(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, ROWS)).collect()}


def test_equal_fingerprints_are_compared(spark):
    """Texts that one repeated line dominates share the fingerprint and little else."""
    rng = random.Random(1)
    line = "all rights reserved by the holder of this notice".split()
    rows = [(i, " ".join(line * 100 + words(rng, 200))) for i in range(5)]
    assert len({nearcopies.fingerprint(t.encode()) for _, t in rows}) == 1
    assert groups(spark, rows) == {i: i for i in range(5)}


def revised(base, at, rng):
    out = list(base)
    for k in at:
        out[k] = f"x{rng.randrange(10**9)}"
    return out


def test_subclusters_are_joined(spark):
    """Two families of eight light revisions each, whose bases overlap by over 0.8."""
    rng, families = random.Random(2), 30
    rows = []
    for _ in range(families):
        base = words(rng, 600)
        other = base[:540] + words(rng, 60)
        for b in (base, other):
            rows += [(len(rows) + k, " ".join(revised(b, [rng.randrange(5, 530)] if k else [], rng))) for k in range(8)]
    got = groups(spark, rows)
    assert all(got[i] == i // 16 * 16 for i in got)


def test_far_fingerprints_are_joined(spark):
    """An overlap just over 0.8, from one replaced block, in whole sets over the sketch size."""
    rng = random.Random(3)
    rows, far = [], 0
    for _ in range(150):
        base = words(rng, 1000)
        two = [" ".join(base), " ".join(base[:892] + words(rng, 108))]
        sets = [{tuple(t.split()[k:k + 5]) for k in range(996)} for t in two]
        assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8
        far += (nearcopies.fingerprint(two[0].encode()) ^ nearcopies.fingerprint(two[1].encode())).bit_count() > nearcopies.RADIUS
        rows += [(len(rows) + k, t) for k, t in enumerate(two)]
    assert far
    got = groups(spark, rows)
    assert sum(got[i] == i // 2 * 2 for i in got) == len(rows)


@pytest.mark.parametrize("tables", [1, 32])
def test_groups_do_not_depend_on_tables(spark, tables):
    """Narrow tables and crowded keys as a large corpus has them, against brute force."""
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        base = words(rng, 300)
        rows += [(len(rows) + k, " ".join(revised(base, rng.sample(range(300), 3 * k), rng))) for k in range(5)]
    sets = [np.frombuffer(nearcopies.sketch(t.encode(), size=1 << 62), "<u4") for _, t in rows]
    low = list(range(len(rows)))
    for _ in range(6):
        for i in low:
            for j in range(i // 5 * 5, i // 5 * 5 + 5):
                n = len(np.intersect1d(sets[i], sets[j]))
                if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                    low[i] = low[j] = min(low[i], low[j])
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, ROWS), tables=tables, hot=2).collect()}
    assert got == dict(enumerate(low))


def test_parity_bounds_differences():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 2000, rng.integers(1, 900)).astype("<u4")) for _ in range(2))
        bits = np.frombuffer(nearcopies.parity(x) + nearcopies.parity(y), "<u8").reshape(2, -1)
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("hot", [2, 5, 2048])
def test_pieces_hold_every_pair(spark, hot):
    """Cut or whole, a key's rows of different components meet."""
    rng = random.Random(8)
    rows = [(rng.randrange(6), 10, 0, i, rng.choice([0, 0, 0, 0, i]), b"") for i in range(150)]
    got = nearcopies._pieces(spark.createDataFrame(rows, "key int, n int, at int, node long, component long, bits binary"), hot).collect()
    groups, met = {}, set()
    for r in got:
        groups.setdefault((r["key"], r["x"], r["y"]), []).append((r["node"], r["component"]))
    for g in groups.values():
        met |= {(min(a, b), max(a, b)) for a, c in g for b, d in g if c != d}
    assert met == {(a[3], b[3]) for a in rows for b in rows if a[3] < b[3] and a[0] == b[0] and a[4] != b[4]}


def test_keep_first_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9), (1, "a b c d e f", 6, 8, 9), (None, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank long, id long, row long")
    got = nearcopies.keep_first(df)
    assert got.columns == df.columns and sorted(map(str, (r["doc_id"] for r in got.collect()))) == ["1", "None"]
