"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, written
from .runs import map_runs, union_find

PROJECTIONS = 16
#: Vectors of a tile; a task compares two tiles at once.
TILE = 2048
#: Cells of the routing projection, by which tiles are cut.
CELLS = 4096
#: Share of true pairs at the threshold that the collision count lets through.
RECALL = 0.9995
SEED = 7


def directions(dim: int, n: int = PROJECTIONS) -> np.ndarray:
    """Pseudo-random unit directions (rows), the first of which routes."""
    g = np.random.default_rng([SEED, dim]).standard_normal((n + 1, dim))
    return g / np.linalg.norm(g, axis=1, keepdims=True)


def calibrate(dim: int, threshold: float, n: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int, float]:
    """Window half width, least count of collisions, and routing half width.

    Unit vectors at the threshold are sqrt(2 - 2t) apart; the part of that along
    a random direction follows the marginal of a uniform point on the sphere,
    from which come the chance of a collision in one projection and, by the
    binomial law, the largest count that a share ``recall`` of such pairs
    reaches. Closer pairs collide more often. The routing width is exceeded by
    one in 100,000 of them. Below 8 dimensions, where 16 directions are far from
    independent, a window is as wide as the pair is apart and holds every pair.
    """
    apart = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    if dim < 8:
        return apart, n, apart
    u = np.linspace(0, 1, 20001)
    density = np.maximum(1 - u * u, 0) ** ((dim - 3) / 2)
    cumulative = np.cumsum((density[1:] + density[:-1]) / 2)
    cumulative /= cumulative[-1]
    width = u[1:][np.searchsorted(cumulative, 0.95)]
    route = u[1:][min(len(u) - 2, np.searchsorted(cumulative, 1 - 1e-5))]
    p = float(cumulative[np.searchsorted(u[1:], width)])
    tail, least = 0.0, 0
    for k in range(n, -1, -1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            least = k
            break
    return apart * width, least, apart * route


def colliding_pairs(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` (``i < j`` if they are the same)
    with cosine at least ``threshold``, among those that collide often enough.

    Every projection of ``b`` is sorted; a query's window is a range of ranks in
    it, and a pair's collisions are the projections whose window holds its rank.
    """
    dim = a.shape[1]
    half, least, route = calibrate(dim, threshold)
    d = directions(dim).T
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    pa_, pb = (a / na[:, None]) @ d, (b / nb[:, None]) @ d
    order = np.argsort(pb[:, 0], kind="stable")
    b, nb, pb = b[order], nb[order], pb[order]
    rank = np.empty(pb.shape, np.int32)
    low, high = np.empty(pa_.shape, np.int32), np.empty(pa_.shape, np.int32)
    for k in range(pb.shape[1]):
        by = np.argsort(pb[:, k], kind="stable")
        rank[by, k] = np.arange(len(b))
        wide = half if k else route
        ordered = pb[by, k]
        low[:, k] = np.searchsorted(ordered, pa_[:, k] - wide, "left")
        high[:, k] = np.searchsorted(ordered, pa_[:, k] + wide, "right")
    rank = np.ascontiguousarray(rank.T)
    first = np.argsort(pa_[:, 0], kind="stable")
    for s in range(0, len(a), 128):
        q = first[s:s + 128]
        lo, hi = int(low[q, 0].min()), int(high[q, 0].max())
        for t in range(lo, hi, 4096):
            u = min(hi, t + 4096)
            counts = np.zeros((len(q), u - t), np.uint8)
            for k in range(1, len(rank)):
                r = rank[k, t:u]
                counts += (r >= low[q, k, None]) & (r < high[q, k, None])
            i, j = np.nonzero(counts >= least)
            i, j = q[i], j + t
            if same:
                ok = i < order[j]
                i, j = i[ok], j[ok]
            if len(i):
                for c in range(0, len(i), 20_000):
                    x, y = i[c:c + 20_000], j[c:c + 20_000]
                    ok = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
                    if ok.any():
                        yield x[ok], order[y[ok]]


def near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """Per row: the id, ``n_links`` (other rows of the label within the cosine
    threshold), ``component_id`` (smallest id reachable) and ``kept``.

    Rows with a null label, or whose vector is null, empty, zero or holds a null
    or non-finite component, link with nothing. Vectors of different lengths are
    never compared. A null id stays null, counts as a link of others but names
    no component; rows that repeat an id are separate rows. Other columns are
    ignored.

    Equal vectors of a label are one node with a count, so copies are never
    expanded. Nodes are cut into tiles along one projection, whose cells are
    counted first (a crowded cell is cut further by a hash), and tiles within
    reach of each other are compared two at a time. A tile pair returns counts
    and a spanning forest, not its pairs. Work within a label grows with the
    square of its size, divided over tasks of bounded size.
    """
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("dim", T.LongType()),
                           T.StructField("vec", T.BinaryType()), T.StructField("cell", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, dims, vecs, cells = b.column(1).to_pylist(), [], [], []
            for label, v in zip(labels, b.column(2), strict=True):
                x = None
                if label is not None and v.is_valid and len(v) and v.values.null_count == 0:
                    x = v.values.to_numpy().astype("<f8") + 0.0
                    most = np.abs(x).max()
                    if np.isfinite(most) and most > 0:
                        x = np.ldexp(x, -int(np.frexp(most)[1]))  # a power of two: exact, and squares stay finite
                        norm = np.linalg.norm(x)
                    else:
                        x = None
                dims.append(None if x is None else len(x))
                vecs.append(None if x is None else x.tobytes())
                cells.append(None if x is None else min(CELLS - 1, int((x / norm @ directions_of(len(x))[0] + 1) * CELLS / 2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int64()), pa.array(vecs, pa.binary()), pa.array(cells, pa.int64())], schema.names)

    known: dict[int, np.ndarray] = {}

    def directions_of(dim: int) -> np.ndarray:
        if dim not in known:
            known[dim] = directions(dim)
        return known[dim]

    rows = df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("string").alias("label"), df[vector_col].cast("array<double>").alias("v"))
    rows = written(rows.mapInArrow(read, schema), "vectors")
    good = rows.where("vec is not null")
    nodes = good.groupBy("label", "dim", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.min("cell").alias("cell"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    per = nodes.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("label", "dim").orderBy("cell")) - F.col("m")
    per = per.select("label", "dim", "cell", F.floor(upto / tile).alias("chunk"), F.ceil(F.col("m") / tile).alias("subs"))
    per = written(per, "cells")
    tiles = per.groupBy("label", "dim", "chunk").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.max("subs").alias("subs"))
    tiles = tiles.select("label", "dim", "lo", "hi", F.explode(F.expr("sequence(0, subs - 1)")).alias("sub"), (F.col("chunk") * 100_000).alias("base")).withColumn("t", F.col("base") + F.col("sub")).drop("base", "sub")
    # reach in cells, by dimension: at most sqrt(2 - 2 threshold), a bound that holds for any pair
    reach = int(math.ceil(math.sqrt(2 - 2 * threshold) * CELLS / 2)) + 1
    x, y = tiles.alias("x"), tiles.alias("y")
    meet = x.join(y, F.expr(f"x.label = y.label and x.dim = y.dim and x.t <= y.t and y.lo - x.hi <= {reach} and x.lo - y.hi <= {reach}"))
    meet = meet.selectExpr("x.label as label", "x.dim as dim", "x.t as t", "y.t as u")
    # a pair of tiles is a group; both its sides get its key, listed with each cell
    sides = meet.selectExpr("label", "dim", "t as own", "t", "u", "0L as side").unionByName(meet.where("t <> u").selectExpr("label", "dim", "u as own", "t", "u", "1L as side"))
    sides = sides.groupBy("label", "dim", F.expr("own div 100000").alias("chunk")).agg(F.collect_list(F.struct("own", "t", "u", "side")).alias("sides"))
    per = written(per.join(sides, ["label", "dim", "chunk"]), "sides")
    placed = nodes.join(per, ["label", "dim", "cell"]).withColumn("own", F.expr("chunk * 100000 + pmod(xxhash64(node), subs)"))
    spread = placed.select(F.xxhash64("label", "dim").alias("g"), "dim", "node", "n", "vec", F.explode(F.expr("filter(sides, s -> s.own = own)")).alias("s"))
    spread = spread.selectExpr("g", "s.t as t", "s.u as u", "dim", "s.side as side", "node", "n", "vec")
    out = T.StructType([T.StructField("kind", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def group(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        dim = int(cols[3][0])
        side, node, n = cols[4], cols[5], cols[6]
        vec = np.frombuffer(b"".join(cols[7]), "<f8").reshape(-1, dim)
        same = cols[1][0] == cols[2][0]
        left = np.arange(len(node)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return
        more = np.zeros(len(node), np.int64)
        label = np.arange(len(node))
        for i, j in colliding_pairs(vec[left], vec[right], same, threshold):
            i, j = left[i], right[j]
            np.add.at(more, i, n[j])
            np.add.at(more, j, n[i])
            label = union_find(len(node), np.concatenate((np.arange(len(node)), i)), np.concatenate((label, j)))
        got, linked = np.flatnonzero(more), np.flatnonzero(label != np.arange(len(node)))
        if len(got):
            kind = np.repeat(np.array([0, 1]), [len(got), len(linked)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((node[got], node[linked]))), pa.array(np.concatenate((more[got], node[label[linked]])))], out.names)

    found = written(map_runs(spread, ["g", "t", "u"], ["side"], group, out), "found")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("more")).withColumnRenamed("a", "node")
    comp = connected_components(found.where("kind = 1").select("a", "b"))
    named = nodes.join(counts, "node", "left").join(comp, "node", "left").select(
        "label", "dim", "vec", "low", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    lows = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    named = named.join(lows, "component").select("label", "dim", "vec", "n_links", "component_id")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    joined = rows.alias("r").join(named.alias("m"), ["label", "dim", "vec"], "left")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
