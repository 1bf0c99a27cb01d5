"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, slices, written
from .runs import map_runs, union_find

BITS = 64
SEED = 42
#: Distinct fingerprints that share a block key before the key is refined.
HOT_KEY = 512
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if set in over half of the XXH64
    hashes (seed 42) of its shingles, repeats included; 0 without words."""
    words = (text or b"").translate(_UPPER).split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _WORDS_AT_ONCE):
        part = words[at:min(at + _WORDS_AT_ONCE, n) + shingle - 1]
        count = max(1, len(part) - shingle + 1)
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
        stops = ends[shingle - 1:].tolist() if len(part) >= shingle else [len(joined)]
        view = memoryview(joined)
        h = np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, count)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def pivots(n: int = 24) -> np.ndarray:
    """Reference fingerprints: zero, then pseudo-random ones of a fixed seed."""
    rng = np.random.default_rng(SEED)
    return np.concatenate((np.zeros(1, np.uint64), rng.integers(0, 1 << 63, n - 1, np.uint64) * np.uint64(2) + rng.integers(0, 2, n - 1, np.uint64)))


def near_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j of the pivot order) within ``radius`` bits, exactly.

    A table holds the distance of every fingerprint to every pivot. Distances
    of a pair to one pivot differ by no more than the pair's own distance, so a
    pair whose largest coordinate difference exceeds the radius is discarded;
    rows are sorted by the most spread coordinate so that only a window of it is
    looked at, and the survivors of all coordinates are verified.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int16)
    axis = int(np.argmax(table.std(0)))
    order = np.argsort(table[:, axis], kind="stable")
    t, f = table[order], fps[order]
    stop = np.searchsorted(t[:, axis], t[:, axis] + radius, "right")
    left, right = [], []
    block = max(1, (1 << 20) // max(1, len(f)))
    for s in range(0, len(f), block):
        e = min(len(f), s + block)
        counts = stop[s:e] - np.arange(s + 1, e + 1)
        i = np.repeat(np.arange(s, e), counts)
        j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
        for k in range(t.shape[1]):
            if k != axis and len(i):
                ok = np.abs(t[i, k] - t[j, k]) <= radius
                i, j = i[ok], j[ok]
        ok = np.bitwise_count(f[i] ^ f[j]) <= radius
        left.append(order[i[ok]])
        right.append(order[j[ok]])
    return np.concatenate(left), np.concatenate(right)


def _cuts(width: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` nearly equal pieces of a number of ``width`` bits."""
    bounds = [width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(bounds)]


def _bits(value: str, pieces: list[tuple[int, int]]) -> F.Column:
    """The given pieces of a long column, side by side."""
    out = None
    for shift, width in pieces:
        bits = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = bits if out is None else F.shiftleft(out, width).bitwiseOR(bits)
    return out


def links(distinct: DataFrame, radius: int = 2, hot: int = HOT_KEY) -> DataFrame:
    """Links ``a``-``b`` that connect exactly what the pairs within ``radius``
    bits connect, from distinct ``fp`` and ``node`` (longs).

    The bits are cut into ``radius + 2`` blocks, of which two at least are equal
    in any pair; every two blocks make a key, and a pair meets under one of its
    keys. A key with more than ``hot`` fingerprints is replaced by finer ones:
    its other bits are cut into ``radius + 4`` pieces, of which four are equal,
    which bounds a group by the 2**11 or so values of the bits left over. Within a
    group pairs are found by pivot tables and a spanning forest is returned, so
    output stays linear however many pairs a group holds.
    """
    blocks = _cuts(BITS, radius + 2)
    choices = list(itertools.combinations(blocks, 2))
    keys = [F.struct(F.lit(c).cast("long").alias("c"), _bits("fp", list(two)).alias("key"), _bits("fp", [x for x in blocks if x not in two]).alias("rest")) for c, two in enumerate(choices)]
    rows = distinct.select("fp", "node", F.explode(F.array(*keys)).alias("x")).select("fp", "node", "x.c", "x.key", "x.rest")
    crowded = rows.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("c", "key")
    crowded = written(crowded, "crowded")
    coarse = rows.join(crowded, ["c", "key"], "left_anti").select("fp", "node", "c", "key", F.lit(0).cast("long").alias("sub"))
    width = BITS - 2 * (BITS // (radius + 2))
    subs = [F.shiftleft(_bits("rest", list(four)), 8).bitwiseOR(F.lit(k + 1).cast("long")) for k, four in enumerate(itertools.combinations(_cuts(width, radius + 4), 4))]
    finer = rows.join(crowded, ["c", "key"], "left_semi").select("fp", "node", "c", "key", F.explode(F.array(*subs)).alias("sub"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def group(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        i, j = near_pairs(cols[0].view(np.uint64), radius)
        if len(i):
            low = union_find(len(cols[0]), i, j)
            linked = np.flatnonzero(low != np.arange(len(low)))
            yield pa.RecordBatch.from_arrays([pa.array(cols[1][linked]), pa.array(cols[1][low[linked]])], schema.names)

    return map_runs(coarse.unionByName(finer), ["c", "key", "sub"], [], group, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``,
    the smallest id reachable over links of at most ``radius`` differing bits.

    Rows of one fingerprint are one node, so thousands of copies cost one. A
    null or wordless text has fingerprint zero, linked like any other. A null
    id stays null and never names a component (which is null where no row has
    an id); rows that repeat an id are kept. Other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    comp = connected_components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    named = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named")
    lows = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    named = named.join(lows, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose id names its group, of rows with one id the first by text, and rows with a null id."""
    keep = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row")).join(keep, "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    one = rows.withColumn("rank", rank).where("rank = 1").select("row.*")
    return one.unionByName(docs.where(docs[id_col].isNull()))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest
    id; all columns unchanged. Rows that repeat that id are one document, of
    which the first by text stays. Rows with a null id all stay."""
    return first_of_groups(docs, near_duplicates(docs, id_col, text_col, radius, shingle), id_col, text_col)
