"""Near copies by SimHash and shingle overlap, for filtering stages.

Two bits of a fingerprint are a narrow radius: a text with one changed word in
twenty differs in up to a dozen. This widens the SimHash operator's reach:
fingerprints meet in tables keyed by random bits, each proposes its nearest
neighbours there (pivot tables narrow whom it looks at), and a proposal holds
if the texts' sets of five-word shingles overlap by 0.8 or more. This joins most
copies in linear work; a join on the prefixes of the shingle sets then finds
every other pair of that overlap, so the groups do not depend on the tables.

Sets travel once, into a table bucketed by node; later joins bring only pairs to
it. The prefix join keeps the keys that two groups share, links each set with
the next ones of its key first, and then compares all pairs of different groups,
crowded keys in bounded pieces. Parity bitmaps, whose differing bits are a lower
bound on the shingles that two sets do not share, discard nearly all pairs that
are not linked before their sets are looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, remove, slices, trimmed, work_path, written, written_at
from .runs import map_runs
from .simhash import BITS, fingerprint, first_of_groups, pivots

RADIUS = 12
TABLES = 32
SHINGLE = 5
SIMILARITY = 0.8
#: Hashes that a sketch keeps, the smallest ones; sets up to this size are compared exactly. Groups are made from whole sets.
SKETCH = 512
WHOLE = 1 << 62
#: Fingerprints under a key before finer keys replace it, and sets of a prefix key that are compared in one piece.
HOT_KEY = 2048
FINER = 8
#: Proposals of a fingerprint, over all tables, that are verified before the prefix join: the nearest.
BEST = 6
#: Sets after a set, by size, among which the linear round looks, and how many of them it proposes.
AHEAD, NEXT = 64, 2
#: Bits of a set's parity bitmap.
PARITY = 512
#: Cells that count shingle hashes; the order of prefixes is by cell, the emptiest first.
CELLS, CELL_BLOCK = 1 << 18, 1 << 12
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sketch(text: bytes | None, shingle: int = SHINGLE, size: int = SKETCH) -> bytes:
    """The smallest hashes of the set of a text's word shingles, ascending, as
    little-endian 32-bit integers; over the whole text."""
    words = (text or b"").translate(_UPPER).split()
    if not words:
        return b""
    n = max(1, len(words) - shingle + 1)
    digest, joined = xxhash.xxh3_64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[shingle - 1:].tolist() if len(words) >= shingle else [len(joined)]
    view = memoryview(joined)
    h = np.fromiter((digest(view[s:e]) for s, e in zip(starts, stops, strict=True)), np.uint64, n)
    return np.unique((h >> np.uint64(32)).astype("<u4"))[:size].tobytes()


def overlap(a: bytes, b: bytes, size: int = SKETCH) -> float:
    """Jaccard similarity of two shingle sets from their sketches: exact where both
    are whole, else the share of the smallest hashes of the union that both hold."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    union = np.union1d(x, y)
    if len(x) == size or len(y) == size:
        union = union[:size]
    both = np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)
    return float(both.mean())


def _keys(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for b in bits.tolist():
        out = (out << np.uint64(1)) | ((fps >> np.uint64(b)) & np.uint64(1))
    return out.view(np.int64)


def nearest(fps: np.ndarray, radius: int, k: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each fingerprint to its ``k`` nearest and its nearest earlier one (of
    smaller place) within ``radius`` bits, with distances; ties go to the earlier."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int16)
    axis = int(np.argmax(table.std(0)))
    order = np.argsort(table[:, axis], kind="stable")
    t, f, place = table[order, axis], fps[order], order
    low, high = np.searchsorted(t, t - radius, "left"), np.searchsorted(t, t + radius, "right")
    never = np.iinfo(np.int64).max
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(f), 256):
        e = min(len(f), s + 256)
        a, b = int(low[s:e].min()), int(high[s:e].max())
        d = np.bitwise_count(f[s:e, None] ^ f[None, a:b]).astype(np.int64)
        d = d * len(f) + place[None, a:b]  # ties by place
        rows = np.arange(e - s)
        d[rows, np.arange(s, e) - a] = never
        some = min(k, d.shape[1])
        at = [*np.argpartition(d, some - 1, axis=1)[:, :some].T, np.where(place[None, a:b] < place[s:e, None], d, never).argmin(1)]
        earlier = place[s:e] > place[a:b][at[-1]]
        for c, m in enumerate(at):
            ok = d[rows, m] < (radius + 1) * len(f)
            if c == some:
                ok &= earlier
            out.append((place[s:e][ok], place[a:b][m[ok]], d[rows, m][ok] // len(f)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _proposals(nodes: DataFrame, radius: int, tables: int, hot: int) -> DataFrame:
    """Pairs ``a``, ``b`` of fingerprints that some table's neighbours propose."""
    n = nodes.count()
    width = int(min(48, max(8, np.ceil(np.log2(max(n, 2) / 64)))))
    rng = np.random.default_rng(11)
    picks = [rng.permutation(BITS) for _ in range(tables)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for c, pick in enumerate(picks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), c)), pa.array(_keys(fp.view(np.uint64), pick[:width])), pa.array(np.zeros(len(fp), np.int64)), pa.array(fp)], ["c", "key", "sub", "fp"])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sub-keys of eight more bits each, from those the key leaves."""
        for b in batches:
            c, fp = b.column(0).to_numpy(), b.column(3).to_numpy()
            for k in range(FINER):
                sub = np.empty(len(fp), np.int64)
                for t in np.unique(c).tolist():
                    at = np.flatnonzero(c == t)
                    rest = np.roll(picks[t][width:], -k * 5)
                    sub[at] = _keys(fp[at].view(np.uint64), rest[:8]) * FINER + k + 1
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sub), pa.array(fp)], ["c", "key", "sub", "fp"])

    kind = "c long, key long, sub long, fp long"
    rows = nodes.select("fp").mapInArrow(trimmed(spread), kind)
    crowded = written(rows.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("c", "key"), "crowded")
    coarse = rows.join(crowded, ["c", "key"], "left_anti")
    fine = rows.join(crowded, ["c", "key"], "left_semi").select("c", "key", "sub", "fp").mapInArrow(trimmed(finer), kind)

    def group(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp = np.sort(cols[3])
        i, j, d = nearest(fp.view(np.uint64), radius)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j]), pa.array(d)], ["x", "y", "d"])

    found = map_runs(coarse.select("c", "key", "sub", "fp").unionByName(fine), ["c", "key", "sub"], [], group, "x long, y long, d long")
    # at most four a table come from a fingerprint, so what is collected for one is bounded
    best = found.groupBy("x").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "y"))), 1, BEST).alias("ys"))
    best = best.select("x", F.explode("ys.y").alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _cells(sets: DataFrame) -> np.ndarray:
    """Shingle hashes of all sets by cell."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CELLS, np.int64)
        for b in batches:
            np.add.at(out, np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4") % CELLS, 1)
        parts = out.reshape(-1, CELL_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "counts"])

    def total(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CELL_BLOCK, np.int64)
        for x in cols[1]:
            out += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0][:1]), pa.array([out.tobytes()], pa.binary())], ["block", "counts"])

    kind = "block long, counts binary"
    got = sorted(map(tuple, map_runs(sets.select("set").mapInArrow(trimmed(count), kind), ["block"], [], total, kind, 1).collect()))
    return np.concatenate([np.frombuffer(x, np.int64) for _, x in got]) if got else np.zeros(CELLS, np.int64)


def prefix(hashes: np.ndarray, cells: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set, by count of their cell and value, of which two
    sets that overlap by ``similarity`` share one at least."""
    n = len(hashes)
    k = n - int(np.ceil(similarity * n - 1e-9)) + 1
    return hashes[np.lexsort((hashes, cells[hashes % CELLS]))[:k]] if n else hashes


def parity(hashes: np.ndarray) -> bytes:
    """``PARITY`` bits, each the parity of the hashes that fall on it. Bits differ
    in no more places than there are hashes that only one of two sets holds."""
    return np.packbits(np.bincount(hashes % PARITY, minlength=PARITY).astype(np.uint8) & 1, bitorder="little").tobytes()


def close(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the bitmaps of the sets ``i`` and ``j`` let them overlap by ``similarity``."""
    return np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) * (1 + similarity) <= (n[i] + n[j]) * (1 - similarity) + 1e-6


def fits(n: np.ndarray, at: np.ndarray, component: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets ``i`` and ``j``, which share a hash, are of different
    components and may overlap by ``similarity``, judged by their sizes ``n`` and
    the places ``at`` of the hash in them."""
    most = np.minimum(n[i] - at[i], n[j] - at[j])
    return (component[i] != component[j]) & (n[j] * similarity <= n[i] + 1e-9) & (most * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6)


def candidates(n: np.ndarray, at: np.ndarray, component: np.ndarray, bits: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs that fit, among sets (by ascending ``n``) that share a hash."""
    stop = np.searchsorted(n, n / similarity + 1e-9, "right")
    for s in range(0, len(n), 256):
        e = min(len(n), s + 256)
        j = np.arange(s, int(stop[s:e].max()))
        i = np.arange(s, e)[:, None]
        x, y = np.nonzero((j > i) & fits(n, at, component, i, j, similarity))
        x, y = x + s, y + s
        ok = close(n, bits, x, y, similarity)
        if ok.any():
            yield x[ok], y[ok]


def following(n: np.ndarray, at: np.ndarray, component: np.ndarray, bits: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of those pairs, each set's first ``NEXT`` among the ``AHEAD`` sets after it."""
    chosen = np.zeros(len(n), np.int64)
    for step in range(1, min(AHEAD + 1, len(n))):
        i = np.arange(len(n) - step)
        i = i[fits(n, at, component, i, i + step, similarity) & (chosen[i] < NEXT)]
        i = i[close(n, bits, i, i + step, similarity)]
        chosen[i] += 1
        if len(i):
            yield i, i + step


def _prefixes(nodes: DataFrame, cells: np.ndarray, similarity: float) -> DataFrame:
    """The prefix hashes of nodes' sets: ``key``, size ``n`` and place ``at``, node and component."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.frombuffer(x.as_py(), "<u4") for x in b.column(2)]
            keys = [prefix(x, cells, similarity) for x in sets]
            size = np.fromiter(map(len, keys), np.int64, len(keys))
            if not size.sum():
                continue
            cols = [np.concatenate(keys).view("<i4"), np.repeat(np.fromiter(map(len, sets), np.int32, len(sets)), size), np.concatenate([np.arange(k, dtype=np.int32) for k in size.tolist()]),
                    np.repeat(b.column(0).to_numpy(), size), np.repeat(b.column(1).to_numpy(), size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "n", "at", "node", "component"])

    return nodes.select("node", "component", "set").mapInArrow(trimmed(spread), "key int, n int, at int, node long, component long")


def _shared(rows: DataFrame) -> DataFrame:
    """The keys that two components hold; minima and maxima meet, not rows."""
    return rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")


def _paired(rows: DataFrame, pick, similarity: float, keys: list[str]) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes that ``pick`` takes in each group of ``keys``."""
    def group(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n, at, node, component = cols[-5].astype(np.int64), cols[-4].astype(np.int64), cols[-3], cols[-2]
        if (component == component[0]).all():
            return
        bits = np.frombuffer(b"".join(cols[-1]), "<u8").reshape(len(n), -1)
        for i, j in pick(n, at, component, bits, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    return map_runs(rows.select(*keys, "n", "at", "node", "component", "bits"), keys, ["n", "at"], group, "a long, b long").distinct()


def _following(rows: DataFrame, similarity: float, hot: int) -> DataFrame:
    """A linear number of the pairs that may be linked; crowded keys are dealt out by node."""
    counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot), "counts")
    rows = rows.join(counts, "key", "left").withColumn("x", F.expr(f"pmod(xxhash64(node), coalesce(ceil(m / {hot}), 1L))"))
    return _paired(rows, following, similarity, ["key", "x"])


def _pieces(rows: DataFrame, hot: int) -> DataFrame:
    """Rows of shared keys in groups ``key``, ``x``, ``y`` of about twice ``hot`` rows
    at most, in one of which every two rows of different components meet.

    A key's largest component and its other rows are each cut into pieces; every
    piece of the one meets every piece of the others, and these meet each other.
    So where nearly all rows of a crowded key are of one component, they are
    hardly repeated.
    """
    per = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    top = per.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("total"), F.count(F.lit(1)).alias("c"))
    top = written(top.where("c > 1").selectExpr("key", "top.component as top", f"ceil(top.m / {hot}) as ones", f"ceil((total - top.m) / {hot}) as others"), "tops")
    dealt = rows.join(top, "key").withColumn("own", F.expr("pmod(xxhash64(node), if(component = top, ones, others))"))
    apart = "filter(sequence(0L, others - 1), o -> o <> own)"
    places = F.expr(f"""if(component = top, transform(sequence(0L, others - 1), o -> named_struct('x', own, 'y', o)),
        concat(transform(sequence(0L, ones - 1), o -> named_struct('x', o, 'y', own)), transform({apart}, o -> named_struct('x', -1 - least(o, own), 'y', greatest(o, own)))))""")
    return dealt.select("key", "n", "at", "node", "component", "bits", F.explode(places).alias("p")).select("key", "p.x", "p.y", "n", "at", "node", "component", "bits")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, tables: int = TABLES, hot: int = HOT_KEY) -> DataFrame:
    """Per row: the id and ``component_id``, the smallest id reachable over links.

    Two texts are linked if their sets of five-word shingles overlap by
    ``similarity``, compared whole (as 32-bit hashes). Texts of equal sets are
    one node. Nodes of one fingerprint are compared with the first of them, and
    fingerprints with the ``BEST`` nearest that the tables propose (three, and the
    nearest smaller one, a table, within ``radius`` bits); that joins groups of
    copies in linear work. Then all pairs of different groups that share a hash in
    the prefixes of their sets are compared, which are all that may be linked:
    ``radius``, ``tables`` and ``hot`` change the work and not the groups. Null
    and wordless texts are one group; null ids never name a component. Ids are
    cast to long; other columns are ignored.
    """
    spark = docs.sparkSession

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t.as_py() for t in b.column(1)]
            fps = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
            sets = [sketch(t, size=WHOLE) for t in texts]
            nodes = np.fromiter(map(xxhash.xxh3_64_intdigest, sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(nodes.view(np.int64)), pa.array(sets, pa.binary())], ["id", "fp", "node", "set"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    rows, rows_path = written_at(rows.mapInArrow(trimmed(prints), "id long, fp long, node long, set binary"), "prints")
    name, path = f"sets_{uuid.uuid4().hex}", work_path(spark, "sets")
    nodes = rows.groupBy("node").agg(F.min("id").alias("low"), F.min("fp").alias("fp"), F.first("set").alias("set"))
    nodes.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").saveAsTable(name)
    nodes = spark.table(name)
    ids = written(rows.select("id", "node"), "ids")
    remove(spark, rows_path)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [overlap(x.as_py(), y.as_py(), WHOLE) >= similarity for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parity(np.frombuffer(x.as_py(), "<u4")) for x in b.column(1)], pa.binary())], ["node", "bits"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        # only the sets in question, and written, so that the joins' sides are plain exchanges and a hot end can be split
        s = written(nodes.select("node", "set").join(ends, "node"), "ends")
        both = pairs.join(s.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(s.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(trimmed(verify), "a long, b long")

    def settled(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
        if before is not None:
            links = links.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return written(connected_components(links), "groups")

    def regrouped(frame: DataFrame, groups: DataFrame) -> DataFrame:
        return frame.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))

    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    same = nodes.select("node", "fp").join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = _proposals(firsts, radius, tables, hot)
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = settled(verified(same.unionByName(near)))

    prefixes = _prefixes(regrouped(nodes.select("node", "set"), groups), _cells(nodes), similarity)
    live = written(prefixes.join(written(_shared(prefixes), "shared"), "key", "left_semi"), "live")
    live = written(live.join(written(nodes.select("node", "set").mapInArrow(trimmed(bitmaps), "node long, bits binary"), "bitmaps"), "node"), "live")
    groups = settled(verified(_following(live, similarity, hot)), groups)
    live = written(regrouped(live, groups).select(live.columns), "live")
    groups = settled(verified(_paired(_pieces(live, hot), candidates, similarity, ["key", "x", "y"])), groups)

    named = written(regrouped(nodes.select("node", "low"), groups), "named")
    spark.sql(f"DROP TABLE {name}")
    remove(spark, path)
    lows = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    return ids.join(named.join(lows, "component").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id;
    all columns unchanged. Rows that repeat that id are one document, of which
    the first by text stays. Rows with a null id all stay."""
    return first_of_groups(docs, near_copies(docs, id_col, text_col, **options), id_col, text_col)
