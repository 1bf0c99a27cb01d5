"""Chroma fingerprints of audio columns, and their alignment.

Recordings become frames of pitch-class energy; 16 rectangle filters over the
integral image of the frames, each quantised to two bits, give a packed 32-bit
code per frame. Codes vote for an earlier recording and an offset, and the
best-supported alignments are verified by their bit errors.

Short codes collide by chance, far more often than recordings match, so votes
are counted where the codes are: recordings are dealt into blocks of a bounded
number of codes, two blocks meet in a task, and only the best alignment of each
recording leaves it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .runs import map_runs

CLASSES = 12


@dataclass(frozen=True)
class Chroma:
    """How recordings are read: mono PCM of ``width`` bytes a sample (1: unsigned, 2: signed little-endian)."""

    rate: int = 11025
    width: int = 2
    frame: int = 4096
    hop: int = 1365
    low_hz: float = 55.0
    high_hz: float = 3520.0
    #: One code in so many (chosen by its own value) is indexed.
    every: int = 4
    #: Votes and bit error rate that an alignment needs.
    votes: int = 3
    errors: float = 0.15


#: Codes of a block, collisions of codes that are counted at once, and bits of the cells that first count them.
BLOCK_CODES = 3_000_000
COLLISIONS = 1 << 18
CELLS = 20
#: Widest filter in frames; a recording has that many codes less one than frames.
WIDEST = 16


@lru_cache
def filters() -> tuple[tuple[int, int, int, int], ...]:
    """(shape, first class, classes, frames) of the 16 filters, by rule: shapes
    take turns, widths double from 4 to ``WIDEST``, bands step through the classes."""
    out = []
    for i in range(16):
        height = 2 + (5 * i) % 10
        out.append((i % 5, (7 * i) % (CLASSES - height + 1), height, (4, 8, 16)[i % 3]))
    return tuple(out)


@lru_cache
def _fold(rate: int, frame: int, low: float, high: float) -> np.ndarray:
    """Bins to pitch classes."""
    hz = np.arange(frame // 2 + 1) * rate / frame
    out = np.zeros((len(hz), CLASSES), np.float32)
    use = np.flatnonzero((hz >= low) & (hz <= high))
    out[use, np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1
    return out


def pitch_classes(pcm: bytes, c: Chroma) -> np.ndarray:
    """Frames by 12 of pitch-class energy, each frame scaled to length 1 (silence: 0)."""
    raw = np.frombuffer(pcm[:len(pcm) // c.width * c.width], "u1" if c.width == 1 else "<i2").astype(np.float32)
    raw = (raw - 128) / 128 if c.width == 1 else raw / 32768
    if len(raw) < c.frame:
        return np.zeros((0, CLASSES), np.float32)
    window, fold = np.hanning(c.frame).astype(np.float32), _fold(c.rate, c.frame, c.low_hz, c.high_hz)
    frames = np.lib.stride_tricks.sliding_window_view(raw, c.frame)[::c.hop]
    parts = []
    for s in range(0, len(frames), 2048):
        spectrum = np.fft.rfft(frames[s:s + 2048] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        parts.append(power @ fold)
    chroma = np.concatenate(parts)
    norm = np.linalg.norm(chroma, axis=1, keepdims=True)
    return np.where(norm > 1e-9, chroma / np.maximum(norm, 1e-9), 0).astype(np.float32)


def codes(chroma: np.ndarray) -> np.ndarray:
    """Packed 32-bit codes: one per frame that has ``WIDEST`` frames from it on."""
    n = len(chroma) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, CLASSES + 1))
    image[1:, 1:] = chroma.cumsum(0, dtype=np.float64).cumsum(1)
    t = np.arange(n)

    def area(from_t: int, to_t: int, low: int, high: int) -> np.ndarray:
        a, b = t + from_t, t + to_t
        return image[b, high] - image[a, high] - image[b, low] + image[a, low]

    out = np.zeros(n, np.uint32)
    for shape, low, height, width in filters():
        high, mid_b, mid_t = low + height, low + height // 2, width // 2
        whole = area(0, width, low, high)
        if shape == 0:  # lower classes against upper
            one = area(0, width, low, mid_b)
        elif shape == 1:  # first half against second
            one = area(0, mid_t, low, high)
        elif shape == 2:  # quarters crosswise
            one = area(0, mid_t, low, mid_b) + area(mid_t, width, mid_b, high)
        elif shape == 3:  # middle classes against outer
            one = area(0, width, low + height // 4, high - height // 4)
        else:  # middle frames against outer
            one = area(width // 4, width - width // 4, low, high)
        value = np.log((1 + one) / (1 + np.maximum(whole - one, 0)))
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code
    return out


def fingerprints(df: DataFrame, c: Chroma, id_col: str, audio_col: str) -> DataFrame:
    """``id``, ``n_frames``, ``codes`` (little-endian 32-bit integers) of every recording."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_frames", T.LongType()), T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames, packed = [], []
            for x in b.column(1):
                chroma = pitch_classes(x.as_py() or b"", c)
                frames.append(len(chroma))
                packed.append(codes(chroma).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(frames, pa.int64()), pa.array(packed, pa.binary())], schema.names)

    return df.select(df[id_col].cast("long").alias("id"), df[audio_col].cast("binary").alias("audio")).mapInArrow(run, schema)


def _verified(pairs: DataFrame, errors: float) -> DataFrame:
    """Alignments whose share of differing bits is at most ``errors``, with it."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, o in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(2).to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                u, v = u[max(0, o):], v[max(0, -o):]
                n = min(len(u), len(v))
                out.append(float(np.bitwise_count(u[:n] ^ v[:n]).mean() / 32) if n else 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.float64())], ["id", "match_id", "offset", "votes", "bit_errors"])

    seen = pairs.select("id", "match_id", "offset", "votes", "codes", "other").mapInArrow(verify, "id long, match_id long, offset long, votes long, bit_errors double")
    return seen.where(F.col("bit_errors") <= errors)


def _with_matches(prints: DataFrame, seen: DataFrame, id_col: str) -> DataFrame:
    """Every recording, with its sums and the match of ``seen``."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([zlib.crc32(x) for x in packed], pa.int64())], ["id", "n_frames", "n_codes", "codes_crc32"])

    return prints.mapInArrow(sums, "id long, n_frames long, n_codes long, codes_crc32 long").join(seen, "id", "left").withColumnRenamed("id", id_col)


def align(df: DataFrame, c: Chroma, id_col: str = "id", audio_col: str = "audio") -> DataFrame:
    """One row per recording: the id, ``n_frames``, ``n_codes``, ``codes_crc32``,
    and of its best alignment with an earlier recording (smaller id) ``match_id``,
    ``offset`` (frames by which this one runs ahead), ``votes``, ``bit_errors``
    (share of differing bits where the two overlap); null without one.

    Each indexed code names the earliest recording that holds it (and where
    first), so a recording casts no more votes than it has codes, however often
    a code occurs. Votes are counted per earlier recording and offset; the
    alignment with the most (then the smallest id and offset) is verified.

    A null or short recording has no codes and no match; a null id is never
    matched with nor matched; rows that repeat an id are one recording (the
    longest, then the first by codes) for the index and get the same match.
    """
    prints = written(fingerprints(df, c, id_col, audio_col), "prints")
    unique = prints.where("id is not null").groupBy("id").agg(F.max(F.struct(F.octet_length("codes").alias("n"), F.col("codes").alias("codes"))).alias("x")).select("id", "x.codes")
    unique = written(unique, "recordings")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code = np.frombuffer(x, "<u4")
                at = np.flatnonzero((code * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(c.every) == 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(code[at].astype(np.int64)), pa.array(at.astype(np.int64))], ["id", "code", "at"])

    index = written(unique.mapInArrow(explode, "id long, code long, at long"), "codes")
    first = written(index.groupBy("code").agg(F.min(F.struct("id", "at")).alias("f")).select("code", F.col("f.id").alias("match_id"), F.col("f.at").alias("there")), "first")
    votes = index.join(first, "code").where("match_id < id").groupBy("id", "match_id", (F.col("at") - F.col("there")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.where(F.col("votes") >= c.votes).groupBy("id").agg(F.max(F.struct("votes", (-F.col("match_id")).alias("m"), (-F.abs("offset")).alias("a"), F.col("offset").alias("offset"))).alias("b"))
    best = best.select("id", (-F.col("b.m")).alias("match_id"), F.col("b.offset").alias("offset"), F.col("b.votes").alias("votes"))
    pairs = best.join(unique, "id").join(unique.select(F.col("id").alias("match_id"), F.col("codes").alias("other")), "match_id")

    return _with_matches(prints, written(_verified(pairs, c.errors), "matches"), id_col)


class _Side:
    """Recordings of a block, by ascending id: their codes one after the other,
    and the places of each code in order."""

    def __init__(self, ids: np.ndarray, packed: list[bytes]):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        n = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))[order]
        self.codes = np.frombuffer(b"".join([packed[k] for k in order.tolist()]), "<u4")
        self.start = np.concatenate(([0], np.cumsum(n)))
        self.owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.keys = np.sort(self.codes.astype(np.uint64) << np.uint64(32) | np.arange(len(self.codes), dtype=np.uint64))


def _collisions(x: _Side, y: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal codes, of ``x`` and of earlier recordings of ``y``, for a few
    whole recordings of ``x`` at a time."""
    code = x.codes.astype(np.uint64) << np.uint64(32)
    before = y.start[np.searchsorted(y.ids, x.ids, "left")].astype(np.uint64)  # places of earlier recordings
    low, high = np.searchsorted(y.keys, code, "left"), np.searchsorted(y.keys, code | before[x.owner], "left")
    place = (y.keys & np.uint64(0xFFFFFFFF)).astype(np.int32)
    upto = np.concatenate(([0], np.cumsum(high - low)))[x.start]
    first = 0
    while first < len(x.ids):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + COLLISIONS, "right")) - 1)
        a, b = x.start[first], x.start[last]
        count = high[a:b] - low[a:b]
        if upto[last] > upto[first]:
            p = np.repeat(np.arange(a, b, dtype=np.int32), count)
            yield p, place[np.arange(len(p)) + np.repeat(low[a:b] - (np.cumsum(count) - count), count)]
        first = last


def _errors(x: _Side, y: _Side, i: np.ndarray, j: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Share of differing bits where recording ``i`` of ``x``, ``offset`` codes ahead, overlaps ``j`` of ``y``."""
    u, v = x.start[i] + np.maximum(0, offset), y.start[j] + np.maximum(0, -offset)
    n = np.minimum(x.start[i + 1] - u, y.start[j + 1] - v)
    out, upto = np.empty(len(i)), np.concatenate(([0], np.cumsum(n)))
    first = 0
    while first < len(i):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + COLLISIONS, "right")) - 1)
        k = n[first:last]
        step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        bits = np.bitwise_count(x.codes[np.repeat(u[first:last], k) + step] ^ y.codes[np.repeat(v[first:last], k) + step])
        out[first:last] = np.add.reduceat(bits, np.cumsum(k) - k, dtype=np.int64) / k / 32
        first = last
    return out


def best_alignments(x: _Side, y: _Side, c: Chroma) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each recording of ``x`` that has one, the best alignment with an earlier
    one of ``y``: id, match_id, offset, votes, bit errors. Cells of a hash of
    recordings and offset count collisions first, so that only those of cells with
    enough of them are sorted."""
    for p, q in _collisions(x, y):
        i, ahead = x.owner[p], p - q  # of one recording, this names the offset and the other one
        cell = (i.view(np.uint32) * np.uint32(0x9E3779B1) + ahead.view(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CELLS)
        some = np.bincount(cell, minlength=1 << CELLS)[cell] >= c.votes
        i, j = i[some].astype(np.int64), y.owner[q[some]].astype(np.int64)
        offset = p[some] - x.start[i] - (q[some] - y.start[j])
        if not len(i):
            continue
        order = np.lexsort((offset, j, i))
        i, j, offset = i[order], j[order], offset[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (offset[1:] != offset[:-1])
        at = np.flatnonzero(new)
        votes = np.diff(np.append(at, len(i)))
        at, votes = at[votes >= c.votes], votes[votes >= c.votes]
        i, j, offset = i[at], j[at], offset[at]
        errors = _errors(x, y, i, j, offset)
        ok = errors <= c.errors
        i, j, offset, votes, errors = i[ok], j[ok], offset[ok], votes[ok], errors[ok]
        order = np.lexsort((offset, -np.abs(offset), -y.ids[j], votes, i))
        top = order[np.append(i[order][1:] != i[order][:-1], True)] if len(order) else order
        yield x.ids[i[top]], y.ids[j[top]], offset[top], votes[top], errors[top]


def align_all(df: DataFrame, c: Chroma, id_col: str = "id", audio_col: str = "audio", block: int = BLOCK_CODES) -> DataFrame:
    """As :func:`align`, over every code and place of every earlier recording
    (``every`` is not used): all alignments of ``votes`` or more are verified, and
    of those that hold the one with the most votes is taken, then the one with the
    smallest id and offset. Recordings of equal codes match the earliest of them
    however few their codes are.

    Recordings of equal codes are one in the index. Blocks of ``block`` codes (a
    recording is never cut) meet two at a time: what travels and what is counted
    grows with the square of the different recordings.
    """
    prints = written(fingerprints(df, c, id_col, audio_col), "prints")
    unique = prints.where("id is not null").groupBy("id").agg(F.max(F.struct(F.octet_length("codes").alias("n"), F.col("codes").alias("codes"))).alias("x")).select("id", "x.codes")
    unique = written(unique.where(F.octet_length("codes") > 0), "recordings")
    firsts = written(unique.groupBy("codes").agg(F.min("id").alias("id")).select("id", "codes"), "firsts")

    total = firsts.agg(F.sum(F.octet_length("codes").cast("long"))).first()[0] or 0
    blocks = total // (4 * block) + 1
    own = F.expr(f"pmod(xxhash64(id), {blocks})")
    meet = F.expr(f"transform(sequence(0L, {blocks - 1}), o -> named_struct('x', least(o, own), 'y', greatest(o, own)))")
    dealt = firsts.withColumn("own", own).select("id", "codes", "own", F.explode(meet).alias("p")).select("p.x", "p.y", "own", "id", "codes")
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("id", "match_id", "offset", "votes")), T.StructField("bit_errors", T.DoubleType())])

    def group(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        left = cols[2] == cols[0][0]
        if cols[0][0] != cols[1][0] and left.all() == left.any():
            return  # one block is empty
        x = _Side(cols[3][left], cols[4][left].tolist())
        y = x if cols[0][0] == cols[1][0] else _Side(cols[3][~left], cols[4][~left].tolist())
        for one, two in ((x, y), (y, x))[:1 + (x is not y)]:
            for found in best_alignments(one, two, c):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], schema.names)

    found = map_runs(dealt, ["x", "y"], [], group, schema)
    best = found.groupBy("id").agg(F.max(F.struct("votes", (-F.col("match_id")).alias("m"), (-F.abs("offset")).alias("a"), "offset", "bit_errors")).alias("b"))
    best = written(best.select(F.col("id").alias("first"), F.col("b.votes").alias("votes"), (-F.col("b.m")).alias("match_id"), F.col("b.offset").alias("offset"), F.col("b.bit_errors").alias("bit_errors")), "best")
    # a copy has all votes with the first of its codes; only an earlier recording that holds them all goes before it
    rows = unique.join(firsts.withColumnRenamed("id", "first"), "codes").select("id", "first", F.floor(F.octet_length("codes") / 4).cast("long").alias("n")).join(best, "first", "left")
    own = (F.col("id") != F.col("first")) & (F.coalesce("votes", F.lit(0)) < F.col("n"))
    seen = rows.select("id", F.when(own, F.col("first")).otherwise(F.col("match_id")).alias("match_id"), F.when(own, 0).otherwise(F.col("offset")).alias("offset"),
                       F.when(own, F.col("n")).otherwise(F.col("votes")).alias("votes"), F.when(own, 0.0).otherwise(F.col("bit_errors")).alias("bit_errors"))
    return _with_matches(prints, written(seen.where("match_id is not null"), "matches"), id_col)
