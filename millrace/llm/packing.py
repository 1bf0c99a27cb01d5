"""Shortest-pack-first over the length histogram.

Documents become pieces of at most ``size`` ids; only the histogram of piece
lengths (``size`` numbers) comes to the driver. Lengths are placed longest
first, always into the shortest open pack, a whole group of equal packs at a time;
what results are counted packing patterns. Pieces of a
length are then numbered across all tasks, in the order of the files they come
from, and a piece's number tells its pattern, sequence and offset: sequences of
one pattern follow the order of the input.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, trimmed, written
from .tokens import encoder, read_spec

SEQUENCE = 2048


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns: (number of packs, lengths in each) for piece counts by
    length. Every piece is in exactly one pack and no pack exceeds ``size``."""
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    heap: list[int] = []

    def push(total: int, n: int, pattern: tuple[int, ...]) -> None:
        if total not in groups:
            groups[total] = []
            heapq.heappush(heap, total)
        groups[total].append((n, pattern))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} outside 1..{size}")
        left = counts[length]
        while left and heap and heap[0] + length <= size:
            total = heap[0]
            n, pattern = groups[total].pop()
            if not groups[total]:
                del groups[total]
                heapq.heappop(heap)
            take = min(n, left)
            if take < n:
                push(total, n - take, pattern)
            push(total + length, take, (*pattern, length))
            left -= take
        each = size // length
        if left >= each:
            push(each * length, left // each, (length,) * each)
        if left % each:
            push(left % each * length, 1, (length,) * (left % each))
    return [g for total in sorted(groups, reverse=True) for g in groups[total]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length and range of piece numbers, the first sequence and the offset.

    Its size is bounded by the patterns, which the ``size`` lengths bound,
    whatever the number of documents.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), cols, strict=True))


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    A null text is empty and has its end id only; a null id stays null; rows
    that repeat an id are packed as documents of their own; other columns are
    ignored; an empty table gives no rows. Documents read from one table of files
    are numbered in the order of the files. Long documents are cut at multiples
    of ``size``, so whole pieces fill sequences of their own.
    """
    spec = read_spec(tokenizer)
    kinds = {"id": docs.schema[id_col].dataType, **{n: T.LongType() for n in ("start", "length", "ids_crc32", "doc_tokens", "part", "number", "begin")}, "file": T.StringType()}
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        end = np.array([end_id], "<u4")
        part = TaskContext.get().partitionId()
        seen, source = np.zeros(size + 1, np.int64), None
        for b in slices(batches):
            owner: list[int] = []
            rows: list[tuple[int, int, int, int, int, int]] = []
            sources = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            for at, got in enumerate(enc.encode(b.column(1).to_pylist())):
                if sources[at] != source:  # the rows of a split are side by side
                    seen[:], source = 0, sources[at]
                ids = np.concatenate((got.astype("<u4"), end))
                for start in range(0, len(ids), size):
                    piece = ids[start:start + size]
                    n = len(piece)
                    rows.append((start, n, zlib.crc32(piece), len(ids), part, int(seen[n])))
                    owner.append(at)
                    seen[n] += 1
            cols = np.array(rows, np.int64).reshape(-1, 6).T
            owners = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), owners), *(pa.array(c) for c in cols), pc.take(b.column(3), owners), pc.take(b.column(2), owners)], schema.names)

    # empty and -1 but for files; what is made of several sources has no file
    one = docs._jdf.queryExecution().analyzed().collectLeaves().size() == 1
    split = (F.input_file_name() if one else F.lit("")).alias("file"), (F.input_file_block_start() if one else F.lit(-1).cast("long")).alias("begin")
    pieces = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"), *split).mapInArrow(trimmed(cut), schema)
    pieces = written(pieces, "pieces")
    counts = written(pieces.groupBy("file", "begin", "part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(pack_histogram(histogram, size))
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    ahead = counts.select("file", "begin", "part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy(number, "file", "begin", "part")) - F.col("n")).alias("ahead"))
    # counts grow with the tasks: sorted and merged, never broadcast
    ranked = pieces.join(ahead.hint("merge"), ["file", "begin", "part", "length"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("number")).alias("number"))
    out = T.StructType([T.StructField(id_col, kinds["id"]), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = int(table["first"].max(initial=0)) + 1
        keys = table["length"] * step + table["first"]
        for b in batches:
            length, number = b.column(2).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, length * step + np.minimum(number, step - 1), "right") - 1
            sequence = table["sequence"][at] + number - table["first"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(table["offset"][at])], out.names)

    return ranked.mapInArrow(trimmed(place), out)
