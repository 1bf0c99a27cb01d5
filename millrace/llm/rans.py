"""Token-id archives: static range asymmetric numeral systems.

An archive is a folder of files in ascending document order. A file is a run
of segments, each followed by one newline byte; the writer puts one segment in a
file, which bounds a file's bytes whatever the corpus:

    magic, header length, JSON header, body, newline

A segment holds consecutive documents and one frequency table, shared by all
of its blocks. A block is decoded on its own: ``lanes`` interleaved coder
states, the 32-bit words they emit in decoding order, checkpoints (states and
word position) inside the block, and a CRC-32 of its bytes. Frequencies are
counted over all ids of the segment and scaled to ``2**PRECISION``.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written
from .tokens import encoder, read_spec

MAGIC = b"MRANS1\n\0"
PRECISION = 20
LANES = 1024
BLOCK_TOKENS = 1 << 18
CHECKPOINT_STEPS = 128
SEGMENT_TOKENS = 1 << 22
_LOW = np.uint64(1 << 31)
_P = np.uint64(PRECISION)
_32 = np.uint64(32)
_MASK32 = np.uint64(0xFFFFFFFF)
_SLOTS = np.uint64((1 << PRECISION) - 1)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts (all positive) as frequencies of at least 1 that sum to 2**PRECISION."""
    total = 1 << PRECISION
    if len(counts) > total:
        raise ValueError(f"more than {total} distinct ids")
    f = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    spare = total - int(f.sum())
    if spare > 0:
        f[order[0]] += spare
    while spare < 0:
        take = np.minimum(f[order] - 1, -(spare // len(f)) if -spare > len(f) else 1)
        cut = np.minimum(np.cumsum(take), -spare)
        f[order] -= np.diff(cut, prepend=0)
        spare = total - int(f.sum())
    return f


def encode_block(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int) -> tuple[dict, bytes]:
    """One block. ``symbols`` index the table."""
    n = len(symbols)
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks = []
    for t in range(steps - 1, -1, -1):
        s = symbols[t * lanes:(t + 1) * lanes]
        k = len(s)
        f, y = freq[s], x[:k]
        over = y >= (f << np.uint64(63 - PRECISION))
        out = (y[over] & _MASK32).astype("<u4")
        words.append(out)
        y = np.where(over, y >> _32, y)
        q = y // f
        x[:k] = (q << _P) + (y - q * f) + start[s]
        if t and t % CHECKPOINT_STEPS == 0:
            marks.append((t, x.copy()))
    words.reverse()
    at = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    marks.reverse()
    stream = np.concatenate(words) if words else np.zeros(0, "<u4")
    body = x.astype("<u8").tobytes() + b"".join(m.astype("<u8").tobytes() for _, m in marks) + stream.tobytes()
    head = {"n": n, "lanes": lanes, "marks": [[t, int(at[t])] for t, _ in marks], "bytes": len(body), "crc": zlib.crc32(body)}
    return head, body


def decode_block(head: dict, body: bytes, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Table indices of a block, or of its steps ``first`` to ``last`` only,
    begun at the nearest checkpoint before them."""
    if zlib.crc32(body) != head["crc"]:
        raise ValueError("block checksum differs")
    n, lanes, marks = head["n"], head["lanes"], head["marks"]
    steps = -(-n // lanes)
    last = steps if last is None else last
    size = 8 * lanes
    stream = np.frombuffer(body, "<u4", offset=size * (1 + len(marks)))
    begin, at, states = 0, 0, 0
    for i, (t, pos) in enumerate(marks):
        if t <= first:
            begin, at, states = t, pos, i + 1
    x = np.frombuffer(body, "<u8", lanes, size * states).copy()
    out = []
    for t in range(begin, last):
        k = min(lanes, n - t * lanes)
        y = x[:k]
        slot = y & _SLOTS
        s = slots[slot]
        y = freq[s] * (y >> _P) + slot - start[s]
        need = np.flatnonzero(y < _LOW)
        if len(need):
            y[need] = (y[need] << _32) | stream[at:at + len(need)]
            at += len(need)
        x[:k] = y
        if t >= first:
            out.append(s)
    return np.concatenate(out) if out else np.zeros(0, slots.dtype)


def decode_blocks(heads: list[dict], bodies: list[bytes], freq: np.ndarray, start: np.ndarray, slots: np.ndarray) -> list[np.ndarray]:
    """Table indices of blocks, all decoded at once from all of their checkpoints:
    what lies between two checkpoints is a stream of its own, and a step of the
    loop takes one step of every stream."""
    out = [np.empty(h["n"], slots.dtype) for h in heads]
    for head, body in zip(heads, bodies, strict=True):
        if zlib.crc32(body) != head["crc"]:
            raise ValueError("block checksum differs")
    for lanes in sorted({h["lanes"] for h in heads}):
        streams, words, held = [], [], 0  # (steps, block, first step, place of its words), states
        for k, (head, body) in enumerate(zip(heads, bodies, strict=True)):
            if head["lanes"] != lanes:
                continue
            marks = [[0, 0], *head["marks"]]
            states = np.frombuffer(body, "<u8", lanes * len(marks)).reshape(-1, lanes)
            ends = [t for t, _ in marks[1:]] + [-(-head["n"] // lanes)]
            streams += [(e - t, k, t, held + at, x) for (t, at), e, x in zip(marks, ends, states, strict=True)]
            words.append(np.frombuffer(body, "<u4", offset=8 * lanes * len(marks)))
            held += len(words[-1])
        streams.sort(key=lambda x: -x[0])
        stream = np.concatenate(words)
        x = np.stack([y for *_, y in streams])
        at = np.array([y[3] for y in streams])
        size = np.array([heads[k]["n"] - t * lanes for _, k, t, _, _ in streams])  # ids from the stream's first step on
        steps, lane = np.array([y[0] for y in streams]), np.arange(lanes)
        for j in range(int(steps.max(initial=0))):
            live = int(np.searchsorted(-steps, -j, "left"))
            slot = x[:live] & _SLOTS
            s = slots[slot]
            y = freq[s] * (x[:live] >> _P) + slot - start[s]
            need = (y < _LOW) & (lane < (size[:live] - j * lanes)[:, None])
            count = need.cumsum(1)
            y[need] = (y[need] << _32) | stream[(at[:live, None] + count - 1)[need]]
            at[:live] += count[:, -1]
            x[:live] = y
            for row, (_, k, t, _, _) in zip(s, streams, strict=False):
                part = out[k][(t + j) * lanes:(t + j + 1) * lanes]
                part[:] = row[:len(part)]
    return out


def encode_segment(doc_ids: list[int | None], ids: list[np.ndarray], end_id: int | None = None) -> bytes:
    """Bytes of a segment of documents' ids, with its closing newline."""
    lens = [len(i) for i in ids]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(flat):
        counts = np.bincount(flat)
        symbols = np.flatnonzero(counts)
        freq = scaled(counts[symbols].astype(np.float64))
    else:
        symbols, freq = np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.int64)
    index[symbols] = np.arange(len(symbols))
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    docs = zlib.compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
        + np.array(lens, "<i8").tobytes(), 6)
    blocks, bodies = [], []
    f64 = freq.astype(np.uint64)
    for at in range(0, len(flat), BLOCK_TOKENS):
        part = index[flat[at:at + BLOCK_TOKENS]]
        head, body = encode_block(part, f64, start, min(LANES, max(1, len(part) // 64)))
        blocks.append(head)
        bodies.append(body)
    head = json.dumps({"docs": len(lens), "symbols": len(symbols), "table": len(table), "table_crc": zlib.crc32(table),
                       "index": len(docs), "index_crc": zlib.crc32(docs), "blocks": blocks}, separators=(",", ":")).encode()
    return b"".join((MAGIC, len(head).to_bytes(8, "little"), head, table, docs, *bodies, b"\n"))


class Segment:
    """A segment as read; blocks are decoded one by one on demand."""

    def __init__(self, data: bytes, at: int):
        if data[at:at + 8] != MAGIC:
            raise ValueError("not a token-id segment")
        size = int.from_bytes(data[at + 8:at + 16], "little")
        self.head = json.loads(data[at + 16:at + 16 + size])
        self.data, at = data, at + 16 + size
        table, docs = data[at:at + self.head["table"]], data[at + self.head["table"]:at + self.head["table"] + self.head["index"]]
        if zlib.crc32(table) != self.head["table_crc"] or zlib.crc32(docs) != self.head["index_crc"]:
            raise ValueError("table or index checksum differs")
        raw = np.frombuffer(zlib.decompress(table), "<u4")
        k, n = self.head["symbols"], self.head["docs"]
        self.symbols = np.cumsum(raw[:k], dtype=np.int64).astype(np.uint32)
        freq = raw[k:].astype(np.int64)
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(k, dtype=np.uint32), freq)
        raw_docs = zlib.decompress(docs)
        missing = np.frombuffer(raw_docs, "u1", n, 8 * n)
        self.doc_ids = [None if m else d for d, m in zip(np.frombuffer(raw_docs, "<i8", n).tolist(), missing, strict=True)]
        self.lens = np.frombuffer(raw_docs, "<i8", n, 9 * n)
        self.at = at + self.head["table"] + self.head["index"]
        self.end = self.at + sum(b["bytes"] for b in self.head["blocks"]) + 1

    def blocks(self) -> Iterator[np.ndarray]:
        at = np.concatenate(([self.at], self.at + np.cumsum([b["bytes"] for b in self.head["blocks"]], dtype=np.int64))).tolist()
        bodies = [self.data[s:e] for s, e in itertools.pairwise(at)]
        for x in decode_blocks(self.head["blocks"], bodies, self.freq, self.start, self.slots):
            yield self.symbols[x]

    def document(self, k: int) -> tuple[int | None, np.ndarray]:
        """One document's id and token ids: only the steps that hold it are decoded,
        from the checkpoint before them on."""
        first = int(self.lens[:k].sum())
        last, at, begin, parts = first + int(self.lens[k]), self.at, 0, []
        for b in self.head["blocks"]:
            s, e = max(first, begin) - begin, min(last, begin + b["n"]) - begin
            if s < e:
                low, high = s // b["lanes"], -(-e // b["lanes"])
                x = decode_block(b, self.data[at:at + b["bytes"]], self.freq, self.start, self.slots, low, high)
                parts.append(self.symbols[x[s - low * b["lanes"]:e - low * b["lanes"]]])
            at, begin = at + b["bytes"], begin + b["n"]
        return self.doc_ids[k], np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids (unsigned 32 bits)."""
        source, held = self.blocks(), np.zeros(0, np.uint32)
        for d, n in zip(self.doc_ids, self.lens.tolist(), strict=True):
            parts, need = [], n
            while need:
                if not len(held):
                    held = next(source)
                parts.append(held[:need])
                need -= len(parts[-1])
                held = held[len(parts[-1]):]
            yield d, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_file(data: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(data):
        s = Segment(data, at)
        yield s
        at = s.end


def write_archive(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Tokenize whole texts and write them, by ascending id, as an archive.

    Texts are dealt out by ranges of the id (a hot id or source plays no role)
    and sorted within each range; a task encodes its range segment by segment,
    so memory is bounded by one segment. Files are written by Spark's committer,
    so a lost executor leaves no half file. A null text is empty; a null id
    comes first; rows of one id follow in the order of their texts.
    """
    spec = read_spec(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        end = np.array([end_id], enc.dtype)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0
        for b in slices(batches):
            for d, i in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                doc_ids.append(d)
                ids.append(np.concatenate((i, end)))
                held += len(i) + 1
                if held >= segment_tokens:
                    yield pa.RecordBatch.from_arrays([pa.array([encode_segment(doc_ids, ids)[:-1]], pa.binary())], ["segment"])
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([encode_segment(doc_ids, ids)[:-1]], pa.binary())], ["segment"])

    (docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
        .repartitionByRange("id").sortWithinPartitions("id", "text")
        .select("id", F.col("text").cast("binary").alias("text"))
        .mapInArrow(encode, "segment binary")
        .select(F.col("segment").cast("string"))
        .write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path))


def read_archive(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of an archive: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, ``ids``.

    Files are decoded in parallel, and within a file all blocks at once from all
    of their checkpoints. Only the files' totals, one row per file, are summed in
    order.
    """
    schema = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                before = 0
                for segment in read_file(content.as_py()):
                    rows: list[tuple] = []
                    for d, ids in segment.documents():
                        rows.append((file.as_py(), d, before, len(ids), zlib.crc32(ids.astype("<u4")), *([ids.tolist()] if with_ids else [])))
                        before += len(ids)
                    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
                    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * with_ids]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "content")
    docs = written(files.mapInArrow(decode, schema), "decoded")
    sums = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")  # names sort otherwise from part 100000 on
    order = [number, F.regexp_extract("file", r"-c(\d+)", 1).try_cast("long"), "file"]
    ahead = sums.select("file", (F.sum("n").over(Window.orderBy(*order)) - F.col("n")).alias("ahead"))
    return docs.join(ahead, "file").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
