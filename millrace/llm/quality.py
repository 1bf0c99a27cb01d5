"""Quality by compression: two Zstandard dictionaries and a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, slices, trimmed, written_at

#: Labelled rows of each class that the dictionaries and the calibration are fitted on, at most.
TRAIN_ROWS = 3000
#: Bytes of a text that are compressed at once; a text is scored over all of its chunks.
CHUNK_BYTES = 1024
DICTIONARY_BYTES = 112_640
#: Chunks of a text that dictionaries are built from, at most: evenly spaced over the whole of a longer one.
SAMPLE_CHUNKS = 64
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Everything scoring needs; its size does not depend on the corpus."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


class _Sizes:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good): positive if the good dictionary fits better; 0 if empty."""
        sizes = [sum(len(c.compress(text[i:i + CHUNK_BYTES])) for i in range(0, len(text), CHUNK_BYTES)) for c in self.by]
        return (sizes[1] - sizes[0]) / max(1, sum(sizes))


def sampled(text: bytes, most: int = SAMPLE_CHUNKS) -> list[bytes]:
    """At most ``most`` chunks of a text, evenly spaced, from its start to its end."""
    n = -(-len(text) // CHUNK_BYTES)
    at = range(n) if n <= most else [j * (n - 1) // (most - 1) for j in range(most)]
    return [text[i * CHUNK_BYTES:(i + 1) * CHUNK_BYTES] for i in at]


def _dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if len(s) >= 16]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve as one
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge."""
    sd = x.std() or 1.0
    z, a, b = (x - x.mean()) / sd, 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (p - y) * z).sum() + 1e-2 * a, (w * (p - y)).sum() + 1e-6 * b])
        h = w * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a / sd), float(b - a * x.mean() / sd)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most ``rows`` labelled documents of each class, chosen by a
    hash of the id among those not held out.

    Labels that are null, neither 0 nor 1 or contradictory for an id are left
    out. Odd ranks of the hash build the dictionaries, even ones calibrate, and
    the calibration is weighted to the classes' shares among all labels used.
    With one class missing, every score is that of the other class's share.

    Whole texts stay in tasks: the driver gets at most ``SAMPLE_CHUNKS`` chunks
    of each text of the dictionaries and one number of each that calibrates.
    """
    known = (
        labels.select(labels[id_col].alias("k"), labels[label_col].cast("int").alias("y"))
        .where("k is not null and y in (0, 1)").where(~held_out("k"))
        .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).select("k", "y", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts, path = written_at(
        docs.select(docs[id_col].alias("k"), docs[text_col].cast("string").cast("binary").alias("t"))
        .join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y"), F.first("h").alias("h")), "labelled")
    try:
        by: dict[int, list] = {0: [], 1: []}
        for r in texts.select("k", "y", "h").orderBy("h", "k").collect():
            by[r["y"]].append(r["k"])
        if not by[0] or not by[1]:
            n0, n1 = len(by[0]) + 1, len(by[1]) + 1
            return QualityModel(b"\0" * 8, b"\0" * 8, 0.0, float(np.log(n1 / n0)))
        pieces = _of_texts(texts, {k for y in by for k in by[y][::2]}, lambda: sampled, T.ArrayType(T.BinaryType()))
        good, bad = (_dictionary([c for k in by[y][::2] for c in pieces[k]]) for y in (1, 0))
        tried = {y: by[y][1::2] or by[y] for y in by}
        found = _of_texts(texts, {k for y in by for k in tried[y]}, lambda: _Sizes(good, bad).difference, T.DoubleType())
    finally:
        remove(docs.sparkSession, path)
    x0, x1 = (np.array([found[k] for k in tried[y]]) for y in (0, 1))
    x = np.concatenate((x0, x1))
    y = np.concatenate((np.zeros(len(x0)), np.ones(len(x1))))
    w = np.where(y == 1, totals[1] / len(x1), totals[0] / len(x0))
    slope, intercept = _logistic(x, y, w / w.mean())
    return QualityModel(good, bad, max(0.0, slope), intercept)


def _of_texts(texts: DataFrame, ids: set, function, kind: T.DataType) -> dict:
    """What ``function()`` makes of each text of ``ids``, by id."""
    schema = T.StructType([texts.schema["k"], T.StructField("x", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = function()
        for b in slices(batches, 50):
            at = [i for i, k in enumerate(b.column(0).to_pylist()) if k in ids]
            part = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([made(t.as_py() or b"") for t in part.column(1)], pa.list_(pa.binary()) if isinstance(kind, T.ArrayType) else pa.float64())], schema.names)

    return {r["k"]: r["x"] for r in texts.select("k", "t").mapInArrow(trimmed(run), schema).collect()}


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1, higher: better) of every whole text, beside the id.

    A null text counts as empty; a null id stays null; rows are kept as they
    are, repeated ones too. Only the text enters the score.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    scorer = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1)), pa.float64())], schema.names)

    return docs.select(docs[id_col], docs[text_col].cast("string").cast("binary").alias("__text")).mapInArrow(trimmed(run), schema)


def _scorer(model: QualityModel):
    def run(column: pa.Array) -> np.ndarray:
        sizes = _Sizes(model.good, model.bad)
        x = np.array([sizes.difference(t.as_py() or b"") for t in column], float)
        return 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30)))

    return run


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, columns unchanged."""
    at = docs.columns.index(text_col)
    scorer = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(at).cast(pa.binary())) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
