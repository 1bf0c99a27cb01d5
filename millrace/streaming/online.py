"""Streams: regular series from events, and smoothing as stateful operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.series import Series


def resample(events: DataFrame, s: Series, every: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Keys, window start ``ds``, ``y`` (sum) and ``n`` per window; works on streams
    (late rows within the watermark are counted) and on tables."""
    rows = events.withWatermark(s.ts, lateness) if events.isStreaming else events
    w = rows.groupBy(*s.keys, F.window(s.ts, every).alias("w")).agg(F.sum(s.value).alias("y"), F.count(F.lit(1)).alias("n"))
    return w.select(*s.keys, F.col("w.start").alias("ds"), "y", "n")


#: Rows that leave a state at once, and the time that stands for none.
PART, LAST = 100_000, (1 << 63) - 1


def _columns(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a key's rows, 16 bytes a row."""
    got = [(pdf["us"].to_numpy(np.int64), pdf["y"].to_numpy(np.float64)) for pdf in batches]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0))


def _smoothed(y: np.ndarray, m: float | None, q: float | None, alpha: float) -> tuple[float | None, float | None, list, list]:
    """The state after ``y``, and mean and variance after each value."""
    means, variances = [], []
    for v in y.tolist():
        if v == v and abs(v) != float("inf"):
            m, q = (v, v * v) if m is None else (alpha * v + (1 - alpha) * m, alpha * v * v + (1 - alpha) * q)
        means.append(m)
        variances.append(None if m is None else max(0.0, q - m * m))
    return m, q, means, variances


def _part(key: tuple, us: np.ndarray, y: np.ndarray, means: list, variances: list, out: T.StructType) -> pd.DataFrame:
    ds = us.astype("datetime64[us]")
    ds[us == LAST] = np.datetime64("NaT")
    columns = [*([k] * len(us) for k in key), ds, y, np.array(means, np.float64), np.array(variances, np.float64)]
    return pd.DataFrame(dict(zip(out.names, columns, strict=True)))


def running_ewm(stream: DataFrame, s: Series, alpha: float = 0.3) -> DataFrame:
    """Keys, time, value, ``ewm_mean`` and ``ewm_var`` of a stream: the state of a key
    is two numbers. Rows are taken as they arrive, those of one batch by time, and
    at once; a row that comes in a later batch than a newer one counts after it
    (:func:`ordered_ewm` takes all rows by time). A missing value leaves the
    state as it is. State is kept for every key for ever."""
    key_fields = [stream.schema[k] for k in s.keys]
    out = T.StructType([*key_fields, T.StructField("ds", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("y", "ewm_mean", "ewm_var"))])
    state_type = T.StructType([T.StructField("m", T.DoubleType()), T.StructField("q", T.DoubleType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        m, q = state.get if state.exists else (None, None)
        us, y = _columns(batches)
        order = np.lexsort((y, us))  # rows without a time are last
        for k in range(0, len(order), PART):
            at = order[k:k + PART]
            m, q, means, variances = _smoothed(y[at], m, q, alpha)
            yield _part(key, us[at], y[at], means, variances, out)
        if m is not None:
            state.update((float(m), float(q)))

    rows = stream.select(*s.keys, F.coalesce(F.unix_micros(F.col(s.ts).cast("timestamp")), F.lit(LAST)).alias("us"), F.col(s.value).cast("double").alias("y"))
    return rows.groupBy(*s.keys).applyInPandasWithState(step, out, state_type, "append", "NoTimeout")


def ordered_ewm(stream: DataFrame, s: Series, alpha: float = 0.3, lateness: str = "2 hours", forget: str | None = None) -> DataFrame:
    """As :func:`running_ewm`, in event time: a row waits in the state of its key
    until the watermark (``lateness`` behind the newest time seen) has passed
    it, and rows leave in order of time, whatever batch brought them.

    Rows that come after the watermark has passed them are dropped (and those of
    1970 and before, where every watermark starts); those that it never passes
    stay behind, rows without a time are left out. Rows of one time are taken by value. With
    ``forget``, a key's state goes once the watermark is that far past its last
    row; the key then starts anew. The state is two numbers and the rows within
    ``lateness``.
    """
    names = ("ds", "y", "ewm_mean", "ewm_var")
    out = T.StructType([*(stream.schema[k] for k in s.keys), T.StructField("ds", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in names[1:])])
    state_type = T.StructType([T.StructField("m", T.DoubleType()), T.StructField("q", T.DoubleType()), T.StructField("last", T.LongType()), T.StructField("ts", T.BinaryType()), T.StructField("ys", T.BinaryType())])
    hold = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        m, q, last, ts, ys = state.get if state.exists else (None, None, None, b"", b"")
        m, q, last = (None if x is None or x != x else x for x in (m, q, last))
        us, y = _columns(batches)
        us, y = np.concatenate((np.frombuffer(ts, "<i8"), us)), np.concatenate((np.frombuffer(ys, "<f8"), y))
        y[~np.isfinite(y)] = np.nan
        order = np.lexsort((y, us))  # missing values are last at their time
        us, y = us[order], y[order]
        n = int(np.searchsorted(us, mark * 1000))
        for k in range(0, n, PART):
            e = min(n, k + PART)
            m, q, means, variances = _smoothed(y[k:e], m, q, alpha)
            yield _part(key, us[k:e], y[k:e], means, variances, out)
        last = int(us[n - 1]) if n else last
        if n == len(us) and hold is not None and (last is None or last // 1000 + hold < mark):
            state.remove()
        else:
            state.update((m, q, last, us[n:].astype("<i8").tobytes(), y[n:].astype("<f8").tobytes()))
            if n < len(us) or hold is not None:
                state.setTimeoutTimestamp(int(max(us[n] // 1000 if n < len(us) else last // 1000 + hold, mark + 1)))

    rows = stream.select(*s.keys, F.col(s.ts).cast("timestamp").alias("ds"), F.col(s.value).cast("double").alias("y")).where("ds is not null")
    marked = rows.withWatermark("ds", lateness).withColumn("us", F.unix_micros("ds"))
    return marked.groupBy(*s.keys).applyInPandasWithState(step, out, state_type, "append", "EventTimeTimeout")


def replayed(rows: DataFrame, part: str, name: str) -> DataFrame:
    """A table as a stream of one micro-batch per value of ``part`` (whole
    numbers), in their order: each is written as a file of its own, in a folder
    that the cluster shares, and the stream takes one file at a time."""
    spark = rows.sparkSession
    path = shared_path(spark, name)
    for k in sorted(r[0] for r in rows.select(part).distinct().collect()):
        rows.where(F.col(part) == k).drop(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop(part).schema).option("maxFilesPerTrigger", 1).parquet(path)


def read_stream(spark: SparkSession, folder: str, file: str, schema: T.StructType) -> DataFrame:
    """The Parquet files of a folder that are called ``file``, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares."""
    return f"{_shared(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table.

    Results and the stream's checkpoint are written to the folder that the cluster
    shares (``spark.checkpoint.dir``; a temporary one only where all runs on this
    machine). Windows that the watermark has not closed yet are left out.
    """
    spark = stream.sparkSession
    path = shared_path(spark, name)
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
