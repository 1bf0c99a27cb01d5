"""Shared folder, written tables and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds few texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over a task's batches, after which its worker gives free memory back:
    workers outlive a stage, and what each of them keeps adds up beside the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares between driver and executors.

    It is read from ``spark.checkpoint.dir``; only where that is unset and all
    runs on this machine, as in tests, a temporary folder is set in its place.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        got = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with the writer's ``options``, and read it back.

    This cuts the lineage: what follows reads committed files, so a lost
    executor costs at most the tasks it was running.
    """
    return written_at(df, name, **options)[0]


def written_at(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Like :func:`written`, but also returns the path."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given by long columns ``a`` and ``b``.

    Returns ``node`` and ``component`` (the smallest node reachable) for every
    node of an edge between two different nodes. Null ends and loops are
    ignored; repeated edges count once; no edges give no rows.

    Alternating star contraction: each round links every node's larger
    neighbours to its smallest neighbour, then every node's smaller neighbours
    to the smallest of them, until nothing changes. Only minima are aggregated
    (with map-side partial results) and only edges are joined, so a hub with a
    third of all edges is never gathered in one task; the rounds grow with the
    logarithm of the longest path. Each round is a written table.
    """
    spark = edges.sparkSession
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e, path = written_at(e, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
        ).first()
        if mark["n"] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the joins are plain exchanges, which Spark splits where a hub is
        low, low_path = written_at(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = (
            both.where("v > u").join(low, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large, large_path = written_at(large, "large")
        low2, low2_path = written_at(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m")),
                                      F.struct(F.col("v").alias("u"), F.col("m")))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        )
        e, new = written_at(small, "edges")
        for old in (path, low_path, large_path, low2_path):
            remove(spark, old)
        path = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
