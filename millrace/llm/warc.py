"""WARC archives without repeated payloads.

Headers (id, digest, size) are shuffled by payload digest to find the original
of each repeated payload; records are then written with fresh headers, revisits
without payload. Spark's text writer does the writing: a record is one row and
the line separator is the blank line pair that ends a WARC record, so files go
through Spark's committer to whatever store the path names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Payloads below this many bytes are always written in full.
MIN_BYTES = 100
#: Closes heads and records.
SEPARATOR = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``digest`` and ``original`` (smallest id) of payloads that occur again.

    Only a minimum and a count per digest leave each map task, so a payload
    that a third of all records share costs one row per task.
    """
    return (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest").agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and original is not null").select("digest", "original")
    )


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
               date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_BYTES, records_per_file: int = 4000) -> None:
    """Write a record per row; equal payloads of ``min_bytes`` or more become
    revisits of the record with the smallest id.

    A null body is an empty payload, a null url leaves its header out (line
    ends in a url become spaces). Rows that repeat the smallest id are
    responses, too; a row with a null id is never an original and refers to one
    if there is any. Other columns are ignored.
    """
    body = F.coalesce(pages[body_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), F.regexp_replace(pages[url_col].cast("string"), "[\r\n]", " ").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("body").cast("long"))
    # written, so that the join's sides are plain exchanges and a hot digest can be split
    originals = written(resolve_revisits(rows.select("id", "digest", "payload_bytes"), min_bytes), "originals")
    rows = rows.join(originals, "digest", "left")
    rows = rows.withColumn("refers", F.expr(f"if(payload_bytes >= {min_bytes} and not (id <=> original), original, null)"))
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit(_HTTP), F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("body")))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    (rows.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("record"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


class WarcParser:
    """Records of archives that come in pieces: what is held is one record at a time."""

    def __init__(self):
        self.held = bytearray()
        self.wanted = 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers (lower-case names) and block of each record that ``data`` completes."""
        self.held += data
        at = 0
        while len(self.held) - at >= self.wanted:
            stop = self.held.find(SEPARATOR, at)
            if stop < 0:
                break
            first, *lines = self.held[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record at {first[:40]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            end = stop + 4 + int(head["content-length"])
            if len(self.held) < end + 4:
                self.wanted = end + 4 - at
                break
            if self.held[end:end + 4] != SEPARATOR:
                raise ValueError(f"record {head.get('warc-record-id')} not closed")
            self.wanted = 0
            yield head, bytes(self.held[stop + 4:end])
            at = end + 4
        del self.held[:at]

    def close(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """The last record, where what closes it was taken for the end of a line."""
        if self.held:
            yield from self.feed(SEPARATOR)
        if self.held:
            raise ValueError("archive ends inside a record")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[dict[str, str], bytes]]]:
    """Lists of records from archives' pieces (without the separators between them) and file names."""
    parser, file = WarcParser(), None
    for b in batches:
        out: list[tuple[dict[str, str], bytes]] = []
        for piece, name in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            if name != file:
                out += parser.close()
                file = name
                out += parser.feed(piece.as_py())
            else:
                out += parser.feed(SEPARATOR + piece.as_py())
        yield out
    yield list(parser.close())


def _number(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_warc(spark: SparkSession, path: str, with_body: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``: ``id``, ``url``,
    ``record_type``, ``payload_bytes``, ``payload_digest`` (both of the full
    payload), ``refers_to`` and, if asked for, ``body`` (null for revisits).
    Archives are streamed through Spark's text reader, whatever their size; one
    record at a time is held whole.

    Digest and size of every stored payload are computed afresh, and a record
    whose payload differs from its header is an error.
    """
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
        *([T.StructField("body", T.BinaryType())] if with_body else []),
    ])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * with_body]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _records(batches):
            rows = []
            for head, block in records:
                http, _, body = block.partition(SEPARATOR)
                size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                kind = head["warc-type"]
                if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"payload of {head['warc-record-id']} differs from its header")
                rows.append((_number(head["warc-record-id"]), head.get("warc-target-uri"), kind, size, digest, _number(head.get("warc-refers-to")),
                             *([body if kind == "response" else None] if with_body else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    # gzip files are never split: a task meets the pieces of its files in order, one file after another
    pieces = spark.read.option("lineSep", "\r\n\r\n").option("pathGlobFilter", "part-*").text(path)
    return pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(parse, schema)
