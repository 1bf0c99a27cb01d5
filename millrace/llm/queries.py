"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audio, mixing, packing, periods, pii, quality, rans, simhash, spans, toxicity, vectors, warc
from .common import work_path

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
#: The tables hold no recordings: a text's bytes are read as 8-bit sound.
TEXT_AS_SOUND = audio.Chroma(rate=8000, width=1, frame=256, hop=64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    rans.write_archive(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER, end_id=2)
    return rans.read_archive(spark, path)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, end_id=1)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.align_all(table(spark, sf_dir, "documents"), TEXT_AS_SOUND, "doc_id", "text")


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by crc32 of the id, repeat with a
    period from some word on; the others, and those without an id, stay."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.find_runs(table(spark, sf_dir, "documents"), edit=repeat_tail)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", F.expr("if(score >= 0.3, 1, 0)").alias("predicted"), "n_passages")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


QUERIES = {f.__name__: f for f in (op1_pii, op2_warc, op3_tokens, op4_suffixes, op5_simhash, op6_quality, op7_packing, op8_vectors, op9_mixing, op10_chroma, op11_runs, op12_toxicity, op13_alignment)}

#: WARC types and references follow from payloads alone; the round trip through archives has to give the same.
ORACLE_SQL = {
    "op9_mixing": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
                   md5('1:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h FROM documents
        ), t AS (
            SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source
        ), p AS (
            SELECT tokens / sum(tokens) OVER ()::DOUBLE AS share, min(tokens) OVER ()::DOUBLE AS least, sum(tokens) OVER ()::DOUBLE AS total, count(*) OVER () AS n FROM t WHERE tokens > 0
        ), e AS (  -- bisection for the entropy
            SELECT 0 AS k, 0::DOUBLE AS lo, 1::DOUBLE AS hi
            UNION ALL
            SELECT k + 1, CASE WHEN s >= goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s >= goal THEN hi ELSE (lo + hi) / 2 END
            FROM (SELECT k, lo, hi, ln(sum(pow(share, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(share, (lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2)) AS s,
                         0.95 * ln(max(n)::DOUBLE) - 1e-12 AS goal FROM e, p WHERE k < 60 GROUP BY k, lo, hi) x
        ), a AS (
            SELECT CASE WHEN -sum(share * ln(share)) >= 0.95 * ln(max(n)::DOUBLE) - 1e-12 THEN 1 ELSE (SELECT lo FROM e WHERE k = 60) END::DOUBLE AS a0 FROM p
        ), b AS (  -- bisection for the repeats
            SELECT 0 AS k, (SELECT a0 FROM a) AS lo, 1::DOUBLE AS hi
            UNION ALL
            SELECT k + 1, CASE WHEN w > 4 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN w > 4 THEN hi ELSE (lo + hi) / 2 END
            FROM (SELECT k, lo, hi, pow(max(least) / max(total), (lo + hi) / 2) / sum(pow(share, (lo + hi) / 2)) * max(total) / max(least) AS w FROM b, p WHERE k < 60 GROUP BY k, lo, hi) x
        ), c AS (
            SELECT CASE WHEN max(w0) <= 4 THEN max(a0) ELSE (SELECT lo FROM b WHERE k = 60) END AS alpha
            FROM (SELECT a0, pow(max(least) / max(total), a0) / sum(pow(share, a0)) * max(total) / max(least) AS w0 FROM a, p GROUP BY a0) x
        ), w AS (
            SELECT source, tokens, CAST(floor(least(CASE WHEN tokens > 0 THEN pow(tokens / total, alpha) / z ELSE 0 END * total, 4.0 * tokens) + 1e-6) AS BIGINT) AS quota
            FROM t, c, (SELECT sum(tokens)::DOUBLE AS total FROM t) s, (SELECT sum(pow(share, (SELECT alpha FROM c))) AS z FROM p) y
        ), r AS (
            SELECT doc_id, d.source, n_tokens, tokens, quota,
                   CAST(sum(n_tokens) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(h, 1, 7) AS BIGINT) % 4096, h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
            FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
        ), q AS (
            SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS passes FROM r
        ), f AS (
            SELECT *, unnest(range(passes + CASE WHEN n_tokens > 0 AND upto <= quota - passes * tokens THEN 1 ELSE 0 END)) AS epoch FROM q
        )
        SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(CASE WHEN quota > 0 THEN greatest(0, (epoch * tokens + upto - 1) * 64 // quota) ELSE 0 END AS INTEGER) AS block FROM f
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), o AS (
            SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest
    """,
}
