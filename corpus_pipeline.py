"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, nearcopies, packing, pii, quality, queries
from millrace.llm.common import written

#: Bytes of an Arrow batch to a Python worker; a task's batch is in memory on both sides.
BATCH = "4m"


def _batched(spark: SparkSession) -> None:
    """Whole texts travel in small batches for the rest of the session; Spark's own are of 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go. It learns from the labelled ones among ``docs``."""
    _batched(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash neighbours whose
    five-word shingles overlap by 0.8 or more, and copies."""
    _batched(spark)
    return nearcopies.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become placeholders."""
    _batched(spark)
    return pii.redact_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' weights ask for, within as many tokens as came in."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    _batched(spark)
    return packing.pack(docs, queries.BYTE_TOKENIZER, end_id=1)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the compression classifier, SimHash or BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
