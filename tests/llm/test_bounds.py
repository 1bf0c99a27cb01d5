"""What leaves the tasks: samples of long texts; ties among rows that are carried."""

import random

import pyarrow as pa

from millrace.llm import common, mixing, quality
from tests.llm.test_llm import documents


def test_samples_span_the_text():
    chunk = quality.CHUNK_BYTES
    assert quality.sampled(b"") == [] and quality.sampled(b"x" * (chunk + 1)) == [b"x" * chunk, b"x"]
    text = b"".join(bytes([k % 251]) * chunk for k in range(1000)) + b"end"
    got = quality.sampled(text)
    assert len(got) == quality.SAMPLE_CHUNKS and got[0][:1] == b"\0" and got[-1] == b"end"
    places = [i * quality.CHUNK_BYTES for i in range(1001) if text[i * chunk:(i + 1) * chunk] in got]
    assert b"".join(quality.sampled(text, 2000)) == text and max(b - a for a, b in zip(places, places[1:], strict=False)) <= 17 * chunk


def test_long_texts_do_not_drown_the_others(spark):
    """A class with a text of 3 MB fits, and its short texts are still told apart."""
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "mountain", "harvest", "winter", "village"]) for _ in range(80)) for _ in range(40)]
    bad = [" ".join(rng.choice(["click", "buy", "now", "free", "$$$", "!!!"]) for _ in range(80)) for _ in range(40)]
    rows = [(k, t, 1) for k, t in enumerate(good)] + [(100 + k, t, 0) for k, t in enumerate(bad)] + [(200, "buy now " * 400_000, 0), (201, None, 0), (202, "", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(scores) == len(rows) and min(scores[k] for k in range(40)) > 0.5 > max(scores[100 + k] for k in range(40)) and scores[200] < 0.5


def test_ties_of_carried_rows_follow_their_texts(spark):
    """Rows of one id and length, in any order of arrival: the same are chosen."""
    rows = [(7, f"{a} {b}", "s") for a in "abcdefgh" for b in "xyz"] + [(k, "one two", "t") for k in range(3)]
    chosen = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(seed)
        chosen.append(sorted((r["row"]["text"], r["epoch"], r["block"]) for r in mixing.mix(df, carry=["text"], budget=30.0).collect()))
    assert chosen[0] == chosen[1] == chosen[2] and 0 < len(chosen[0])


def test_pipeline_sends_small_batches_and_workers_give_memory_back(spark, small):
    """A stage's task holds a few megabytes of texts at once, and nothing of them after it."""
    import corpus_pipeline

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        corpus_pipeline.pack_sequences(spark, documents(spark, small).limit(3), small)
        texts = spark.range(0, 600, 1, 1).selectExpr("repeat('word ', 10000) as text")
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert len(sizes) > 5 and max(r["n"] for r in sizes) < 5_000_000
    assert [b.num_rows for b in common.trimmed(iter)([pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])])] == [2]
