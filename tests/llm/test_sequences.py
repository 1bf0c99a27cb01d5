"""Runs, toxic passages and token alignment against brute force and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from millrace.llm import alignment, common, periods, queries, toxicity
from tests.llm.test_llm import DOC, ODD, documents, frame

# --- periodic runs -----------------------------------------------------------


def brute_runs(w, least=12):
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            size = i - start + p
            if i > start and size >= max(least, 2 * p) and not any(all(w[x] == w[x + q] for x in range(start, start + size - q)) for q in range(1, p)):
                out.add((start, size, p))
            i += 1
    return sorted(out)


def brute_row(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randint(0, 80)
        w = [str(rng.randrange(rng.choice([1, 2, 3, 20]))).encode() for _ in range(n)]
        if n and rng.random() < 0.6:
            p, at = rng.randint(1, max(1, n // 3)), rng.randrange(n)
            w[at:] = [w[at + k % p] for k in range(n - at)]
            if rng.random() < 0.5:
                w[rng.randrange(n)] = b"other"
        assert periods.runs(w) == brute_runs(w)
        assert periods.runs(w, 2) == brute_runs(w, 2)


def test_runs_with_colliding_hashes(monkeypatch):
    """Words decide where hashes lie: with one hash for all, results stay."""
    rng = random.Random(4)
    texts = [[b"ab"[k:k + 1] for k in (rng.randrange(2) for _ in range(70))] * 2 + [b"c"] for _ in range(60)]
    want = [periods.runs(w) for w in texts]
    monkeypatch.setattr(periods._Text, "_equal", lambda self, i, j, size: True)
    assert [periods.runs(w) for w in texts] == want == [brute_runs(w) for w in texts]


def test_op11_equals_brute_force(spark, small):
    docs = documents(spark, small).where("length(text) < 4000")
    got = {r[0]: tuple(r)[1:] for r in queries.op11_runs(spark, small).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) > 100 and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5
    for r in rows:
        assert got[r[0]] == brute_row(*r), r[0]


def test_runs_odd_documents(spark):
    got = periods.find_runs(frame(spark, ODD), keep_text=True)
    rows = got.collect()
    assert len(rows) == len(ODD) and got.columns[0] == "doc_id"
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by[1]["n_runs"] == by[2]["n_runs"] == 0 and by[1]["start"] is None and by[1]["collapsed"] == ""
    assert (by[3]["n_runs"], by[3]["start"], by[3]["length"], by[3]["period"], by[3]["collapsed"]) == (1, 0, 90_000, 3, "a b c")
    assert by[5]["collapsed"] == "same text here"
    assert periods.find_runs(frame(spark, [])).count() == 0


# --- toxicity ----------------------------------------------------------------


def brute_segments(x):
    """Maximal segments by their definition: no part scores more, nothing around scores as much."""
    n = len(x)
    upto = np.concatenate(([0], np.cumsum(x)))

    def good(i, j):  # every proper part scores less
        best = upto[j] - upto[i]
        return all((upto[b] - upto[a] < best - 1e-12) for a in range(i, j) for b in range(a + 1, j + 1) if (a, b) != (i, j)) and best > 0

    every = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if good(i, j)]
    return [(i, j) for i, j in every if not any((a <= i and j <= b) and (a, b) != (i, j) for a, b in every)]


def test_maximal_segments_equal_definition():
    rng = np.random.default_rng(5)
    for _ in range(250):
        x = np.round(rng.normal(-0.3, 1, rng.integers(0, 14)), 3)
        got = toxicity.maximal_segments(x)
        assert [g[:2] for g in got] == brute_segments(x)
        assert all(abs(v - x[s:e].sum()) < 1e-9 for s, e, v in got)


def auc(y, s):
    s, y = np.asarray(s, float), np.asarray(y)
    return float(np.mean([(s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])]))


def test_op12_held_out(spark):
    """At sf0.1: nearly all documents with several toxic words are caught, few clean ones."""
    d = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out and toxic is not null").toPandas()
    y, hit = got.toxic.values == 1, got.predicted.values == 1
    assert auc(got.toxic.values, got.score.values) > 0.9
    assert (hit & y).sum() >= 0.75 * y.sum() and (hit & ~y).sum() <= 0.04 * (~y).sum()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


LABEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def toxic_corpus(n=600):
    rng = random.Random(7)
    plain = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            words[20:26] = ["vile" + rng.choice("abcdefgh") * 3 if rng.random() < 0.5 else "awful" for _ in range(6)]
        docs.append((i, " ".join(words), "s"))
        labels.append((i, None, int(bad)))
    return docs, labels


def test_toxic_passages_and_odd_documents(spark):
    docs, labels = toxic_corpus()
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, 1), (4, 1, 7)], LABEL))
    long = " ".join(["w1"] * 50_000 + ["AWFUL vileqqq awful vilezz awful"] + ["w2"] * 50_000)
    odd = [(1, None, None), (2, "", "a"), (3, "İ awful vilexx awful awful vileyy İ w1", "a"), (4, long, "b"), (5, "w1 w2 w3", "a"), (5, "w1 w2 w3", "a"), (None, "awful vileqqq awful vilex", "a")]
    rows = {}
    for r in toxicity.score(frame(spark, odd), model).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == len(odd) and len(rows[5]) == 2
    assert rows[1][0]["score"] == rows[2][0]["score"] == rows[5][0]["score"] < 0.1 < 0.5 < rows[3][0]["score"] and rows[None][0]["score"] > 0.5
    found = {r["doc_id"]: r for r in toxicity.find_passages(frame(spark, odd), model).collect()}
    assert set(found) == {3, 4, None} and found[3]["passage"] == "awful vilexx awful awful vileyy" and found[4]["passage"] == "AWFUL vileqqq awful vilezz awful"
    assert all(odd[[o[0] for o in odd].index(k)][1][r["start"]:r["end"]] == r["passage"] for k, r in found.items())
    assert toxicity.score(frame(spark, []), model).count() == 0
    for some in ([], [(1, 1, 1)], [(1, 1, 0)]):  # nothing to learn from
        one = toxicity.fit(frame(spark, docs), spark.createDataFrame(some, LABEL))
        assert {0 < r["score"] < 1 for r in toxicity.score(frame(spark, odd), one).collect()} == {True}


def test_toxicity_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = toxic_corpus(300)
    kept = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    flipped = kept + [(i, q, 1 - t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    a, b = (toxicity.fit(frame(spark, docs), spark.createDataFrame(x, LABEL)) for x in (labels, flipped))
    assert a == b and a.weights


# --- alignment of two tokenizers ---------------------------------------------

A, B = queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_alignment(texts, libraries):
    a, b = libraries
    a_bytes, b_bytes = alignment.byte_level_tokens(alignment.read_spec(A)), alignment.piece_tokens(b)
    docs, count = [], Counter()

    def spans(ids, spelt):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(spelt[i])))
            at += len(spelt[i])
        return out

    for t in texts:
        docs.append(None)
        if not t:
            continue
        sa, sb = spans(a.encode(" " + t, add_special_tokens=False).ids, a_bytes), spans(b.encode(t), b_bytes)
        if not all(b"".join(x[i] for i, *_ in s) == (" " + t).encode() for s, x in ((sa, a_bytes), (sb, b_bytes))):
            continue
        groups, last = [], 0
        for end in sorted({e for *_, e in sa} & {e for *_, e in sb}):
            groups.append("|".join(",".join(str(i) for i, _, e in s if last < e <= end) for s in (sa, sb)))
            last = end
        links = [(i, j) for i, s, e in sa for j, x, y in sb if s < y and x < e]
        count.update(links)
        docs[-1] = (len(sa), len(sb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(0,) * 6 + ("",) if d is None else (*d[:3], len(d[3]), sum(count[x] == top[x[1]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs]


PARTS = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", " ", "　", "▁", "<0x41>", "<s>", "</s>", "<|endoftext|>", "'s", "'", "1", "23", "!", "...", "日", "😀", "\x00", "\x1c", "\u0085", "é", "ﬁ", "᠎", "​", "﻿", "The", "ing"]


def test_alignment_equals_brute_force(spark, small, libraries, monkeypatch):
    rng = random.Random(1)
    texts = [r["text"] for r in documents(spark, small).where("length(text) < 2000").limit(60).collect()]
    texts += [None, "", " ", "  ", "\n", "a ", " a", "a  b", "x" * 3000, "same words here", "same words here"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    want = brute_alignment(texts, libraries)
    assert 50 < sum(w[0] == 0 for w in want) < 400
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, pair string, count string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)  # many blocks, the same result
    assert {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, A, B).collect()} == got


def test_transducer_closes_groups_on_empty_residual():
    t = alignment.Transducer([b" ab", b"c", b"de"], [b" ", b"abc", b"d", b"e"])
    assert t.align([0, 1, 2], [0, 1, 2, 3]) == (["0,1|0,1", "2|2,3"], [0, 1, 1 << 32 | 1, 2 << 32 | 2, 2 << 32 | 3])
    assert t.align([0], [0]) is None and t.align([0], [1]) is None and t.align([], []) == ([], [])
    assert t.moves and len(t.names) == len(set(t.names))


def test_alignment_odd_documents(spark):
    got = alignment.align(frame(spark, ODD), A, B, keep_groups=True)
    rows = got.collect()
    assert len(rows) == len(ODD) and sum(r["doc_id"] is None for r in rows) == 2
    assert all((r["n_a"] > 0) == bool(r["groups_sha256"]) and r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in rows)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in rows if r["n_a"])
    assert alignment.align(frame(spark, []), A, B).count() == 0


def test_blocks_are_decoded_a_few_at_a_time(spark, small, monkeypatch):
    """Files hold blocks in small row groups however many a task writes, and narrow integers come back."""
    held = []
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(alignment, "ROW_GROUP_BYTES", 100_000)
    monkeypatch.setattr(alignment, "written", lambda df, *a, **o: held.append(common.written(df, *a, **o)) or held[-1])
    df = documents(spark, small).coalesce(1)
    assert alignment.align(df, A, B).count() == df.count()
    groups = [f.metadata.row_group(g).num_rows for f in (pq.ParquetFile(p.removeprefix("file://")) for p in held[0].inputFiles()) for g in range(f.metadata.num_row_groups)]
    assert sum(groups) > 15 and max(groups) <= 8
    for x in ([], [0], [255, 1], [256], [70_000, 3], [0, 0]):
        x = np.array(x, np.int64)
        assert alignment.wide(alignment.narrow(x).tobytes(), len(x)).tolist() == x.tolist()
    assert len(alignment.narrow(np.array([255])).tobytes()) == 1


def test_long_unbroken_text(spark, libraries):
    """A text of 1 MB without spaces, and one of 3 MB."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh0") for _ in range(100_000)) * 10, "word and word " * 220_000]
    got = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_a"] == len(libraries[0].encode(" " + t, add_special_tokens=False).ids) and got[i]["n_b"] == len(libraries[1].encode(t))
    assert periods.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).agg(F.sum("n_runs")).first()[0] == 1
