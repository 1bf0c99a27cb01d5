"""Each operator against brute force, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import audio, mixing, nearcopies, packing, pii, quality, queries, rans, simhash, spans, suffixes, tokens, vectors, warc
from millrace.llm.common import connected_components, work_path

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("spans", T.StringType()), T.StructField("id", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", "y") for i, t, s in rows], DOC)


ODD = [(1, None, None), (2, "", "a"), (3, "a b c " * 30_000, "a"), (4, "same text here " * 10, "b"), (5, "same text here " * 10, None), (5, "same text here " * 10, None), (None, "same text here " * 10, "b"), (None, None, None)]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- personal data -----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        got = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            got.append(m.span())
        out[kind] = got
    return out


def test_pii_equals_patterns(spark, sf):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab12 .@+-()45é") for _ in range(60)) for _ in range(4000)]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111 9", "+1 (499) 555-6503.", "++1 2345678", "x@y", "0001.02.3.4", "999.1.1.1 1.1.1.1"]
    texts += [r["text"] for r in documents(spark, sf).collect()]
    for t in texts:
        got = pii.find_spans(t)
        assert {k: got[k] for k in PATTERNS} == brute_pii(t), t
    assert sum(len(v) for t in texts[-1000:] for v in brute_pii(t).values()) > 50


def test_pii_extra_and_redaction(spark):
    t = "IBAN: DE89 3704 0044 0532 0130 00, SSN 123-45-6789, account no. 12345678, ftp://u:pw@h.example/x me@x.org"
    got = pii.find_spans(t)
    assert [len(got[k]) for k in ("iban", "ssn", "account", "credential_url", "email")] == [1, 1, 1, 1, 2]
    out = pii.redact(t)
    assert out == "IBAN: <IBAN>, SSN <SSN>, account no. <ACCOUNT>, <CREDENTIAL_URL>/x <EMAIL>"
    rows = pii.find_pii(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r["n_email"] == 0 and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    df = pii.redact_pii(frame(spark, [*ODD, (9, "x me@x.org", "a")]))
    assert df.columns == DOC.names
    assert [tuple(r) for r in df.where("doc_id = 9").collect()] == [(9, "x <EMAIL>", None, "a", 9, "x", "y")]
    assert pii.find_pii(frame(spark, [])).count() == 0 and pii.redact_pii(frame(spark, [])).count() == 0


# --- WARC -----------------------------------------------------------------------


def test_warc_round_trip(spark):
    body = "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 100
    rows = [(5, "http://a", body), (3, "http://b\r\nX: y", body), (9, None, body), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "n", body), (7, "u", "z" * 200_000), (3, "again", body)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    path = work_path(spark, "w")
    warc.write_warc(df, path)
    got = {(r["id"], r["url"]): r for r in warc.read_warc(spark, path, with_body=True).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        r = got[(i, url and url.replace("\r", " ").replace("\n", " "))]
        raw = (html or "").encode()
        revisit = html == body and i != 3
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
        assert r["body"] == (None if revisit else raw)
    path = work_path(spark, "w")
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


# --- tokens ----------------------------------------------------------------------

HARD = ["a  b\n\nc \n d", "  x", " ", "", "\n", "é́ İstanbul x  y it's don't 'sa", "a\tb  c\x1cd e\x85f", " a", "a ", "x <|endoftext|> y", "日本語 テスト…!!", "a\n\n\nb",
        "a \nb", "'s 's’s", "12 345 a1b2", "ÀÉ×÷ß", "a' b'c ''s", "\x1c a\x1c \x1c", "a  b  c", "x" * 100 + " " + "y" * 300, "\r\n\r\n x\r\n", "\0 a\0b"]


@pytest.mark.parametrize("path", [queries.WORD_TOKENIZER, queries.BYTE_TOKENIZER])
def test_encoder_equals_library(spark, sf, path):
    e = tokens.Encoder(tokens.read_spec(path))
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("aB é'.,\n\t 1 ß日") for _ in range(40)) for _ in range(1500)] + [r["text"] for r in documents(spark, sf).limit(300).collect()]
    assert e.kind != "other"
    for t, ids in zip(texts, e.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == e.tok.encode(t, add_special_tokens=False).ids, t


def test_rans_blocks():
    rng = np.random.default_rng(3)
    for n, k in ((0, 1), (1, 1), (5, 3), (70_000, 40_000), (300_000, 500)):
        ids = [np.minimum(rng.geometric(min(1, 8 / k), m), k).astype(np.uint16) if k > 1 else np.ones(m, np.uint16) for m in rng.multinomial(n, [0.2, 0.5, 0, 0.3])]
        s = rans.Segment(rans.encode_segment([7, None, 8, 9], ids), 0)
        got = list(s.documents())
        assert [d for d, _ in got] == [7, None, 8, 9]
        assert all(np.array_equal(x, y) for (_, x), y in zip(got, ids, strict=True))
    symbols = rng.integers(0, 50, 300_000)
    freq = rans.scaled(np.bincount(symbols).astype(float))
    start = np.cumsum(freq) - freq
    f, c = freq.astype(np.uint64), start.astype(np.uint64)
    head, body = rans.encode_block(symbols, f, c, 1024)
    slots = np.repeat(np.arange(50, dtype=np.uint32), freq)
    assert head["marks"]
    assert np.array_equal(rans.decode_block(head, body, f, c, slots, 150, 200), symbols[150 * 1024:200 * 1024])
    with pytest.raises(ValueError):
        rans.decode_block(head, body[:-1] + bytes([body[-1] ^ 1]), f, c, slots)
    assert rans.scaled(np.array([1e9] + [1.0] * 60_000)).sum() == 1 << rans.PRECISION


def test_token_archive(spark, small):
    for docs in (documents(spark, small), frame(spark, ODD), frame(spark, [])):
        path = work_path(spark, "t")
        rans.write_archive(docs, path, queries.WORD_TOKENIZER, 2)
        got = sorted(rans.read_archive(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
        e = tokens.Encoder(tokens.read_spec(queries.WORD_TOKENIZER))
        want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))
        at = 0
        assert len(got) == len(want)
        for r, (d, t) in zip(got, want, strict=True):
            ids = [*e.tok.encode(t, add_special_tokens=False).ids, 2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (d, at, len(ids), ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)


# --- suffix arrays -----------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(4)
    for alphabet in ("ab", "abcdefgh\0", "a"):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 300))).encode() for _ in range(40)] + [b"a" * 200, b"ab" * 90]
        data = b"\0".join([*parts, bytes(80)])
        code = np.zeros(sum(map(len, parts)) + len(parts), np.uint16)
        at = 0
        for p in parts:
            code[at:at + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
            at += len(p) + 1
        order = suffixes.suffix_array(code, np.frombuffer(data, np.uint8), 50)
        assert sorted(order.tolist()) == np.flatnonzero(code).tolist()
        whole = [i for i in order.tolist() if (code[i:i + 50] > 0).all() and i + 50 <= len(code)]
        keys = [data[i:i + 50] for i in whole]
        assert keys == sorted(keys)
        prefixes = suffixes.adjacent_prefixes(np.frombuffer(data, np.uint8), np.array(whole), 50)
        for i in range(1, len(whole)):
            n = next((k for k in range(50) if keys[i - 1][k] != keys[i][k]), 50)
            assert prefixes[i] == n


def brute_repeats(rows, length=50):
    first = {}
    ids = {None: 1 << 62}
    raw = [(ids.get(i, i), (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans_ = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == 1 << 62 else i, len(b), sum(gone), spans_, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [1, 5, 1000])
def test_repeats_small(spark, crowded):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcde é") for _ in range(n)) for n in (49, 50, 51, 80, 300)] + ["a" * 130, "ab" * 60]
    rows = []
    for i in range(150):
        parts = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(0, 90))) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randrange(0, 6))]
        rows.append((rng.randrange(200), "".join(parts)))
    rows += [(i, t) for i, t, _ in ODD if i != 3] + [(3, "xyz" * 100)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(5)
    got = sorted((tuple(r) for r in spans.remove_repeats(df, crowded=crowded).collect()), key=str)
    assert got == brute_repeats(rows)


def test_repeats_documents(spark, small):
    df = documents(spark, small)
    got = sorted((tuple(r) for r in spans.remove_repeats(df).collect()), key=str)
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sum(r[2] for r in got) > 10_000
    assert spans.remove_repeats(df.limit(0)).count() == 0


# --- SimHash --------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def check_simhash(rows, got, radius=2):
    fp = {t: brute_fingerprint(t) for _, t in rows}
    fps = sorted(set(fp.values()))
    arr = np.array(fps, np.uint64)
    pairs = [(fps[a], fps[b]) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(arr ^ arr[a]) <= radius).tolist() if a < b]
    comp, low = components(fps, pairs), {}
    for i, t in rows:
        if i is not None:
            low[comp[fp[t]]] = min(low.get(comp[fp[t]], i), i)
    want = sorted(((i, f"{fp[t]:016x}", low.get(comp[fp[t]])) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_simhash(spark, sf):
    df = documents(spark, sf)
    check_simhash([(r["doc_id"], r["text"]) for r in df.collect()], simhash.near_duplicates(df).collect())
    check_simhash([(i, t) for i, t, _ in ODD], simhash.near_duplicates(frame(spark, ODD)).collect())
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.keep_first(frame(spark, ODD))
    assert kept.columns == DOC.names and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "3", "4", "None", "None"]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(__import__("xxhash").xxh64_intdigest(b"a b c", 42)).view(np.int64)


def edited(rng, words, share):
    """The words with a share of them replaced."""
    return [f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("hot", [4, 2048])
def test_near_copies(spark, hot):
    rng = random.Random(12)
    rows, family = [], {}
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 600))]
        for k in range(1 + 6 * (g % 3)):
            i = len(rows)
            rows.append((i, " ".join(base if k in (0, 3) else edited(rng, base, 0.02))))
            family[i] = g
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and family[a] == family[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = components(sets, pairs)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string"), hot=hot).collect()}
    assert all(family[got[i]] == family[i] for i in got)
    merged = [i for i in want if want[i] != i]
    assert len(merged) > 30 and sum(got[i] != i for i in merged) >= 0.95 * len(merged)
    for i, t in rows[:30]:
        s = nearcopies.sketch(t.encode())
        for j, u in rows[:30]:
            assert abs(nearcopies.overlap(s, nearcopies.sketch(u.encode())) - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 0.12
    odd = nearcopies.near_copies(frame(spark, ODD)).collect()
    assert sorted(map(str, (r["component_id"] for r in odd))) == sorted(map(str, [1, 1, 3, 4, 4, 4, 4, 1]))
    assert nearcopies.near_copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [3, 512])
def test_simhash_links(spark, hot):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for _ in range(600):
        x = rng.choice(list(fps)[:100])
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, 2, hot)).collect()}
    arr = np.array(fps, np.uint64)
    want = components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(arr ^ arr[a]) <= 2).tolist() if a < b])
    assert {i: got.get(i, i) for i in want} == want
    i, j = simhash.near_pairs(arr, 2)
    assert len(i) == sum(int((np.bitwise_count(arr ^ x) <= 2).sum()) - 1 for x in arr) // 2


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(2000, 2200)] + [(1, 1)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    pairs = [(a, b) for a, b in pairs if a != b]
    want = components({x for p in pairs for x in p}, pairs)
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


# --- quality ---------------------------------------------------------------------------


def test_quality(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).withColumn("held", quality.held_out("doc_id")).join(labels, "doc_id").where("held").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    good, bad = (np.array([r["score"] for r in scored if r["quality"] == q]) for q in (1, 0))
    auc = (bad[:, None] < good[None, :]).mean() + (bad[:, None] == good[None, :]).mean() / 2
    assert auc > 0.98 and (good >= 0.5).mean() > 0.98 and (bad < 0.5).mean() > 0.8
    odd = quality.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.keep_good(frame(spark, ODD), model).columns == DOC.names
    none = quality.fit(frame(spark, ODD), spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int"))
    assert quality.score(frame(spark, ODD), none).count() == len(ODD) and quality.score(frame(spark, []), none).count() == 0


# --- packing ---------------------------------------------------------------------------


def check_packing(rows, got, size):
    e = tokens.Encoder(tokens.read_spec(queries.BYTE_TOKENIZER))
    want, have = defaultdict(int), defaultdict(int)
    cover, sequences = defaultdict(list), defaultdict(list)
    for i, t in rows:
        ids = np.array([*e.tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), size):
            p = ids[s:s + size]
            want[(i, s, len(p), zlib.crc32(p.tobytes()), len(ids))] += 1
    for r in got:
        have[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        cover[r["doc_id"]].append(r["length"])
    assert have == want
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    return sequences


def test_packing(spark, sf, small):
    df = documents(spark, small)
    check_packing([(r["doc_id"], r["text"]) for r in df.collect()], packing.pack(df, queries.BYTE_TOKENIZER, 1).collect(), 2048)
    check_packing([(i, t) for i, t, _ in ODD], packing.pack(frame(spark, ODD), queries.BYTE_TOKENIZER, 1, 64).collect(), 64)
    assert packing.pack(frame(spark, []), queries.BYTE_TOKENIZER, 1).count() == 0
    rows = packing.pack(documents(spark, sf), queries.BYTE_TOKENIZER, 1).collect()
    used = sum(r["length"] for r in rows)
    assert used / (2048 * len({r["sequence_id"] for r in rows})) > 0.98


def test_histogram():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))}
        patterns = packing.pack_histogram(counts, 64)
        got = defaultdict(int)
        for n, p in patterns:
            assert n > 0 and sum(p) <= 64
            for x in p:
                got[x] += n
        assert got == counts


# --- embeddings -------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.98):
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, pairs = [0] * len(rows), []
    for x in range(len(good)):
        for y in range(x):
            a, b = rows[good[x]], rows[good[y]]
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                    n[good[x]] += 1
                    n[good[y]] += 1
                    pairs.append((good[x], good[y]))
    comp = components(range(len(rows)), pairs)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[comp[k]] = min(low.get(comp[k], i), i)
    return sorted(((i, n[k], low.get(comp[k]), i is not None and low[comp[k]] == i) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile", [16, 2048])
def test_vectors(spark, small, tile):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(30):
        c = rng.standard_normal(24)
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), (c + rng.normal(0, 0.05 + 0.01 * (g % 10), 24)).tolist(), int(g % 3)))
    c = rng.standard_normal(24).tolist()
    rows += [(1000 + i, c, 1) for i in range(40)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] * 24, 1), (2004, [1.0, None], 1), (2005, [1.0, 2.0], 1), (2006, [1.0, 2.0], 1), (2007, c, None), (None, [3.0, 1.0], 1), (2008, [1e200] * 24, 1), (5, c, 1)]
    schema = "vec_id long, embedding array<double>, label int, dim int"
    got = sorted((tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(*r, 7) for r in rows], schema), tile=tile).collect()), key=str)
    want = brute_vectors([r for r in rows])
    assert got == want
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_vectors_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=str)
    assert got == brute_vectors([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


# --- mixing -----------------------------------------------------------------------------


def test_mixing(spark, sf):
    df = documents(spark, sf)
    rows = mixing.mix(df, entropy=0.97, repeats=3.0).collect()
    words = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in df.collect()}
    totals, spent, per = defaultdict(int), defaultdict(int), defaultdict(list)
    for s, n in words.values():
        totals[s] += n
    for r in rows:
        assert (r["source"], r["n_tokens"]) == words[r["doc_id"]]
        spent[r["source"]] += r["n_tokens"]
        per[r["doc_id"]].append(r["epoch"])
    w = {r["source"]: r for r in mixing.source_weights(spark.createDataFrame(list(totals.items()), "source string, tokens long"), 0.97, 3.0).collect()}
    weight = np.array([r["weight"] for r in w.values()])
    assert abs(weight.sum() - 1) < 1e-9
    assert -(weight * np.log(weight)).sum() == pytest.approx(0.97 * np.log(len(weight)), rel=1e-6) or next(iter(w.values()))["alpha"] in (0, 1)
    longest = max(n for _, n in words.values())
    for s, r in w.items():
        assert r["quota"] - longest <= spent[s] <= r["quota"] <= 3 * totals[s]
    assert all(sorted(e) == list(range(len(e))) for e in per.values())
    assert {r["block"] for r in rows} == set(range(64))
    nodes = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_mixing_odd(spark):
    got = mixing.mix(frame(spark, ODD), entropy=None, repeats=None).collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in got if r["n_tokens"] and r["doc_id"] is not None) == [(3, 0), (4, 0), (5, 0), (5, 0)]
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [(1, None, None)])).count() == 0
    assert mixing.mixed_documents(frame(spark, ODD)).columns == DOC.names
    limited = mixing.source_weights(spark.createDataFrame([("a", 1000), ("b", 1)], "source string, tokens long"), 1.0, 2.0).collect()
    assert all(r["quota"] <= 2 * r["tokens"] for r in limited) and limited[0]["alpha"] > 0


# --- audio ------------------------------------------------------------------------------


def melody(seed, n, rate=11025):
    rng = np.random.default_rng(seed)
    t = np.arange(int(0.25 * rate)) / rate
    notes = [np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) + 0.5 * np.sin(2 * np.pi * 440 * 2 ** (m / 12) * t) for k, m in rng.integers(0, 24, (n, 2))]
    return np.concatenate(notes)


def pcm(x):
    return (x / np.abs(x).max() * 20000).astype("<i2").tobytes()


def test_chroma(spark):
    c = audio.Chroma()
    rng = np.random.default_rng(1)
    one, two = melody(1, 100), melody(2, 100)
    part = one[40 * c.hop:]
    rows = [(1, pcm(one)), (2, pcm(two)), (3, pcm(part)), (4, pcm(part + rng.normal(0, 0.05, len(part)))), (5, pcm(one)), (6, None), (7, b""), (8, b"abc"), (None, pcm(one)), (5, pcm(one))]
    got = {r["id"]: r for r in audio.align(spark.createDataFrame([(*r, 0) for r in rows], "id long, audio binary, votes int"), c).collect()}
    assert (got[3]["match_id"], got[3]["offset"]) == (1, -40) and got[3]["bit_errors"] < 0.01
    assert (got[4]["match_id"], got[4]["offset"]) == (1, -40)
    assert (got[5]["match_id"], got[5]["offset"], got[5]["bit_errors"]) == (1, 0, 0.0)
    assert all(got[i]["match_id"] is None for i in (1, 2, 6, 7, 8, None)) and got[6]["n_codes"] == 0
    assert audio.align(spark.createDataFrame([], "id long, audio binary"), c).count() == 0


def test_chroma_votes(spark, small):
    """The index against a scan of all earlier recordings' codes."""
    c = queries.TEXT_AS_SOUND
    df = documents(spark, small)
    got = {r["doc_id"]: r for r in audio.align(df, c, "doc_id", "text").collect()}
    first, found = {}, 0
    prints = {r["doc_id"]: audio.codes(audio.pitch_classes(r["text"].encode(), c)) for r in df.collect()}
    for d in sorted(prints):
        votes = defaultdict(int)
        for at, code in enumerate(prints[d].tolist()):
            if (code * 0x9E3779B1 & 0xFFFFFFFF) >> 16 & 3:
                continue
            if code in first and first[code][0] != d:
                votes[(first[code][0], at - first[code][1])] += 1
            first.setdefault(code, (d, at))
        best = max(((n, -m, -abs(o), o) for (m, o), n in votes.items() if n >= c.votes), default=None)
        assert got[d]["n_codes"] == len(prints[d]) and got[d]["codes_crc32"] == zlib.crc32(prints[d].astype("<u4").tobytes())
        if got[d]["match_id"] is not None:
            found += 1
            assert best == (got[d]["votes"], -got[d]["match_id"], -abs(got[d]["offset"]), got[d]["offset"])
        elif best:
            u, v = prints[d][max(0, best[3]):], prints[-best[1]][max(0, -best[3]):]
            n = min(len(u), len(v))
            assert n == 0 or np.bitwise_count(u[:n] ^ v[:n]).mean() / 32 > c.errors
    assert found


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = p.STAGES[0][1](spark, docs, sf)
    kept = p.STAGES[1][1](spark, good, sf)
    masked = p.STAGES[2][1](spark, kept, sf)
    mixed = p.STAGES[3][1](spark, masked, sf)
    assert good.columns == kept.columns == masked.columns == mixed.columns == docs.columns
    lost = docs.join(good, "doc_id", "left_anti").join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in lost}.get(1, 0) <= 0.02 * labels.where("quality = 1").count()
    groups = defaultdict(set)
    for r in nearcopies.near_copies(good).collect():
        groups[r["component_id"]].add(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in pii.find_pii(masked).collect()) == 0
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    chosen = mixed.collect()
    assert all(texts[r["doc_id"]] == r["text"] for r in chosen)
    check_packing([(r["doc_id"], r["text"]) for r in chosen], p.STAGES[4][1](spark, mixed, sf).collect(), 2048)
    assert set(p.run(spark, sf).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
