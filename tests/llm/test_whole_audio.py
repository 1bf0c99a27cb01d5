"""Alignments over every code, against a scan of all pairs of recordings."""

import random
from collections import defaultdict

import numpy as np

from millrace.llm import audio, queries

C = queries.TEXT_AS_SOUND


def recordings():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    long = [text(6000) for _ in range(6)]
    rows = [*long, *(text(1350 + 60 * k) for k in range(12))]
    rows += rows[6:]  # short copies
    mixed = long[0][:3008] + long[1][:3008]  # its codes were seen in others, but for the seam
    rows += [mixed, long[2][640:], mixed, text(700) * 5, long[3][1280:4480]]
    return list(enumerate(rows))


def scan(prints):
    out = {}
    for i in prints:
        ok = []
        for j in [j for j in prints if j < i]:
            votes, x, y = defaultdict(int), prints[i], prints[j]
            if len(x) and len(x) == len(y) and (x == y).all():
                ok.append((len(x), -j, 0, 0))
            for a, b in np.argwhere(x[:, None] == y[None, :]).tolist():
                votes[a - b] += 1
            for o, n in votes.items():
                u, v = x[max(0, o):], y[max(0, -o):]
                k = min(len(u), len(v))
                if n >= C.votes and np.bitwise_count(u[:k] ^ v[:k]).mean() / 32 <= C.errors:
                    ok.append((n, -j, -abs(o), o))
        out[i] = max(ok, default=None)
    return out


def test_all_codes_and_places(spark, tmp_path):
    rows = recordings()
    prints = {i: audio.codes(audio.pitch_classes(t.encode(), C)) for i, t in rows}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_chroma(spark, str(tmp_path)).collect()}
    want = scan(prints)
    missed = [i for i, w in want.items() if (None if got[i]["match_id"] is None else (got[i]["votes"], -got[i]["match_id"], -abs(got[i]["offset"]), got[i]["offset"])) != w]
    assert not missed and sum(w is not None for w in want.values()) > 12


def test_short_copies_match(spark, tmp_path):
    rows = recordings()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["match_id"] for r in queries.op10_chroma(spark, str(tmp_path)).collect()}
    assert [got[18 + k] for k in range(12)] == [6 + k for k in range(12)]


def test_blocks_do_not_matter(spark):
    """Several small blocks, against the scan."""
    rows = recordings()
    prints = {i: audio.codes(audio.pitch_classes(t.encode(), C)) for i, t in rows}
    got = {r["doc_id"]: r for r in audio.align_all(spark.createDataFrame(rows, "doc_id long, text string"), C, "doc_id", "text", block=150).collect()}
    assert sum(map(len, prints.values())) > 600
    want = scan(prints)
    assert all((None if got[i]["match_id"] is None else (got[i]["votes"], -got[i]["match_id"], -abs(got[i]["offset"]), got[i]["offset"])) == w for i, w in want.items())
