"""Fingerprints, calibration and recall against plain computations."""

import zlib

import numpy as np

from millrace.llm import audio, quality, vectors

from tests.llm.test_llm import melody, pcm


def plain_codes(chroma):
    """Each filter summed cell by cell."""
    out = []
    for t in range(len(chroma) - audio.WIDEST + 1):
        code = 0
        for shape, low, height, width in audio.filters():
            one = rest = 0.0
            for f in range(width):
                for k in range(height):
                    v = float(chroma[t + f, low + k])
                    early, lower = f < width // 2, k < height // 2
                    inside = (lower, early, early == lower, height // 4 <= k < height - height // 4, width // 4 <= f < width - width // 4)[shape]
                    one, rest = (one + v, rest) if inside else (one, rest + v)
            value = np.log((1 + one) / (1 + rest))
            level = int(value > -0.25) + int(value > 0) + int(value > 0.25)
            code = code << 2 | (0, 1, 3, 2)[level]
        out.append(code)
    return out


def test_codes_equal_plain_sums():
    rng = np.random.default_rng(1)
    for n in (10, 16, 40):
        chroma = rng.random((n, 12)).astype(np.float32)
        chroma /= np.linalg.norm(chroma, axis=1, keepdims=True)
        got, want = audio.codes(chroma).tolist(), plain_codes(chroma)
        assert len(got) == len(want) and np.bitwise_count(np.array(got, np.uint32) ^ np.array(want, np.uint32)).sum() <= 1  # a value on a threshold


def test_pitch_class_of_a_tone():
    c = audio.Chroma()
    t = np.arange(3 * c.rate) / c.rate
    for semitone in range(12):
        chroma = audio.pitch_classes((np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t) * 20000).astype("<i2").tobytes(), c)
        assert (chroma.argmax(1) == semitone % 12).all()


def test_noisy_excerpts_align(spark):
    """Excerpts of known recordings under noise: offset and recording are found."""
    c = audio.Chroma()
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(12):
        x = melody(100 + k, 20)
        rows.append((k, pcm(x)))
        cut = int(rng.integers(2, 12))
        part = x[cut * c.hop:]
        rows.append((100 + k, pcm(part + rng.normal(0, 0.2, len(part)))))
        want[100 + k] = (k, -cut)
    got = {r["id"]: (r["match_id"], r["offset"]) for r in audio.align_all(spark.createDataFrame(rows, "id long, audio binary"), c).collect()}
    assert sum(got[i] == w for i, w in want.items()) >= 11


def test_scores_are_calibrated(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out("doc_id")).collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert abs(score.mean() - label.mean()) < 0.08
    sure = (score > 0.9) | (score < 0.1)
    assert sure.mean() > 0.5 and ((score > 0.5) == label)[sure].mean() > 0.95


def test_recall_near_the_threshold(spark):
    """Pairs just above the least cosine, among others just below it."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        a = rng.standard_normal(64)
        u = rng.standard_normal(64)
        u -= u @ a / (a @ a) * a
        angle = np.arccos(0.9803 if k % 2 else 0.9797)
        b = a / np.linalg.norm(a) * np.cos(angle) + u / np.linalg.norm(u) * np.sin(angle)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, b.tolist(), 1)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=256).collect()}
    near = [got[i] for i, _, _ in rows if i // 2 % 2]
    assert all(got[i] == 0 for i, _, _ in rows if not i // 2 % 2) and np.mean(near) > 0.995
