"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Tokens are lower-case words and their beginnings; a word stands for its longest
token that the lexicon has. Labelled documents give each token the log-odds of
its document frequencies under a Dirichlet prior that follows the whole corpus;
its lower confidence bound is the token's score (divided by k where a text uses
it for the k-th time) and any other word costs ``DRIFT``. A linear scan finds all maximal-scoring segments
of a text. Under clean text, segment scores follow an extreme-value law; its
rate and size are fitted on clean documents, turn each segment's score into an
expected number of chance segments, and a document's segments into one
calibrated score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Labelled rows of each class that the model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Tokens of the model, at most, and bytes of the longest one.
LEXICON, TOKEN_BYTES = 50_000, 64
#: Lengths of the beginnings of words that count as tokens.
STEMS = range(3, 9)
#: Documents that the prior counts as, and standard errors taken off the log-odds.
PRIOR, ERRORS = 100.0, 1.25
#: Least score of a token, and cost of a word without one.
LEAST, DRIFT = 1.0, 0.2
#: Expected chance segments at which one counts as significant.
SIGNIFICANT = 0.05
_WORD = re.compile(r"\w+")
_CACHED = 200_000


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text (null: none)."""
    return _WORD.findall((text or "").lower())


def tokens_of(word: str) -> list[str]:
    """The word, marked by its end, and its beginnings, longest first."""
    return [word + "$", *(word[:k] for k in reversed(STEMS) if k <= len(word))]


@dataclass(frozen=True)
class ToxicityModel:
    """Everything scoring needs; bounded by ``LEXICON``. A token of weight 0 is
    an ordinary word, whatever its beginning."""

    weights: dict[str, float]
    rate: float
    size: float
    slope: float
    intercept: float

    def expected(self, score: float, n: int) -> float:
        """Segments of at least this score that clean text of n words has by chance."""
        return self.size * max(n, 1) * float(np.exp(-self.rate * score))


class Lexicon:
    """The longest token of a word that is known, with a bounded memory of words."""

    def __init__(self, known):
        self.known = known
        self.cache: dict[str, str] = {}

    def token(self, word: str) -> str:
        """'' if none is."""
        got = self.cache.get(word)
        if got is None:
            got = next((t for t in tokens_of(word) if t in self.known), "")
            if len(self.cache) >= _CACHED:
                self.cache.clear()
            self.cache[word] = got
        return got

    def tokens(self, text: str | None) -> set[str]:
        """Those of a text."""
        return set(map(self.token, set(words_of(text)))) - {""}


class Scanner:
    """Segments of texts under one model."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.token = Lexicon(weights).token

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of each word."""
        out = np.full(len(words), -DRIFT)
        times: dict[str, int] = {}
        for i, t in enumerate(map(self.token, words)):
            if t:
                times[t] = times.get(t, 0) + 1
                w = self.weights[t]
                if w > 0:
                    out[i] = w / times[t]
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first word, end, score) of every maximal-scoring segment."""
        return maximal_segments(self.scores(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a sequence, in order, in linear time.

    They are disjoint, each begins and ends with a positive score, and none of
    them gains by being longer or shorter.
    """
    at = np.flatnonzero(scores > 0)
    if not at.size:
        return []
    upto = np.concatenate(([0.0], np.cumsum(scores)))
    first: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    before: list[int] = []  # the nearest earlier segment that begins lower
    for i in at.tolist():
        s, left, right = i, float(upto[i]), float(upto[i + 1])
        j = len(first) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = before[j]
            if j < 0 or high[j] >= right:
                break
            s, left = first[j], low[j]
            for x in (first, end, low, high, before):
                del x[j:]
            j -= 1
        first.append(s)
        end.append(i + 1)
        low.append(left)
        high.append(right)
        before.append(j)
    return [(s, e, h - x) for s, e, x, h in zip(first, end, low, high, strict=True)]


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """Text, class and half (of the rank by hash) of at most ``rows`` documents a class, and the classes' sizes."""
    known = (
        labels.select(labels[id_col].alias("k"), labels[label_col].cast("int").alias("y"))
        .where("k is not null and y in (0, 1)").where(~held_out("k"))
        .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("y") == y).select("k", "y", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(rows) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(docs[id_col].alias("k"), docs[text_col].cast("string").alias("t")).join(F.broadcast(chosen), "k")
    return texts.select("t", "y", F.expr("cast(pmod(h, 2) as int)").alias("half")), totals


def _counted(docs: DataFrame, schema: T.StructType, count, flush: int = 300_000) -> DataFrame:
    """Sums of small counters per token: ``count(batch, counters)`` fills them, full ones leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter() for _ in schema.names[1:]]

        def out() -> pa.RecordBatch:
            keys = list(set().union(*counters))
            columns = [pa.array([c[k] for k in keys], pa.int64()) for c in counters]
            for c in counters:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], schema.names)

        for b in slices(batches, 200):
            count(b, counters)
            if sum(map(len, counters)) >= flush:
                yield out()
        yield out()

    return docs.mapInArrow(run, schema).groupBy(schema.names[0]).agg(*(F.sum(n).alias(n) for n in schema.names[1:]))


def _counts(names: str) -> T.StructType:
    return T.StructType([T.StructField("token", T.StringType()), *(T.StructField(n, T.LongType()) for n in names.split())])


def _document_tokens(text: str | None) -> set[str]:
    return {t for w in set(words_of(text)) for t in tokens_of(w) if len(t.encode()) <= TOKEN_BYTES}


def _log_odds(y1, n1, y0, n0, share):
    """Log-odds of two document frequencies and its standard error, under a prior of that share."""
    a = PRIOR * share
    value = np.log((y1 + a) / (n1 + PRIOR - y1 - a)) - np.log((y0 + a) / (n0 + PRIOR - y0 - a))
    return value, np.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def _shortest(counts: dict[str, tuple[int, int]], n0: int, n1: int) -> frozenset[str]:
    """The tokens that say more than each of their beginnings: where a beginning
    scores as high, it also covers words not seen yet."""
    y0, y1 = np.array(list(counts.values()), float).T
    value, error = _log_odds(y1, n1, y0, n0, np.minimum((y0 + y1) / (n0 + n1), 0.5))
    kept: dict[str, float] = {}
    for t, w in sorted(zip(counts, (value - ERRORS * error).tolist(), strict=True), key=lambda x: (len(x[0]), x[0])):
        if all(kept.get(t[:k], -np.inf) < w for k in STEMS if k < len(t)):
            kept[t] = w
    return frozenset(kept)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents of each class, chosen by a
    hash of the id among those not held out; the prior counts all documents.

    Labels that are null, neither 0 nor 1 or contradictory for an id are left
    out. One half of the documents gives the log-odds, the other the
    extreme-value law and the calibration, weighted to the classes' shares
    among all labels used. With one class missing, every score is that of the
    other class's share.
    """
    texts, totals = _labelled(docs, labels, rows, id_col, text_col, label_col)

    def by_class(b: pa.RecordBatch, counters: list[Counter]) -> None:
        for t, y, half in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if half == 0:
                counters[y].update(_document_tokens(t))
                counters[y][""] += 1

    counts = _counted(texts, _counts("y0 y1"), by_class)
    got = {r["token"]: (r["y0"], r["y1"]) for r in counts.where("token = ''").collect()}
    n0, n1 = got.get("", (0, 0))
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    nothing = ToxicityModel({}, 1.0, 1.0, 0.0, float(np.log(share / (1 - share))))
    if not n0 or not n1:
        return nothing
    # the most telling tokens, at most LEXICON of them, by a score that needs no more than these counts
    top = (
        counts.where("token <> '' and y1 >= 3").where(F.expr(f"y1 * {n0} > 2 * y0 * {n1}"))
        .withColumn("z", F.expr(f"(y1 / {n1} - y0 / {n0}) / sqrt((y1 + 1) / pow({n1}, 2) + (y0 + 1) / pow({n0}, 2))"))
        .orderBy(F.desc("z"), "token").limit(LEXICON).collect()
    )
    if not top:
        return nothing
    known = _shortest({r["token"]: (r["y0"], r["y1"]) for r in top}, n0, n1)
    # what counts is how often a word stands for a token, in the sample and in the whole corpus

    def matched_by_class(b: pa.RecordBatch, counters: list[Counter]) -> None:
        lexicon = Lexicon(known)
        for t, y, half in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if half == 0:
                counters[y].update(lexicon.tokens(t))

    corpus_lexicon: list[Lexicon] = []

    def matched(b: pa.RecordBatch, counters: list[Counter]) -> None:
        if not corpus_lexicon:
            corpus_lexicon.append(Lexicon(known))
        for text in b.column(0):
            counters[0].update(corpus_lexicon[0].tokens(text.as_py()))
            counters[0][""] += 1

    found = {r["token"]: (r["y0"], r["y1"]) for r in _counted(texts, _counts("y0 y1"), matched_by_class).collect()}
    spread = {r["token"]: r["n"] for r in _counted(docs.select(docs[text_col].cast("string").alias("t")), _counts("n"), matched).collect()}
    names = sorted(found)
    if not names:
        return nothing
    y0, y1 = np.array([found[t] for t in names], float).T
    share_of = np.array([max(spread.get(t, 0), sum(found[t])) for t in names], float) / max(spread[""], 1)
    value, error = _log_odds(y1, n1, y0, n0, np.minimum(share_of, 0.5))
    weight = value - ERRORS * error
    weights = {t: float(w) if w >= LEAST else 0.0 for t, w in zip(names, weight, strict=True)}
    if not any(weights.values()):
        return nothing
    return _calibrated(texts, weights, totals)


def _calibrated(texts: DataFrame, weights: dict[str, float], totals: dict[int, int]) -> ToxicityModel:
    """The extreme-value law of clean documents and the logistic curve over it."""
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("positive", T.ArrayType(T.DoubleType())), T.StructField("segments", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(weights)
        for b in slices(batches):
            rows: list[list] = [[], [], [], []]
            for t, y, half in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if half == 1:
                    w = scanner.scores(words_of(t))
                    found = sorted((s for *_, s in maximal_segments(w)), reverse=True)
                    for x, v in zip(rows, (y, len(w), w[w > 0].tolist(), found), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *(pa.array(x, pa.list_(pa.float64())) for x in rows[2:])], schema.names)

    scored = texts.mapInArrow(run, schema)
    # scores of clean words, to a hundredth: a histogram whose size the weights bound
    clean = scored.where("y = 0")
    step = 100
    seen = {r["s"]: r["n"] for r in clean.select(F.explode("positive").alias("s")).groupBy(F.ceil(F.col("s") * step).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    words, docs = clean.agg(F.sum("n"), F.count(F.lit(1))).first()
    words = max(words or 0, 1)
    middle = float(np.median([w for w in weights.values() if w]))
    s = np.array([-DRIFT, middle, *(k / step for k in seen)])
    p = np.array([max(words - sum(seen.values()), 1), 1, *seen.values()], float)  # one chance word more than was seen
    p /= p.sum()
    low, high = 1e-3, 5.0
    for _ in range(60):  # the positive root of E[exp(rate * score)] = 1
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    rate = low
    total = clean.agg(F.sum(F.expr(f"greatest(n, 1) * exp(-{rate!r} * coalesce(try_element_at(segments, 1), 0D))"))).first()[0]
    law = ToxicityModel(weights, rate, (docs or 1) / max(total or 0.0, 1.0), 0.0, 0.0)
    rows = [(r["y"], document_value(law, r["n"], r["segments"])) for r in scored.select("y", "n", F.slice("segments", 1, 64).alias("segments")).toLocalIterator()]
    y, x = (np.array(c, float) for c in zip(*rows, strict=True)) if rows else (np.zeros(0), np.zeros(0))
    if not 0 < y.sum() < len(y):
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return ToxicityModel(weights, rate, law.size, 1.0, float(np.log(share / (1 - share))))
    w = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    from .quality import _logistic

    slope, intercept = _logistic(x, y, w / w.mean())
    return ToxicityModel(weights, rate, law.size, max(0.0, slope), intercept)


def document_value(model: ToxicityModel, n: int, segments: list[float]) -> float:
    """How unlikely a document's segments are in clean text: minus the logarithm
    of the best one's extreme-value probability, plus that of the expected
    number of every further significant one."""
    if not segments:
        return 0.0
    best, *more = sorted(segments, reverse=True)
    e = model.expected(best, n)
    value = -float(np.log(-np.expm1(-e))) if e > 1e-12 else -float(np.log(e)) if e > 0 else 700.0
    for s in more:
        e = model.expected(s, n)
        if e >= SIGNIFICANT:
            break
        value += -float(np.log(max(e, 1e-300)))
    return float(np.log1p(value))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1, higher: more toxic) and ``n_passages`` (significant
    ones) of every whole text, beside the id.

    A null text counts as empty, an empty text has no segment and gets the
    curve's lowest score; a null id stays null; rows are kept as they are,
    repeated ones too; an empty table gives no rows. Only the text enters.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.weights)
        for b in slices(batches):
            values, passages = [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                found = [s for *_, s in scanner.segments(words)]
                values.append(document_value(model, len(words), found))
                passages.append(sum(model.expected(s, len(words)) < SIGNIFICANT for s in found))
            x = 1 / (1 + np.exp(-np.clip(model.slope * np.array(values, float) + model.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64()), pa.array(passages, pa.int64())], schema.names)

    return docs.select(docs[id_col], docs[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


def find_passages(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", significant: float = SIGNIFICANT) -> DataFrame:
    """One row per significant passage: the id, ``start`` and ``end`` (code
    points, end exclusive), ``passage``, ``score`` and ``expected`` (chance
    segments as high). Texts that are null or have none give no rows; null ids
    stay null; repeated rows are repeated.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("passage", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.weights)
        for b in slices(batches):
            rows: list[list] = [[] for _ in schema.names]
            for k, text in enumerate(b.column(1).to_pylist()):
                words = words_of(text)
                found = [(s, e, v, x) for s, e, v in scanner.segments(words) if (x := model.expected(v, len(words))) < significant]
                if not found:
                    continue
                lowered = text.lower()
                places = [m.span() for m in _WORD.finditer(lowered)]
                if len(lowered) != len(text):  # letters that become two in lower case: places from the prefix's own length
                    back = np.searchsorted(np.cumsum([len(c.lower()) for c in text]), np.array(places).ravel(), "right").tolist()
                    places = list(zip(back[::2], back[1::2], strict=True))
                for s, e, v, x in found:
                    start, end = places[s][0], places[e - 1][1]
                    for c, value in zip(rows, (k, start, end, text[start:end], v, x), strict=True):
                        c.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()),
                                              pa.array(rows[3], pa.string()), pa.array(rows[4], pa.float64()), pa.array(rows[5], pa.float64())], schema.names)

    return docs.select(docs[id_col], docs[text_col].cast("string").alias("__text")).mapInArrow(run, schema)
