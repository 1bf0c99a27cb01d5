"""Runs of repeated phrases: Lyndon words under both orders, extended by hashed LCE.

A run is a stretch of words with smallest period q that no neighbouring word
extends. Every run holds, under the order of words or under its reverse, a
period that is the longest Lyndon word at its place. So a text is scanned right
to left under both orders with a stack of Lyndon words; each of them proposes
one period at one place, and the proposal is extended to both sides. Comparing
and extending ask for longest common extensions (LCE): a few words directly,
then a binary search over a rolling hash, whose answer is checked word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: A run has so many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Words that are compared one by one before hashes are asked.
DIRECT = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words between ASCII white space (null: none)."""
    return (text.encode() if isinstance(text, str) else text or b"").split()


class _Text:
    """Numbered words of a text with common extensions to the right and left."""

    def __init__(self, words: list[bytes]):
        number: dict[bytes, int] = {}
        self.n = len(words)
        self.ids = [number.setdefault(w, len(number)) for w in words]
        self.distinct = len(number)
        self.array = np.array([*self.ids, -1, -2, -3], np.int64)
        self.sums: list[np.ndarray] | None = None
        self.powers: np.ndarray | None = None
        self.known: dict[int, tuple[int, int]] = {}

    def _hashes(self) -> None:
        """Sums of mixed word numbers times powers, wrapping at 64 bits; once per text that needs them."""
        with np.errstate(over="ignore"):
            x = (self.array[:self.n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            x ^= x >> np.uint64(29)
            self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(self.n, _BASE))))
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(x * self.powers[:self.n])))

    def _equal(self, i: int, j: int, size: int) -> bool:
        """Whether the stretches at i and j (i < j) have one hash."""
        s = self.sums
        left = (int(s[i + size]) - int(s[i])) * int(self.powers[j - i])
        return (left - (int(s[j + size]) - int(s[j]))) & 0xFFFFFFFFFFFFFFFF == 0

    def _search(self, most: int, same: Callable[[int], bool], stretch: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> int:
        """Largest size up to ``most`` that is equal: hashes tell, words decide."""
        if self.sums is None:
            self._hashes()
        low, step = 0, DIRECT
        while low + step <= most and same(low + step):
            low += step
            step *= 2
        high = min(most, low + step)
        while low < high:
            mid = (low + high + 1) // 2
            if same(mid):
                low = mid
            else:
                high = mid - 1
        a, b = stretch(low)
        wrong = np.flatnonzero(a != b)  # equal hashes of different words: what is before the first of them is equal
        return int(wrong[0]) if wrong.size else low

    def right(self, i: int, j: int) -> int:
        """Words from i and from j on (i < j) that are equal."""
        ids, n = self.ids, self.n
        stop = min(n - j, DIRECT)
        k = 0
        while k < stop and ids[i + k] == ids[j + k]:
            k += 1
        if k < DIRECT or j + k == n:
            return k
        at, size = self.known.get(j - i, (-1, 0))
        if 0 <= i < at <= i + k:  # the stretch meets one that was measured at this distance
            size += at - i
        elif not 0 <= at <= i < at + size:
            a = self.array
            size = self._search(n - j, lambda m: self._equal(i, j, m), lambda m: (a[i:i + m], a[j:j + m]))
        else:
            size -= i - at
        self.known[j - i] = (i, size)
        return size

    def left(self, i: int, j: int) -> int:
        """Words before i and before j (i < j) that are equal."""
        ids = self.ids
        stop = min(i, DIRECT)
        k = 0
        while k < stop and ids[i - 1 - k] == ids[j - 1 - k]:
            k += 1
        if k < DIRECT or k == i:
            return k
        a = self.array
        return self._search(i, lambda m: self._equal(i - m, j - m, m), lambda m: (a[i - m:i][::-1], a[j - m:j][::-1]))

    def lyndon_ends(self, reverse: bool) -> list[int]:
        """Where the longest Lyndon word at each place ends, scanned right to
        left; words on the stack are reached through their ends."""
        a = [self.distinct - 1 - x for x in self.ids] if reverse else self.ids
        a = [*a, -1]
        end = [self.n] * (self.n + 1)
        right = self.right
        for i in range(self.n - 1, -1, -1):
            x, j = a[i], i + 1
            while True:
                y = a[j]
                if x < y:
                    j = end[j]
                elif x > y:
                    break
                else:
                    k = right(i, j)
                    if a[i + k] < a[j + k]:
                        j = end[j]
                    else:
                        break
            end[i] = j
        return end


def runs(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with ``length >= max(least_words,
    least_periods * period)``, by start, then period.

    ``least_periods`` is 2 at least. No words, no runs. Time grows as n log n
    words at worst, memory as n.
    """
    t = _Text(words)
    n, a, out = t.n, t.array, set()
    if n < max(least_words, 2):
        return []
    padded = np.concatenate(([-6, -5, -4], a))
    for reverse in (False, True):
        ends = np.array(t.lyndon_ends(reverse)[:n])
        i = np.flatnonzero(ends < n)
        j = ends[i]
        period = j - i
        need = np.maximum(least_words - period, (least_periods - 1) * period)  # equal pairs of words, both sides together
        near = (a[i] == a[j]) | (padded[i + 2] == padded[j + 2])
        if least_words >= 12:  # then six pairs at least, so three of them on one side
            near = (a[i] == a[j]) & (a[i + 1] == a[j + 1]) & (a[i + 2] == a[j + 2])
            near |= (padded[i + 2] == padded[j + 2]) & (padded[i + 1] == padded[j + 1]) & (padded[i] == padded[j])
        seen: dict[int, tuple[int, int]] = {}
        for x, y, p, least in zip(i[near].tolist(), j[near].tolist(), period[near].tolist(), need[near].tolist(), strict=True):
            start, stop = seen.get(p, (0, 0))
            if start <= x and y <= stop:  # another word of a stretch that is known
                continue
            start, stop = x - t.left(x, y), y + t.right(x, y)
            seen[p] = (start, stop)
            if stop - start - p >= least:
                out.add((start, stop - start, p))
    return sorted(out)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, size, p in found:
        drop[start + p] += 1
        drop[start + size] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
              least_words: int = LEAST_WORDS, keep_text: bool = False) -> DataFrame:
    """One row per input row: the runs of each whole text and what is left without them.

    Columns: the id, ``n_runs``, ``start length period exponent_milli`` of the
    longest run (ties: smallest start, then period; NULL without runs),
    ``runs_sha256`` (all runs as ``start,length,period`` lines), and
    ``collapsed_sha256``; with ``keep_text`` also ``runs`` (array) and
    ``collapsed`` (the text, words joined by one space). ``edit`` may change
    the words of a document, given its id. A null text has no words; null ids
    stay null; repeated rows are repeated; other columns, whatever their names,
    are ignored; an empty table gives no rows. No shuffle: texts are scanned
    where they are read.
    """
    one = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        *(T.StructField(k, T.LongType()) for k in ("n_runs", "start", "length", "period", "exponent_milli")),
        T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
        *([T.StructField("runs", T.ArrayType(one)), T.StructField("collapsed", T.StringType())] if keep_text else []),
    ])
    runs_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            longs: list[list] = [[] for _ in range(5)]
            sums, left, lists, texts = [], [], [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                if edit:
                    words = edit(name, words)
                found = runs(words, least_words)
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                for x, v in zip(longs, (len(found), *best, 1000 * best[1] // best[2] if found else None), strict=True):
                    x.append(v)
                sums.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest())
                rest = b" ".join(collapsed(words, found))
                left.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    texts.append(rest.decode())
            more = [pa.array(lists, runs_type), pa.array(texts, pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in longs), pa.array(sums, pa.string()), pa.array(left, pa.string()), *more], names=schema.names)

    return docs.select(docs[id_col], docs[text_col].cast("string").cast("binary").alias("__text")).mapInArrow(scan, schema)
