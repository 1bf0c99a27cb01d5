"""Two tokenizers' tokens of one text, aligned by a dangling-suffix transducer.

Both token sequences spell the same bytes. The transducer reads from the side
that is behind and keeps only what the other side is ahead by: which side leads
and its unmatched bytes. Each token read overlaps exactly the leading token, so
it is one link; an empty residual closes a group. Transitions are remembered by
residual and token, and a worker remembers whole stretches between plain spaces,
where both tokenizers always cut.

Documents travel in blocks of about ``BLOCK_BYTES`` of text: a block's distinct
links go to the corpus-wide counts and come back with them, so that a shuffled
row stands for all documents of a block. No task gathers blocks: files hold them
in row groups of a few, and counts meet a block's documents a block at a time.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written
from .tokens import _ALPHABET, encoder, read_spec

#: Text of a block, about; a longer document is a block of its own.
BLOCK_BYTES = 4_000_000
#: Row groups of the blocks' files, about; a reader decodes one at a time, and a writer looks at its size after every block.
ROW_GROUP_BYTES = 8_000_000
#: Stretches, and bytes of them, at which a worker's memory of stretches starts anew (between blocks).
CACHED, CACHED_BYTES = 250_000, 16_000_000
#: States and transitions of the transducer that are remembered, at most.
STATES = 300_000
#: A space where both tokenizers cut: not after another one, and not before white space of any kind.
_BLANK = "\\s\u180e\u200b\ufeff"
_CUT = re.compile(f"(?<! ) (?=[^{_BLANK}])")
_MIXED = re.compile(f" [{_BLANK}]| $")
_SPACE = "\u2581"


def byte_level_tokens(spec: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary of the tokenizers library."""
    tok = encoder(spec).tok
    back = {chr(c): b for b, c in _ALPHABET.items()}
    out = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        piece = tok.id_to_token(i) or ""
        out.append(bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode())
    return out


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_SPACE, " ").encode())
    return out


class Transducer:
    """Groups of two token sequences over the same bytes.

    A state is 0 where neither side leads, positive where A does and negative
    where B does; ``names`` has the unmatched bytes of each.
    """

    def __init__(self, a_tokens: list[bytes], b_tokens: list[bytes]):
        self.a_tokens, self.b_tokens = a_tokens, b_tokens
        self.a_shown, self.b_shown = [str(i) for i in range(len(a_tokens))], [str(i) for i in range(len(b_tokens))]
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {}
        self.names: list[bytes] = [b""]
        self.moves: dict[int, int | None] = {}

    def _state(self, side: int, residual: bytes) -> int:
        if not residual:
            return 0
        key = (side, residual)
        if key not in self.states:
            self.states[key] = side * len(self.names)
            self.names.append(residual)
        return self.states[key]

    def _move(self, state: int, token: int) -> int | None:
        """The state after a token of the side that is behind (A's where none leads); None if bytes differ."""
        residual = self.names[abs(state)]
        side = -1 if state > 0 else 1
        text = (self.a_tokens if side > 0 else self.b_tokens)[token]
        if residual.startswith(text):
            after = self._state(-side, residual[len(text):])
        elif text.startswith(residual):
            after = self._state(side, text[len(residual):])
        else:
            after = None
        self.moves[state << 20 | token] = after
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """Each group as ``a1,a2|b1`` and all links as ``a << 32 | b``, in order; None where the bytes differ."""
        if len(self.names) + len(self.moves) > STATES:
            self._forget()
        moves, a_shown, b_shown = self.moves, self.a_shown, self.b_shown
        n_a, n_b = len(a), len(b)
        groups: list[str] = []
        links: list[int] = []
        i = j = state = x = y = 0
        first_a = first_b = 0
        while True:
            if state > 0:
                if j == n_b:
                    return None
                y = b[j]
                j += 1
                links.append(x << 32 | y)
                key = state << 20 | y
            else:
                if i == n_a:
                    return (groups, links) if state == 0 and j == n_b else None
                x = a[i]
                i += 1
                if state:
                    links.append(x << 32 | y)
                key = state << 20 | x
            state = moves[key] if key in moves else self._move(state, key & 0xFFFFF)
            if state == 0:
                if i - first_a == 1 and j - first_b == 1:
                    groups.append(f"{a_shown[x]}|{b_shown[y]}")
                else:
                    groups.append(",".join([a_shown[t] for t in a[first_a:i]]) + "|" + ",".join([b_shown[t] for t in b[first_b:j]]))
                first_a, first_b = i, j
            elif state is None:
                return None


class Aligner:
    """Aligned documents of one worker."""

    def __init__(self, spec: str, model: bytes):
        self.a = encoder(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        #: Stretches between plain spaces tokenize on their own only if no piece crosses such a space.
        self.cuts = self.a.kind == "byte" and all(_SPACE not in p.lstrip(_SPACE) for p in pieces)
        self.transducer = Transducer(byte_level_tokens(spec), piece_tokens(self.b))
        #: With a token for each byte and no normalizer, ids always spell the text.
        self.lossless = self.a.kind == "byte" and len({t for t in self.transducer.a_tokens if len(t) == 1}) == 256
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.text: list[str] = []
        self.facts = array("q")  # n_a, n_b, n_groups of each stretch; n_a is -1 where bytes differ
        self.links = array("q")
        self.ends = array("q", [0])

    def full(self) -> bool:
        return len(self.number) > CACHED or self.held > CACHED_BYTES

    def _cut(self, text: str) -> list[str]:
        """The stretches of a text, each without the space before it."""
        if not self.cuts:
            return [text]
        if _MIXED.search(" " + text):
            first, *rest = _CUT.split(" " + text)
            return [first[1:], *rest] if first else rest
        return text.split(" ")

    def _learn(self, stretches: list[str]) -> None:
        raw = [b" " + s.encode() for s in stretches]
        align, spelt = self.transducer.align, self.transducer.a_tokens
        facts, links, ends = [], [], []
        held = len(self.links)
        for text, ids, b in zip(raw, self.a.encode(raw), self.b.encode(stretches), strict=True):
            a = ids.tolist()
            got = align(a, b)
            if got is None or not self.lossless and b"".join([spelt[t] for t in a]) != text:
                facts += (-1, 0, 0)
                self.text.append("")
            else:
                facts += (len(a), len(b), len(got[0]))
                self.text.append(";".join(got[0]))
                links += got[1]
            ends.append(held + len(links))
            self.held += len(text)
        self.facts.extend(facts)
        self.links.extend(links)
        self.ends.extend(ends)

    def documents(self, texts: list[str | None]) -> list[np.ndarray]:
        """The stretches of each text by number; new ones are learnt."""
        parts = [self._cut(t) if t else [] for t in texts]
        number = self.number
        new = []
        for p in parts:
            for s in p:
                if s not in number:
                    number[s] = len(number)
                    new.append(s)
        for i in range(0, len(new), 5000):
            self._learn(new[i:i + 5000])
        return [np.fromiter(map(number.__getitem__, p), np.int64, len(p)) for p in parts]


_ALIGNERS: dict[tuple[str, bytes], Aligner] = {}


def _aligner(spec: str, model: bytes) -> Aligner:
    key = (hashlib.sha256(spec.encode()).hexdigest(), hashlib.sha256(model).digest())
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(spec, model)
    return _ALIGNERS[key]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and sums of n."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], np.add.reduceat(n[order], at) if at.size else n[:0]


_PER_DOCUMENT = ("n_a", "n_b", "n_groups", "n_links")


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))).newbyteorder("<"))


def wide(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of :func:`narrow`."""
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _blocks(docs: DataFrame, id_col: str, text_col: str, spec: str, model: bytes, keep_groups: bool) -> DataFrame:
    """One row per block: documents as arrays, distinct links with their counts,
    and for each document its entries (place of a link in ``pair``, how often),
    these as the bytes of the narrowest unsigned integers."""
    longs = T.ArrayType(T.LongType())
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("id", T.ArrayType(kind)), *(T.StructField(k, longs) for k in _PER_DOCUMENT), T.StructField("sha", T.ArrayType(T.StringType())),
        T.StructField("groups", T.ArrayType(T.StringType())), T.StructField("pair", longs), T.StructField("n", longs), T.StructField("entries", longs), T.StructField("place", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def row(name: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        al = _aligner(spec, model)
        if al.full():
            al.forget()
        found = al.documents(texts)
        facts = np.frombuffer(al.facts, np.int64).reshape(-1, 3)
        ends = np.frombuffer(al.ends, np.int64)
        links = np.frombuffer(al.links, np.int64) if al.links else np.zeros(0, np.int64)
        good = [len(x) > 0 and bool((facts[x, 0] >= 0).all()) for x in found]
        found = [x if g else x[:0] for x, g in zip(found, good, strict=True)]
        shas, groups, sums = [], [], np.zeros((len(found), 3), np.int64)
        for k, x in enumerate(found):
            whole = ";".join(map(al.text.__getitem__, x.tolist()))
            shas.append(hashlib.sha256(whole.encode()).hexdigest() if good[k] else "")
            groups.append(whole if keep_groups else None)
            sums[k] = facts[x].sum(0)
        # (document, stretch) with counts, then (document, link)
        size = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        key, n = _summed(np.repeat(np.arange(len(found)), size) << 32 | flat, np.ones(len(flat), np.int64))
        s = key & 0xFFFFFFFF
        width = ends[s + 1] - ends[s]
        total = np.cumsum(width)
        every = links[np.repeat(ends[s] - (total - width), width) + np.arange(int(total[-1]) if len(total) else 0)]
        pair, place = np.unique(every, return_inverse=True)
        key, times = _summed(np.repeat(key >> 32, width) << 32 | place.reshape(-1), np.repeat(n, width))
        place, owner = key & 0xFFFFFFFF, key >> 32
        block_n = np.zeros(len(pair), np.int64)
        np.add.at(block_n, place, times)
        n_links = sums[:, 0] + sums[:, 1] - sums[:, 2]  # a group of a and b tokens has a + b - 1 links

        def one(values, kind=None) -> pa.Array:
            values = values if isinstance(values, pa.Array) else pa.array(values, kind)
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), one(ids), *(one(sums[:, k]) for k in range(3)), one(n_links), one(shas, pa.string()), one(groups, pa.string()),
             one(pair), one(block_n), one(np.bincount(owner, minlength=len(found)).astype(np.int64)), *(pa.array([narrow(x).tobytes()], pa.binary()) for x in (place, times))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        texts: list[str | None] = []
        held = 0
        for b in slices(batches, 64):
            for k, text in enumerate(b.column(1)):
                t = text.as_py()
                ids.append(b.column(0).slice(k, 1))
                texts.append(t)
                held += 16 + len(t or "")
                if held >= BLOCK_BYTES:
                    yield row(name, pa.concat_arrays(ids), texts)
                    ids, texts, held, name = [], [], 0, name + 1
        if ids:
            yield row(name, pa.concat_arrays(ids), texts)

    return docs.select(docs[id_col], docs[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


def align(docs: DataFrame, byte_tokenizer: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per input row: how two tokenizers' tokens of a space and the whole text align.

    Columns: the id, ``n_a n_b n_groups n_links``, ``n_best`` (links whose id
    pair is the corpus's most frequent for its B id, ties included),
    ``count_sum`` (over links, how often the corpus has the pair),
    ``groups_sha256`` and, with ``keep_groups``, ``groups``. Texts that are
    null, empty or spelt differently by a tokenizer have no tokens: zeros and
    ''. Null ids stay null; repeated rows are repeated and counted each; other
    columns, whatever their names, are ignored; an empty table gives no rows.

    ``byte_tokenizer`` (JSON of the tokenizers library) and ``piece_model``
    (sentencepiece) are paths that the driver reads.
    """
    spec = read_spec(byte_tokenizer)
    with open(piece_model, "rb") as f:
        model = f.read()
    blocks = written(_blocks(docs, id_col, text_col, spec, model, keep_groups), "aligned", **{"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size.row.check.min": 1})
    counts = pair_counts(blocks)
    best = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("most"))
    named = counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = blocks.select("block", F.posexplode("pair").alias("at", "pair")).join(named, "pair").select(F.col("block").alias("of"), "at", "count", "best")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(k, T.LongType()) for k in (*_PER_DOCUMENT, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType()),
                           *([T.StructField("groups", T.StringType())] if keep_groups else [])])

    def finish(block: pa.Table, links: pa.Table) -> pa.Table:
        """The documents of one block, with the counts of its links."""
        got = {n: block.column(n)[0].values for n in block.column_names if n not in ("block", "place", "times")}
        entries = got["entries"].to_numpy()
        owner, n = np.repeat(np.arange(len(entries)), entries), int(entries.sum())
        place, times = (wide(block.column(k)[0].as_py(), n) for k in ("place", "times"))
        sums = []
        for name in ("best", "count"):
            values = np.zeros(links.num_rows, np.int64)
            values[links.column("at").to_numpy()] = links.column(name).to_numpy()
            out = np.zeros(len(entries), np.int64)
            np.add.at(out, owner, values[place] * times)
            sums.append(pa.array(out))
        return pa.Table.from_arrays([got["id"], *(got[k] for k in _PER_DOCUMENT), *sums, got["sha"], *([got["groups"]] if keep_groups else [])], names=schema.names)

    whole = blocks.select("block", "id", *_PER_DOCUMENT, "sha", *(["groups"] if keep_groups else []), "entries", "place", "times")
    return whole.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(finish, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """How many links hold each id pair (``pair``: A's id in the upper 32 bits) corpus-wide."""
    return blocks.select(F.arrays_zip("pair", "n").alias("z")).select(F.explode("z").alias("z")).groupBy(F.col("z.pair").alias("pair")).agg(F.sum("z.n").alias("count"))
