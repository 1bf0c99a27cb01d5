"""Exact tokenization of whole texts, with per-worker caches of pieces.

Texts are cut by array operations where the tokenizer's own pre-tokenizer cuts
them, the distinct pieces of a batch are looked up once, and the library's BPE
model is asked for those not seen before. Chunks with anything but ASCII and
Latin-1 letters, digits and punctuation, or with an apostrophe before a letter,
go to the tokenizers library as they are, so ids equal the library's on the
whole text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

#: Entries at which a worker's cache of pieces starts a new generation, keeping
#: the one before; bounds memory only.
MAX_CACHED = 120_000
#: Bytes of text that are cut and looked up at once; bounds memory only.
BATCH_BYTES = 1_500_000

_SPACE, _LETTER, _DIGIT, _PUNCT, _OTHER, _END = range(6)
_END_BYTE = 0xFF  # occurs in no UTF-8 text


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        out[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _PUNCT
    out[list(b" \t\n\r\x0b\x0c")] = _SPACE
    out[_END_BYTE] = _END
    return out


_CLASS = _classes()
#: Masks that keep the first n of 8 little-endian bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LONG = 24


def _byte_alphabet() -> dict[int, int]:
    """Byte to code point, as byte-level vocabularies print them: visible
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = b
        else:
            out[b] = 256 + extra
            extra += 1
    return out


_ALPHABET = _byte_alphabet()


class Encoder:
    """Ids of texts under a tokenizer given as the JSON of the tokenizers library.

    Special tokens are never added, and their strings in a text are ordinary
    text. ``dtype`` is the smallest unsigned type that holds every id.
    """

    def __init__(self, spec: str):
        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        j = json.loads(spec)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"
        pre = j.get("pre_tokenizer") or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre] if pre else [])]
        norm = [n["type"] for n in (j.get("normalizer") or {}).get("normalizers", [])]
        plain = j["model"]["type"] == "BPE" and not j["model"].get("dropout") and not j["model"].get("ignore_merges")
        self.kind = "other"
        if plain and kinds == ["ByteLevel"] and not j.get("normalizer") and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
        elif plain and kinds == ["Split", "ByteLevel"] and norm == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0]["behavior"] == "Removed":
            self.kind = "word"
        self.model = self.tok.model
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.whole: dict[bytes, bytes | None] = {}

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretokens(self, raw: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, already normalised."""
        found = list(map(self.pieces.get, raw))
        absent = [i for i, x in enumerate(found) if x is None]
        if not absent:
            return found
        if len(self.pieces) >= MAX_CACHED:
            self.older, self.pieces = self.pieces, {}
        names = [raw[i] for i in absent]
        got = list(map(self.older.get, names))
        fresh = [i for i, x in enumerate(got) if x is None]
        shown = [n.decode("latin-1") if n.isalpha() else n.decode("latin-1").translate(_ALPHABET) for n in (names[i] for i in fresh)]
        code = self.code
        for i, tokens in zip(fresh, map(self.model.tokenize, shown), strict=True):
            got[i] = array(code, [t.id for t in tokens]).tobytes()
        self.pieces.update(zip(names, got, strict=True))
        for i, x in zip(absent, got, strict=True):
            found[i] = x
        return found

    def _chunk(self, raw: bytes) -> bytes | None:
        """Ids of a chunk between white space that the library has to cut; None
        if white space of other kinds at its edge may join what is beside it."""
        if raw not in self.whole:
            if len(self.whole) >= MAX_CACHED // 4:
                self.whole.clear()
            text = raw.decode()
            inner = text.removeprefix(" ") or " "
            edge = self.kind == "byte" and (inner[0].isspace() or inner[-1].isspace())
            self.whole[raw] = None if edge else self._library(text)
        return self.whole[raw]

    def _cut(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, and whether the library has to cut them."""
        n = len(b)
        c = _CLASS[b]
        if (high := np.flatnonzero((b >= 0x80) & (b != _END_BYTE))).size:
            lead = high[b[high] == 0xC3]
            good = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
            c[good] = _LETTER
            c[good + 1] = _LETTER
        quote = np.flatnonzero(b == 39)
        after = c[quote + 1]
        c[quote[(after == _LETTER) | (after == _OTHER)]] = _OTHER
        solid = (c != _SPACE) & (c != _END)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        start = np.empty(n, bool)
        start[0] = solid[0]
        np.not_equal(c[1:], c[:-1], out=start[1:])
        start &= solid
        if self.kind == "word":
            start |= c == _DIGIT
        odd = np.zeros(0, np.int64)
        if (others := np.flatnonzero(c == _OTHER)).size:
            begins = np.flatnonzero(first)
            last = solid.copy()
            last[:-1] &= ~solid[1:]
            ends = np.flatnonzero(last) + 1
            which = np.unique(np.searchsorted(begins, others, "right") - 1)
            odd = begins[which]
            for s, e in zip(odd.tolist(), ends[which].tolist(), strict=True):
                start[s + 1:e] = False
        stop = np.zeros(n, bool)
        stop[:-1] = solid[:-1] & (start[1:] | ~solid[1:])
        ps, pe = np.flatnonzero(start), np.flatnonzero(stop) + 1
        strange = np.zeros(len(ps), bool)
        strange[np.searchsorted(ps, odd)] = True
        if self.kind == "byte":
            joined = first[ps] & (b[ps - 1] == 32)
            joined[:1] &= ps[:1] > 0
            ps = ps - joined
            blank = c == _SPACE
            edge = np.flatnonzero(np.diff(np.concatenate(([0], blank.view(np.int8), [0]))))
            s, e = edge[::2], edge[1::2]
            final = c[e] == _END
            spaced = b[e - 1] == 32
            most = np.where(final, e, e - 1)
            alone = ~final & ~spaced
            xs = np.concatenate((s[most > s], (e - 1)[alone]))
            xe = np.concatenate((most[most > s], e[alone]))
            if xs.size:
                ps, pe = np.concatenate((ps, xs)), np.concatenate((pe, xe))
                strange = np.concatenate((strange, np.zeros(len(xs), bool)))
                order = np.argsort(ps, kind="stable")
                ps, pe, strange = ps[order], pe[order], strange[order]
        return ps, pe, strange

    def _lower(self, b: np.ndarray) -> np.ndarray:
        out = b.copy()
        out[(b >= 65) & (b <= 90)] += 32
        lead = np.flatnonzero(b == 0xC3)
        up = lead[(b[lead + 1] >= 0x80) & (b[lead + 1] <= 0x9E) & (b[lead + 1] != 0x97)]
        out[up + 1] += 32
        return out

    def _batch(self, texts: list[bytes]) -> list[np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = bytes([_END_BYTE]).join(texts) + bytes([_END_BYTE])
        padded = np.frombuffer(raw + bytes(_LONG + 8), np.uint8)
        b = padded[:len(raw)]
        ps, pe, strange = self._cut(b)
        if not len(ps):
            return [np.zeros(0, self.dtype) for _ in texts]
        if self.kind == "word":
            padded = np.concatenate((self._lower(b), np.zeros(_LONG + 8, np.uint8)))
        size = pe - ps
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        keys = [eight[ps + k] & _KEEP[np.clip(size - k, 0, 8)] for k in (0, 8, 16)]
        text = padded.tobytes()
        special = np.flatnonzero(strange | (size > _LONG))
        own: dict[tuple[bool, bytes], int] = {}
        for i in special.tolist():
            s, e = int(ps[i]), int(pe[i])
            key = (bool(strange[i]), raw[s:e] if strange[i] else text[s:e])
            keys[0][i] = own.setdefault(key, len(own))
        keys[1][special] = keys[2][special] = 0
        size[special] = _LONG + 1
        h = keys[0] * _MIX[0]
        h ^= h >> np.uint64(32)
        h = (h + keys[1]) * _MIX[1]
        h ^= h >> np.uint64(29)
        h = (h + keys[2]) * _MIX[2]
        h ^= h >> np.uint64(32)
        h += size.astype(np.uint64) * _MIX[3]
        order = np.argsort(h)
        new = np.empty(len(h), bool)
        new[0] = True
        sorted_h = h[order]
        np.not_equal(sorted_h[1:], sorted_h[:-1], out=new[1:])
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        chosen = order[new]
        for x in (*keys, size):
            if not np.array_equal(x, x[chosen][inverse]):  # two pieces of one hash
                return [np.frombuffer(self._library(t.decode()), self.dtype) for t in texts]
        names = list(own)
        rare = size[chosen] > _LONG
        usual = np.flatnonzero(~rare)
        found: list[bytes | None] = [None] * len(chosen)
        which = chosen[usual]
        for u, x in zip(usual.tolist(), self._pretokens([text[s:e] for s, e in zip(ps[which].tolist(), pe[which].tolist(), strict=True)]), strict=True):
            found[u] = x
        for u in np.flatnonzero(rare).tolist():
            odd, piece = names[int(keys[0][int(chosen[u])])]
            found[u] = self._chunk(piece) if odd else self._pretokens([piece])[0]
        width = self.dtype.itemsize
        bad = np.zeros(len(found), bool)
        for u in np.flatnonzero(rare).tolist():
            if found[u] is None:
                bad[u], found[u] = True, b""
        counts = np.fromiter(map(len, found), np.int64, len(found)) // width
        flat = np.frombuffer(b"".join(found), self.dtype)
        offsets = np.cumsum(counts) - counts
        each = counts[inverse]
        total = np.cumsum(each)
        ids = flat[np.repeat(offsets[inverse] - (total - each), each) + np.arange(int(total[-1]))]
        at = np.searchsorted(ps, ends)
        bounds = np.concatenate(([0], total))[at]
        out = np.split(ids, bounds[:-1])
        if bad.any():
            for d in np.unique(np.searchsorted(ends, ps[bad[inverse]], "right")).tolist():
                out[d] = np.frombuffer(self._library(texts[d].decode()), self.dtype)
        return out

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Ids of each UTF-8 text (null: empty)."""
        part: list[bytes] = []
        held = 0
        for t in texts:
            part.append(t or b"")
            held += len(part[-1])
            if held >= BATCH_BYTES:
                yield from self._many(part)
                part, held = [], 0
        if part:
            yield from self._many(part)

    def _many(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.kind == "other":
            return [np.frombuffer(self._library(t.decode()), self.dtype) for t in texts]
        return self._batch(texts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The encoder of this worker for a tokenizer's JSON."""
    if spec not in _ENCODERS:
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def read_spec(path: str) -> str:
    """A tokenizer's JSON, read on the driver and shipped with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()
