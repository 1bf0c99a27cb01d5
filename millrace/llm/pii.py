"""Personal data: anchors by Aho-Corasick, boundaries by local parsers.

One automaton pass over a text finds at-signs, plus-signs, digits, schemes and
identifier cues; around each anchor a small deterministic parser expands the
span and validates it. Nothing is shuffled: texts are scanned where they are
read, batch by batch.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, trimmed

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "account", "credential_url", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GAP = r"[ \t]{0,3}(?:number|no\.?|nr\.?|#)?[ \t]{0,3}[:=#]?[ \t]{0,3}"
_IBAN = re.compile(_GAP + r"([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
_SSN = re.compile(_GAP + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(_GAP + r"([0-9]{6,17})(?![0-9])")
_USERINFO = re.compile(r"[^\s/@:]+:[^\s/]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
#: After a cue of a secret: the rest of its name, a separator, perhaps a quote; then comes the value.
_ASSIGNED = re.compile(r"[A-Za-z0-9_-]{0,20}[\"']?(?:[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}|[ \t]{1,3}(?:is|was)[ \t]{1,3})[\"'`]?(?=[^\s\"'`,;<>()\[\]{}]{6})")
_VALUE = re.compile(r"[^\s\"'`,;<>()\[\]{}]+")
_TOKEN_PART = re.compile(r"[A-Za-z0-9_-]+")
_TOKEN_REST = re.compile(r"(?:\.[A-Za-z0-9_-]{5,}){2}")
_BEARER = re.compile(r"[ \t]{1,3}([A-Za-z0-9._~+/-]{16,}=*)")

# Lengths of account numbers by country, as published for ISO 13616.
_IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
    "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}

_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}
_SECRET_CUES = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api key", "api_key", "api-key", "access_key", "access-key", "private_key", "private-key", "credential")
# Published prefixes of access keys and what follows them.
_KEY_PREFIXES = {p: re.compile(follows) for p, follows in (
    ("AKIA", "[0-9A-Z]{16}"), ("ASIA", "[0-9A-Z]{16}"), ("ghp_", "[A-Za-z0-9]{36,}"), ("gho_", "[A-Za-z0-9]{36,}"), ("ghs_", "[A-Za-z0-9]{36,}"), ("github_pat_", "[A-Za-z0-9_]{22,}"),
    ("glpat-", "[A-Za-z0-9_-]{20,}"), ("xoxb-", "[A-Za-z0-9-]{10,}"), ("xoxp-", "[A-Za-z0-9-]{10,}"), ("sk_live_", "[A-Za-z0-9]{16,}"), ("sk-", "[A-Za-z0-9_-]{20,}"), ("sk_test_", "[A-Za-z0-9]{16,}"), ("AIza", "[0-9A-Za-z_-]{35}"))}

_AUTOMATON: ahocorasick.Automaton | None = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for d in string.digits:
            a.add_word(d, "digit")
        a.add_word("@", "email")
        a.add_word("+", "phone")
        a.add_word("://", "credential_url")
        for cue, kind in _CUES.items():
            a.add_word(cue, kind)
        for cue in _SECRET_CUES:
            a.add_word(cue, "secret")
        a.add_word("bearer", "bearer")
        a.add_word("eyj", "web token")
        a.add_word("private key-----", "private key")
        for prefix in _KEY_PREFIXES:
            a.add_word(prefix.lower(), prefix)
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_end(text: str, start: int, stop: int) -> int:
    """End of the account number that starts there, by its country's length; 0 if it is none."""
    size, at, code = _IBAN_LENGTHS.get(text[start:start + 2].upper(), 0), start, ""
    while at < stop and len(code) < size:
        code += text[at].strip()
        at += 1
    if not size or len(code) < size or text[at:at + 1].isalnum() and text[at].isascii():
        return 0
    return at if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else 0


class _Value:
    """The unbroken run from a place on, as the value of a secret: what is asked
    of it is found once, and holds for every later start within the run."""

    def __init__(self, text: str, start: int):
        self.end = _VALUE.match(text, start).end()
        self.stop = start + len(text[start:self.end].rstrip(".:?"))

        def last(good) -> int:
            return next((i for i in range(self.stop - 1, start - 1, -1) if good(text[i])), -1)

        self.digit, self.letter, self.other = last(str.isdigit), last(str.isalpha), last(lambda c: not c.isalpha())

    def ok(self, start: int, cue: str) -> bool:
        """Whether the value from ``start`` is a secret: a password of any make
        but a plain word, else long, with letters and digits."""
        if cue.startswith("pass"):
            return self.stop - start >= 6 and self.other >= start
        return self.stop - start >= 16 and self.digit >= start and self.letter >= start


def _lowered(text: str) -> str:
    """The text in lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind, each list by start.

    The four base kinds give exactly the leftmost non-overlapping matches of
    their patterns, less those that fail validation; the others are extra. Cues
    count in any letter case. Secrets are what a cue (``password``, ``token``,
    ``api_key`` and so on) is set to, what follows ``bearer``, access keys with a
    known prefix, signed web tokens and private keys in text form. Time is in
    proportion to the text's length: no stretch is read anew for each cue in it.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = phone_end = token_end = pem_end = 0
    value: _Value | None = None
    low = _lowered(text)

    def add(kind: str, start: int, end: int) -> None:
        if not out[kind] or start >= out[kind][-1][1]:
            out[kind].append((start, end))

    def free(start: int) -> bool:
        """Whether no secret found so far reaches there."""
        return not out["secret"] or start >= out["secret"][-1][1]

    for at, kind in _automaton().iter(low):
        if kind == "digit":
            if at >= card_end:
                if m := _CARD.match(text, at):
                    card_end = m.end()
                    if card_end - at >= 16:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and _luhn(digits):
                            out["card"].append(m.span())
                else:
                    card_end = at + 1
            if at >= ip_end:
                if m := _IP.match(text, at):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        out["ip"].append(m.span())
                else:  # every start within this run of digits fails alike
                    ip_end = _RUN.match(text, at).end()
        elif kind == "email":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out["email"].append((start, email_end))
        elif kind == "phone":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    out["phone"].append(m.span())
        elif kind == "credential_url":
            start = at - 2
            while start > 0 and text[start - 1] in _SCHEME:
                start -= 1
            if start < at - 2 and (m := _USERINFO.match(text, at + 1)):
                out[kind].append((start, m.end()))
        elif kind == "secret":
            cue = next(c for c in _SECRET_CUES if low.endswith(c, max(0, at + 1 - len(c)), at + 1))
            if not low[max(0, at - len(cue)):at + 1 - len(cue)].isalpha() and (m := _ASSIGNED.match(text, at + 1)) and free(m.end()):
                if value is None or m.end() >= value.end:
                    value = _Value(text, m.end())
                if value.ok(m.end(), cue):
                    out["secret"].append((m.end(), value.stop))
        elif kind == "bearer":
            if (m := _BEARER.match(text, at + 1)) and free(m.start(1)) and _Value(text, m.start(1)).ok(m.start(1), "bearer"):
                out["secret"].append((m.start(1), m.start(1) + len(m[1].rstrip("."))))
        elif kind == "web token":
            start = at - 2
            if start >= token_end and text.startswith("eyJ", start) and not text[max(0, start - 1):start].isalnum() and free(start):
                token_end = _TOKEN_PART.match(text, start).end()  # every start within this part fails alike
                if m := _TOKEN_REST.match(text, token_end):
                    out["secret"].append((start, m.end()))
        elif kind == "private key":
            start = text.rfind("-----BEGIN ", max(0, at - 60), at)
            if start >= 0 and free(start) and pem_end >= 0:
                pem_end = text.find("-----END ", at)
                if pem_end >= 0:
                    stop = text.find("-----", pem_end + 9, pem_end + 69)
                    out["secret"].append((start, stop + 5 if stop >= 0 else pem_end + 8))
        elif kind in _KEY_PREFIXES:
            start = at + 1 - len(kind)
            if text.startswith(kind, start) and not text[max(0, start - 1):start].isalnum() and free(start) and (m := _KEY_PREFIXES[kind].match(text, at + 1)):
                out["secret"].append((start, m.end()))
        else:
            m = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[kind].match(text, at + 1)
            if not m:
                continue
            end = _iban_end(text, m.start(1), m.end(1)) if kind == "iban" else m.end(1)
            if kind == "ssn" and (m[1][:3] in ("000", "666") or m[1][0] == "9" or m[1][4:6] == "00" or m[1][7:] == "0000"):
                continue
            if end:
                add(kind, m.start(1), end)
    return out


def _joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]] | None = None) -> str:
    """The text with each span replaced by its kind, as in ``<EMAIL>``.

    Overlapping spans become one placeholder, named after the leftmost
    (longest if tied).
    """
    spans = find_spans(text) if spans is None else spans
    every = sorted(((s, -e, k) for k, v in spans.items() for s, e in v))
    parts, last, i = [], 0, 0
    while i < len(every):
        start, end, kind = every[i][0], -every[i][1], every[i][2]
        i += 1
        while i < len(every) and every[i][0] < end:
            end = max(end, -every[i][1])
            i += 1
        parts += [text[last:start], f"<{kind.upper()}>"]
        last = end
    return "".join([*parts, text[last:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts and spans of personal data.

    Columns: the id, ``n_email n_ip n_card n_phone`` (long), ``base_sha256``
    (of the base spans as ``kind:start:end``, comma-joined), ``spans`` (all
    spans, base first) and ``n_extra``. A null text counts as empty: counts 0,
    the hash of the empty string. A null id stays null; repeated rows are
    repeated; other columns of the input, whatever their names, are ignored.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_extra", T.LongType()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            sums, joined, extra = [], [], []
            for text in b.column(1):
                found = find_spans(text.as_py() or "")
                for n, k in zip(counts, BASE_KINDS, strict=True):
                    n.append(len(found[k]))
                base = _joined(found, BASE_KINDS)
                more = _joined(found, EXTRA_KINDS)
                sums.append(hashlib.sha256(base.encode()).hexdigest())
                joined.append(f"{base},{more}" if base and more else base or more)
                extra.append(sum(len(found[k]) for k in EXTRA_KINDS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(sums, pa.string()),
                 pa.array(joined, pa.string()), pa.array(extra, pa.int64())],
                names=schema.names)

    return docs.select(docs[id_col], docs[text_col].cast("string").alias("__text")).mapInArrow(scan, schema)


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The input with personal data in ``text_col`` replaced by placeholders.

    All columns keep their names, types and order; ``length_col``, if the
    input has it, becomes the new length in code points. Null texts stay null
    (their length is left alone), empty ones empty; every row is kept.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [None if x is None else redact(x) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.column(at).type)
            if length is not None:
                old = b.column(length).to_pylist()
                cols[length] = pa.array([o if t is None else len(t) for t, o in zip(texts, old, strict=True)], b.column(length).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(trimmed(scan), docs.schema)
