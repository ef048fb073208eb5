"""Personal data: patterns propose, checksums confirm, context scores.

Patterns per kind run left to right without overlap; a proposal that fails its
validator (number ranges, Luhn, mod-97) is dropped, never retried shorter.  Words near a span
raise its score.  The base kinds (email, ip, card, phone) are always reported;
the kinds added by the method (iban, ssn) need a score of ``THRESHOLD``.

Defined results: null text is the empty text and has no spans; offsets count
code points, end exclusive; spans are ordered by start, then kind as listed;
repeated rows and null ids are treated row by row; extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, str_list

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.75
_BATCH_BYTES = 8 << 20
#: Code points on either side that count as nearby.
NEARBY = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")

# Lengths of international bank account numbers by country, all countries of the published registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: kind -> (score of a confirmed proposal, words that raise it).
CONTEXT = {
    "email": (0.9, frozenset(("mail", "email", "contact", "correo", "courriel"))),
    "ip": (0.6, frozenset(("ip", "address", "host", "server", "client"))),
    "card": (0.7, frozenset(("card", "credit", "visa", "mastercard", "tarjeta", "carte", "karte"))),
    "phone": (0.7, frozenset(("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"))),
    "iban": (0.8, frozenset(("iban", "bank", "account", "konto", "compte", "cuenta"))),
    "ssn": (0.4, frozenset(("ssn", "social", "security"))),
}
_BOOST = 0.4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 mod 97-10 as used by international account numbers."""
    rest = 0
    for c in account[4:] + account[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Same matches as one scan with local part, @ and dotted domain.

    The local part never holds an @, so it is the run that ends at one; going
    from @ to @ keeps the scan linear in any text.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        want = IBAN_LENGTHS.get(m[0][:2])
        if not want:
            continue
        got, i = m[0], m.end()
        while len(got) < want and i < len(text):
            c = text[i]
            if c == " " and text[i - 1] != " ":
                i += 1
                continue
            if not (c.isascii() and (c.isdigit() or c.isupper())):
                break
            got += c
            i += 1
        follows = i < len(text) and text[i].isascii() and text[i].isalnum()
        if len(got) == want and not follows and mod97(got):
            yield m.start(), i


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def score(text: str, kind: str, start: int, end: int) -> float:
    """Score of a confirmed span, raised by context words nearby."""
    base, words = CONTEXT[kind]
    near = text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]
    return min(1.0, base + _BOOST) if any(w.lower() in words for w in _WORD.findall(near)) else base


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed."""
    out = []
    for rank, kind in enumerate(KINDS):
        for start, end in _FIND[kind](text):
            s = score(text, kind, start, end)
            if kind in BASE_KINDS or s >= THRESHOLD:
                out.append((start, rank, kind, end, s))
    out.sort()
    return [(kind, start, end, s) for start, _, kind, end, s in out]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Text with every span replaced by its kind in brackets.

    Overlapping spans become one, named after the first.
    """
    out, done, i = [], 0, 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("score", T.DoubleType(), False)]
    ),
    False,
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _map(docs: DataFrame, text: str, out: str, kind: T.DataType, arrow: pa.DataType, f) -> DataFrame:
    kept = [x for x in docs.schema.fields if x.name != out or out == text]
    names = [x.name for x in kept] + ([] if out == text else [out])
    schema = T.StructType(kept if out == text else [*kept, T.StructField(out, kind, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in chunks(big, text, _BATCH_BYTES):
                col = pa.array(f(b.column(text)), arrow)
                yield pa.RecordBatch.from_arrays([col if n == out else b.column(n) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def detect(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, score)."""

    def f(col: pa.Array) -> list:
        names = ("kind", "start", "end", "score")
        return [[dict(zip(names, s, strict=True)) for s in find_spans(t)] for t in str_list(col)]

    return _map(docs, text, out, _SPANS, _ARROW_SPANS, f)


def redact_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced; null stays null."""

    def f(col: pa.Array) -> list:
        return [None if t is None else (redact(t, s) if (s := find_spans(t)) else t) for t in col.to_pylist()]

    return _map(docs, text, text, T.StringType(), pa.string(), f)
