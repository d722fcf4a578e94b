"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

The base kinds (email, ip, card, phone) are leftmost, non-overlapping matches per kind; a match that fails its check is dropped and not
tried again at another place. Base spans are always reported. The other kinds (iban, ssn, phone_local) are reported when their checks
hold and their score, with the context words around them, reaches ``threshold``.

All patterns run in linear time: runs are taken whole with possessive quantifiers, so a long run of digits or letters is read once.

Defined cases: a null text counts as empty and has no spans; repeated rows get equal results; an empty table gives an empty result;
spans are in code points, the end excluded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty

THRESHOLD = 0.6
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "phone_local")

# Each run of address characters is taken whole; it is a match if a domain follows. What follows a match is looked at anew.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")

# Lengths of account numbers by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18,
    "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
# Score of a confirmed match, what a context word adds, and the context words of each kind.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "phone_local": 0.4}
CONTEXT_GAIN = 0.3
CONTEXT = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "client"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "payment", "pay"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "compte"},
    "ssn": {"ssn", "social", "security"},
    "phone_local": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell"},
}
BEFORE, AFTER = 48, 24


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod_97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _small(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def _iban_end(text: str, start: int, limit: int) -> int | None:
    length = IBAN_LENGTH.get(text[start:start + 2])
    seen = 0
    for at in range(start, limit):
        seen += text[at] != " "
        if seen == length:
            whole = at + 1 == len(text) or not text[at + 1].isalnum()
            return at + 1 if whole and mod_97(text[start:at + 1].replace(" ", "")) else None
    return None


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed matches (kind, start, end), kinds in the order of KINDS."""
    if "@" in text:
        yield from (("email", *m.span()) for m in _EMAIL.finditer(text) if m[1])
    if not _DIGIT.search(text):
        return
    if text.count(".") >= 3:
        yield from (("ip", *m.span()) for m in _IP.finditer(text) if m[1] and all(map(_small, m[0].split("."))))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield ("card", *m.span())
    if "+" in text:
        yield from (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15)
    for m in _IBAN.finditer(text):
        end = _iban_end(text, *m.span())
        if end:
            yield ("iban", m.start(), end)
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield ("ssn", *m.span())
    yield from (("phone_local", *m.span()) for m in _LOCAL.finditer(text))


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    spans = []
    for kind, start, end in candidates(text):
        score = SCORES[kind]
        near = text[max(0, start - BEFORE):start] + " " + text[end:end + AFTER]
        if not CONTEXT[kind].isdisjoint(_WORD.findall(near.lower())):
            score = min(1.0, score + CONTEXT_GAIN)
        if kind in BASE or score >= threshold:
            spans.append(Span(kind, start, end, score))
    return spans


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end and score, by kind as in KINDS, then start."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    of_span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[s._asdict() for s in find(x, threshold)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(of_span))], ["doc_id", "spans"])

    return rows.mapInArrow(step, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
