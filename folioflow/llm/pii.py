"""PII spans: regular expressions propose, checksums confirm, nearby words adjust a score.

Four *base* kinds (email, ip, card, phone) are kept whenever their pattern and validator hold; their
score only grows with context. The method adds kinds whose shape alone is weak evidence: an IBAN must
pass its mod-97 check, a US social-security number and a national phone number need a context word
near by. Offsets are code points, the end is exclusive.

Nulls and empty texts have no spans; a null id stays null; repeated rows are scanned each on its own;
columns other than the named ones are ignored, so clashing names do no harm. All patterns are linear
in the text's length: no match attempt starts inside a run that has already failed, and spans are held
against the base ones by a search among these in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import fields, map_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "localphone")
#: Characters on each side of a span that are searched for context words.
WINDOW = 48
#: A span of an added kind is kept from this score on.
THRESHOLD = 0.6

SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCALPHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIGITS = re.compile(r"[0-9]")

#: Context words by kind; each is looked for as a whole word around the span, letters folded.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "cvv"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "tax"),
    "localphone": ("phone", "tel", "call", "fax", "mobile", "contact"),
}
_NEAR = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + r")(?![a-z])") for k, v in CONTEXT.items()}
#: Score of a span whose validator holds, without context; context adds 0.3.
PRIOR = {"email": 0.7, "ip": 0.65, "card": 0.7, "phone": 0.65, "iban": 0.7, "ssn": 0.4, "localphone": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", at + 1)


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 16 or m.end() - m.start() > 37:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    at = 0
    while m := _IBAN.search(text, at):
        whole = m[0]
        at = m.start() + len(whole.partition(" ")[0])  # if none is confirmed here, the next group may begin one
        while True:  # words that follow may look like another group: give them up one by one
            code = whole.replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                at = m.start() + len(whole)
                yield m.start(), at
                break
            whole, space, _ = whole.rpartition(" ")
            if not space:
                break


class _Spans:
    """Spans, merged, that can be asked whether they overlap another one."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text by kind as listed, then start: (kind, start, end, score)."""
    found = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            found += [("ip", *s) for s in _ips(text)]
        found += [("card", *s) for s in _cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in _phones(text)]
        found += [("iban", *s) for s in _ibans(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        found += [("localphone", *m.span()) for m in _LOCALPHONE.finditer(text)]
    out, base = [], _Spans((a, b) for k, a, b in found if k in BASE_KINDS)
    for kind, start, end in found:
        if kind not in BASE_KINDS and kind != "iban" and base.meets(start, end):
            continue  # part of a base span; an IBAN has its own check and holds more than the digits in it
        near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
        score = PRIOR[kind] + (0.3 if _NEAR[kind].search(near) else 0.0)
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((kind, start, end, score))
    return out


def pii_spans(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and ``spans``: array of (kind, start, end, score). A map over rows, without a shuffle."""
    schema = T.StructType([*fields(df, keys), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batch: pa.RecordBatch):
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in scan(t or "")] for t in batch.column(len(keys)).to_pylist()]
        return [*(batch.column(k) for k in range(len(keys))), spans]

    return map_arrow(df.select(*keys, F.col(text).cast("string").alias("_text")), run, schema)


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span (overlapping ones merged) replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df``, with the spans of its text column masked; a null text stays null."""
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch):
        new = [None if t is None else (masked(t, s) if (s := scan(t)) else t) for t in batch.column(at).to_pylist()]
        return [new if k == at else batch.column(k) for k in range(batch.num_columns)]

    return map_arrow(df, run, T.StructType(fields(df, df.columns)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
