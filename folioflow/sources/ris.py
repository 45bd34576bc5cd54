"""RIS: tagged lines between TY and ER, mapped to publication records."""

from __future__ import annotations

import re
from collections.abc import Iterator

_LINE = re.compile(r"^\s*([A-Z][A-Z0-9]{1,2})\s+-(?:\s(.*))?$")
#: A line that starts a record.
RECORD_LINE = re.compile(r"\s*TY\s+-(?:\s|$)")
#: Record types by reference type. Fixed values.
TYPES = {"JOUR": "ARTICLE", "ABST": "ARTICLE", "MGZN": "ARTICLE", "NEWS": "ARTICLE", "JFULL": "ARTICLE", "INPR": "ARTICLE", "BOOK": "BOOK", "CHAP": "INBOOK", "CONF": "INPROCEEDINGS", "CPAPER": "INPROCEEDINGS", "THES": "PHDTHESIS", "RPRT": "TECHREPORT", "UNPB": "UNPUBLISHED"}
#: Tags with one value, in the order in which they count for a field.
SINGLE = {"title": ("TI", "T1"), "journal": ("JO", "JF", "JA"), "volume": ("VL",), "issue": ("IS",), "abstract": ("N2", "AB"), "url": ("UR",), "doi": ("DO", "DOI", "M3"), "publisher": ("PB",), "address": ("CY",), "series": ("T3",), "note": ("N1",)}
_DOI = re.compile(r"10\.\d{4,}/\S+")


def charset(data: bytes) -> str:
    """UTF-8 where the bytes are valid, else Latin-1."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return "iso-8859-1"
    return "utf-8"


def _lines(text: str) -> Iterator[str]:
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def parse_tags(text: str) -> list[dict[str, list[str]]]:
    """The tags of each record with their values in order; a line without a tag continues the one before."""
    return list(_tagged(text))


def _tagged(text: str) -> Iterator[dict[str, list[str]]]:
    """As ``parse_tags``, one record at a time."""
    now: dict[str, list[str]] | None = None
    last: list[str] | None = None
    for line in _lines(text.replace("\r\n", "\n").replace("\r", "\n")):
        m = _LINE.match(line)
        if m and m[1] in ("TY", "ER") and now is not None:
            yield now
            now = last = None
        if m and m[1] == "TY":
            now = {}
        if now is None:
            continue
        if m:
            last = now.setdefault(m[1], [])
            last.append((m[2] or "").strip())
        elif last and line.strip():
            last[-1] += line.strip()
    if now is not None:
        yield now


def to_record(tags: dict[str, list[str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    first = lambda *names: next((tags[n][0] for n in names if tags.get(n) and tags[n][0]), None)
    kind = first("TY") or ""
    out["pubtype"] = TYPES.get(kind, "MISC")
    for field, names in SINGLE.items():
        if value := first(*names):
            out[field] = value
    if "doi" in out:
        if m := _DOI.search(out["doi"]):
            out["doi"] = m[0]
        else:
            del out["doi"]
    if out.get("note") == out.get("doi"):
        out.pop("note", None)
    for field, names in (("authors", ("AU", "A1")), ("editors", ("A2", "ED"))):
        if people := [p for n in names for p in tags.get(n, ()) if p]:
            out[field] = " and ".join(people)
    if words := [w for w in tags.get("KW", ()) if w]:
        out["keywords"] = ";".join(words)
    if pages := "-".join(p for p in (first("SP"), first("EP")) if p):
        out["pages"] = pages
    for field, value in zip(("year", "month", "day"), (first("PY", "Y1") or "").split("/"), strict=False):
        if value.strip():
            out[field] = value.strip()
    if number := first("SN"):
        out["isbn" if out["pubtype"] in ("BOOK", "INBOOK") else "issn"] = number
    if other := first("T2"):
        if out["pubtype"] == "INBOOK":
            out["title"] = " - ".join(x for x in (out.get("title"), other) if x)
        out["booktitle"] = other
    return out


def read_ris(text: str) -> list[dict[str, str]]:
    return list(ris_records(text))


def ris_records(text: str) -> Iterator[dict[str, str]]:
    """As ``read_ris``, one record at a time."""
    return (to_record(t) for t in _tagged(text))


def read_ris_bytes(data: bytes) -> list[dict[str, str]]:
    return list(ris_byte_records(data))


def ris_byte_records(data: bytes) -> Iterator[dict[str, str]]:
    return ris_records(data.decode(charset(data)))
