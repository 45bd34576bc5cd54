"""BibTeX: a tokenizer and grammar for entries, and their mapping to publication records."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

from ..functions.names import freestyle_bibtex, split_authors

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Month macros that need no definition.
MACROS = {m[:3].lower(): m for m in MONTHS}
#: Record fields of BibTeX fields with other names.
RENAMED = {"author": "authors", "editor": "editors", "number": "number", "comment": "annote", "arxiv": "arxivid"}
#: Accents by command character, as combining marks.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
#: Letters with a command of their own.
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ"}

_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
_NAME = re.compile(r"\s*([A-Za-z][\w:.+/-]*)\s*=\s*")
_KEY = re.compile(r"\s*([^\s,{}()=]+)\s*,")
_NUMBER = re.compile(r"\d+")
_MACRO = re.compile(r"[A-Za-z_][\w:.+/-]*")
_LETTER = re.compile(r"\{?\\(" + "|".join(sorted(LETTERS, key=len, reverse=True)) + r")(?![A-Za-z])\s?(?:\{\})?\}?")
_BLANKS = re.compile(r"\s+")


#: A line that starts an entry, wherever it stands: one that was not closed ends before it.
ENTRY_LINE = re.compile(r"[ \t]*@[ \t]*[A-Za-z]+[ \t]*[{(]")
_STARTS = re.compile(r"(?m)^(?=[ \t]*@[ \t]*[A-Za-z]+[ \t]*[{(])")
_BRACKETS = re.compile(r"\\.|[{}]", re.S)
_BRACKETS_OR_ROUND = re.compile(r"\\.|[{})]", re.S)


class BadEntry(ValueError):
    pass


def _braced(text: str, at: int, close: str = "}") -> int:
    """The place behind the bracket that closes the one at ``at``."""
    depth = 0
    for m in (_BRACKETS if close == "}" else _BRACKETS_OR_ROUND).finditer(text, at + 1):
        c = m[0]
        if c == close and depth == 0:
            return m.end()
        depth += (c == "{") - (c == "}")
    raise BadEntry("no closing bracket")


def parse_value(text: str, at: int = 0, macros: dict[str, str] | None = None) -> tuple[str, int]:
    """A value (number, quoted, braced, macro, or several joined by #) and the place behind it."""
    macros, out = {} if macros is None else macros, []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            raise BadEntry("value expected")
        if text[at] == "{":
            end = _braced(text, at)
            out.append(text[at + 1 : end - 1])
        elif text[at] == '"':
            end, depth = at + 1, 0
            while end < len(text) and (text[end] != '"' or depth > 0):
                if text[end] == "\\" and depth == 0:
                    end += 1
                elif text[end] in "{}":
                    depth += 1 if text[end] == "{" else -1
                end += 1
            if end >= len(text):
                raise BadEntry("no closing quote")
            out.append(text[at + 1 : end])
            end += 1
        elif m := _NUMBER.match(text, at):
            out.append(m[0])
            end = m.end()
        elif m := _MACRO.match(text, at):
            name = m[0].lower()
            out.append(macros.get(name, MACROS.get(name, "")))
            end = m.end()
        else:
            raise BadEntry(f"unexpected {text[at]!r}")
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] == "#":
            at += 1
        else:
            return _BLANKS.sub(" ", "".join(out)).strip(), at


def parse_entries(text: str, macros: dict[str, str] | None = None) -> list[dict]:
    """Entries as ``{"_type", "_key", "_raw", "parse_ok", fields}``. An entry ends where its bracket closes, and at the
    latest before the next line that starts one; behind a bad one, parsing goes on there. macros: those defined before the text."""
    return list(_entries(text, macros))


def _entries(text: str, macros: dict[str, str] | None = None) -> Iterator[dict]:
    """The entries one after the other, a part of the text at a time."""
    macros, at = dict(macros or ()), 0
    for end in itertools.chain((m.start() for m in _STARTS.finditer(text)), [len(text)]):
        for e in _part_entries(text[at:end], macros):
            if e["_type"] != "STRING":
                yield e
        at = end


def _part_entries(text: str, macros: dict[str, str]) -> list[dict]:
    """All entries of a text with one line at most that starts some; definitions go to ``macros``."""
    out, at = [], 0
    while m := _ENTRY.search(text, at):
        kind, close = m[1].upper(), "}" if m[2] == "{" else ")"
        entry: dict = {"_type": kind, "_key": None, "parse_ok": True}
        try:
            end = _braced(text, m.end() - 1, close)
            if kind in ("COMMENT", "PREAMBLE"):
                at = end
                continue
            body, k = text[m.end() : end - 1], 0
            if kind != "STRING" and (key := _KEY.match(body)):
                entry["_key"], k = key[1], key.end()
            while name := _NAME.match(body, k):
                value, k = parse_value(body, name.end(), macros)
                if kind == "STRING":
                    macros[name[1].lower()] = value
                else:
                    entry[name[1].lower()] = value
                while k < len(body) and body[k] in ", \t\r\n":
                    k += 1
            if body[k:].strip(" \t\r\n,"):
                raise BadEntry(body[k : k + 20])
            at = end
        except BadEntry as e:
            key = _KEY.match(text, m.end())
            entry |= {"parse_ok": False, "error": str(e), "_key": key[1] if key else None}
            at = end = len(text)
        entry["_raw"] = text[m.start() : end]
        out.append(entry)
    return out


class _Asked(dict):
    """Macros that note which names are asked for."""

    def __init__(self):
        super().__init__()
        self.names: set[str] = set()

    def get(self, name, default=None):
        self.names.add(name.lower())
        return default


def used_names(text: str) -> list[str]:
    """Names of macros that a text's entries use, months aside."""
    asked = _Asked()
    for part in _STARTS.split(text):
        _part_entries(part, asked)
    return sorted(asked.names - set(MACROS))


def defined(text: str, macros: dict[str, str]) -> list[tuple[int, str, str]]:
    """The macros that a text defines, in their order: number, name, value."""
    own = _Defined(macros)
    for part in _STARTS.split(text):
        _part_entries(part, own)
    return [(k, name, value) for k, (name, value) in enumerate(own.found)]


class _Defined(dict):
    """Macros that note what is defined."""

    def __init__(self, known):
        super().__init__(known)
        self.found: list[tuple[str, str]] = []

    def __setitem__(self, name, value):
        super().__setitem__(name, value)
        self.found.append((name, value))


def defined_names(text: str) -> list[str]:
    """The names of the macros that a text defines."""
    return sorted({name for _, name, _ in defined(text, {})})


def decode_tex(text: str) -> str:
    """Accent commands and special letters as characters; an unknown lower-case accent leaves the bare letter."""
    if "\\" not in text:  # all commands begin with one
        return text

    def accent(m: re.Match) -> str:
        mark, letter = m[1], m[2] or m[3]
        letter = {"\\i": "i", "\\j": "j"}.get(letter, letter)
        if mark in ACCENTS:
            return unicodedata.normalize("NFC", letter + ACCENTS[mark])
        return letter

    text = re.sub(r'\{?\\([`\'^"=.])\s*(?:\{(\\?[A-Za-z])\}|(\\?[A-Za-z]))\}?', accent, text)
    text = re.sub(r"\{?\\~\s*(?:\{(\\?[A-Za-z])\}|(\\?[A-Za-z]))\}?", lambda m: accent_tilde(m), text)
    text = re.sub(r"\{?\\([a-zA-Z])\s*\{(\\?[A-Za-z])\}()\}?", accent, text)
    text = re.sub(r'\\uchar"([0-9A-Fa-f]+)', lambda m: chr(int(m[1], 16)), text)
    return _LETTER.sub(lambda m: LETTERS[m[1]], text)


def accent_tilde(m: re.Match) -> str:
    return unicodedata.normalize("NFC", (m[1] or m[2]) + ACCENTS["~"])


def strip_tex(text: str) -> str:
    return re.sub(r"\\[A-Za-z]+\{([^{}]*)\}", r"\1", text) if "\\" in text else text


def _names(text: str) -> str:
    """Names as ``Last, First`` joined by and; names in braces stay as they are."""
    return " and ".join(n if n.startswith("{") else (freestyle_bibtex(n) or n) for n in split_authors(text))


def to_record(entry: dict, strip: bool = True) -> dict[str, str]:
    """A publication record of a parsed entry."""
    out = {"pubtype": entry["_type"], "citekey": entry["_key"]}
    for name, value in entry.items():
        if name.startswith("_") or name in ("parse_ok", "error"):
            continue
        name = RENAMED.get(name, name)
        value = decode_tex(value)
        if strip:
            value = strip_tex(value)
        if name in ("authors", "editors"):
            value = _names(value)
        else:
            value = value.replace("{", "").replace("}", "")
        if name == "doi" and (m := re.search(r"10\.\d{4,}/\S+", value)):
            value = m[0]
        elif name == "arxivid":
            value = re.sub(r"(?i)^arxiv:\s*", "", value)
        elif name == "pages":
            value = re.sub(r"\s*-{2,}\s*", "-", value)
        elif name == "year" and (m := re.search(r"\d{4}", value)):
            value = m[0]
        elif name == "month":
            value = MACROS.get(value.lower(), value)
        out[name] = value
    return out


def read_bibtex(text: str, strip: bool = True, macros: dict[str, str] | None = None) -> list[dict[str, str]]:
    """Records of all entries that parse."""
    return list(bibtex_records(text, strip, macros))


def bibtex_records(text: str, strip: bool = True, macros: dict[str, str] | None = None) -> Iterator[dict[str, str]]:
    """As ``read_bibtex``, one record at a time."""
    return (to_record(e, strip) for e in _entries(text, macros) if e["parse_ok"])


def balanced_entry(html: str) -> str | None:
    """The first ``@ARTICLE`` entry in a page, up to its balancing brace."""
    at = html.upper().find("@ARTICLE")
    if at < 0 or (brace := html.find("{", at)) < 0:
        return None
    depth = 0
    for k in range(brace, len(html)):
        if html[k] in "{}" and html[k - 1] != "\\":
            depth += 1 if html[k] == "{" else -1
            if not depth:
                return html[at : k + 1]
    return html[at:] + "}" * depth
