"""Personal names: split into first, von, last and junior parts, and rendered.

The grammar has no built-in counterpart, so splitting runs in an Arrow-batched function; everything
that follows from the parts is a column expression.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = T.StructType([T.StructField(c, T.StringType()) for c in ("first", "von", "last", "jr")])


def _words(text: str) -> list[str]:
    """Words at blanks outside braces."""
    out, word, depth = [], "", 0
    for ch in text:
        depth += (ch == "{") - (ch == "}")
        if ch.isspace() and depth <= 0:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word] if word else out


def _commas(text: str) -> list[str]:
    out, part, depth = [], "", 0
    for ch in text:
        depth += (ch == "{") - (ch == "}")
        if ch == "," and depth <= 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [p.strip() for p in [*out, part]]


def _lower(word: str) -> bool:
    """Whether a word belongs to the von part: its first letter outside braces is lower-case."""
    for ch in re.sub(r"\\.|\{[^{}]*\}", "", word):
        if ch.isalpha():
            return ch.islower()
    return False


def _von_last(words: list[str]) -> tuple[list[str], list[str]]:
    """All up to the last lower-case word is the von part; one word at least is the last name."""
    cut = max((k + 1 for k, w in enumerate(words[:-1]) if _lower(w)), default=0)
    return words[:cut], words[cut:]


def split_name(name: str | None, keep_braces: bool = False) -> tuple[str | None, str | None, str | None, str | None]:
    """(first, von, last, jr) of ``von Last, Jr, First``, ``von Last, First`` or ``First von Last``."""
    text = (name or "").strip()
    if not text:
        return None, None, None, None
    if text[0] == "{" and text[-1] == "}" and text.find("}") == len(text) - 1:
        return None, None, text if keep_braces else text[1:-1], None
    parts = _commas(text)
    join = lambda words: " ".join(words) or None
    if len(parts) == 1:
        words = _words(text)
        low = [k for k, w in enumerate(words[:-1]) if _lower(w)]
        if not low:
            if len(words) > 1 and _lower(words[-1]):  # all that is said of such a name is one last name
                return None, None, join(words), None
            return join(words[:-1]), None, words[-1], None
        if low == list(range(len(words) - 1)) and _lower(words[-1]):
            return None, None, join(words), None
        end = low[0]
        while end + 1 < len(words) - 1 and _lower(words[end + 1]):
            end += 1
        return join(words[: low[0]]), join(words[low[0] : end + 1]), join(words[end + 1 :]), None
    von, last = _von_last(_words(parts[0]))
    jr = parts[1] or None if len(parts) > 2 else None
    first = ", ".join(parts[2:]) if len(parts) > 2 else parts[1]
    return first or None, join(von), join(last), jr


@F.pandas_udf(PARTS)
def name_parts(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_name(n) for n in names], columns=["first", "von", "last", "jr"])


@F.pandas_udf(T.ArrayType(PARTS))
def authors_parts(authors: pd.Series) -> pd.Series:
    """The parts of every name of an author string."""
    keys = ("first", "von", "last", "jr")
    return pd.Series([None if a is None else [dict(zip(keys, split_name(n), strict=True)) for n in split_authors(a)] for a in authors])


def split_authors(text: str) -> list[str]:
    """Names at the word "and" outside braces."""
    out, words = [], []
    for w in _words(text):
        if w.lower() == "and":
            out.append(" ".join(words))
            words = []
        else:
            words.append(w)
    return [n for n in [*out, " ".join(words)] if n]


def initials(first: Column) -> Column:
    """First letters of given names; a short run of capitals counts letter by letter."""
    words = F.filter(F.split(F.coalesce(first, F.lit("")), r"[\s.]+"), lambda w: w != "")
    letters = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}{2,3}$"), w).otherwise(F.substring(w, 1, 1)))
    return F.array_join(letters, "")


def author_key(last: Column, first: Column) -> Column:
    return F.upper(F.concat_ws("_", last, F.nullif(initials(first), F.lit(""))))


def nice_name(von: Column, last: Column, first: Column) -> Column:
    return F.concat_ws(" ", von, last, F.nullif(initials(first), F.lit("")))


def normalized_name(von: Column, last: Column, first: Column) -> Column:
    return F.concat_ws(", ", F.concat_ws(" ", von, last), F.nullif(initials(first), F.lit("")))


def bibtex_name(von: Column, last: Column, jr: Column, first: Column) -> Column:
    return F.concat_ws(", ", F.concat_ws(" ", von, last), jr, first)


def bibutils_name(last: Column, first: Column) -> Column:
    """last|first|middle, given names at blanks."""
    return F.concat_ws("|", last, F.array_join(F.split(F.trim(first), r"\s+"), "|"))


def from_bibutils(c: Column) -> Column:
    """``Last, Given names`` from last|first|middle."""
    parts = F.split(c, r"\|")
    return F.concat_ws(", ", F.get(parts, 0), F.nullif(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " "), F.lit("")))


def freestyle_bibtex(name: str | None) -> str | None:
    """A name written in any usual way as ``von Last, Jr, First``."""
    first, von, last, jr = split_name(name, keep_braces=True)
    if last is None:
        return None
    return ", ".join(x for x in (" ".join(y for y in (von, last) if y), jr, first) if x)
