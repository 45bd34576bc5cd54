"""Key patterns such as ``[Firstauthor][YYYY]``, compiled on the driver into one column expression.

A keyword's case chooses lower, leading or upper case; a number after it limits the items (authors or
words), a number after a colon the characters of each. Items are joined by an underscore; authors left
out become "_et_al".
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\[(firstauthor|lastauthor|authors|title|journal|YYYY|YY|\w+?)(\d*)(?::(\d+))?\]", re.IGNORECASE)


def _cased(items: Column, keyword: str) -> Column:
    if keyword.isupper():
        return F.transform(items, F.upper)
    if keyword[0].isupper():
        return F.transform(items, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    return F.transform(items, F.lower)


def _cut(items: Column, chars: str | None) -> Column:
    return F.transform(items, lambda x: F.substring(x, 1, int(chars))) if chars else items


def format_pattern(pattern: str, last_names: Column, title: Column, year: Column, journal: Column, custom: dict[str, Column] | None = None) -> Column:
    """The pattern filled in. last_names: array of the authors' last names."""
    clean = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}-]", "")), lambda x: x != "")
    authors = clean(last_names)
    words = clean(F.split(title, r"\s+"))
    parts, at = [], 0
    for m in _TOKEN.finditer(pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        word, number, chars = m[1], m[2], m[3]
        kind = word.lower()
        if custom and kind in custom:
            parts.append(custom[kind])
        elif kind == "firstauthor":
            parts.append(F.array_join(_cut(_cased(F.slice(authors, 1, 1), word), chars), "_"))
        elif kind == "lastauthor":
            parts.append(F.array_join(_cut(_cased(F.slice(authors, F.greatest(F.size(authors), F.lit(1)), F.lit(1)), word), chars), "_"))
        elif kind == "authors":
            some = F.slice(authors, 1, int(number)) if number else authors
            text = F.array_join(_cut(_cased(some, word), chars), "_")
            if number:
                text = F.concat(text, F.when(F.size(authors) > int(number), F.lit("_et_al")).otherwise(F.lit("")))
            parts.append(text)
        elif kind == "title":
            some = F.slice(words, 1, int(number)) if number else words
            text = some if word[0].isupper() and not word.isupper() else _cased(some, word)
            parts.append(F.array_join(_cut(text, chars), "_"))
        elif kind == "yyyy":
            parts.append(year)
        elif kind == "yy":
            parts.append(F.right(year, F.lit(2)))
        elif kind == "journal":
            parts.append(F.array_join(clean(F.split(journal, r"\s+")), "_"))
        else:
            parts.append(F.lit(m[0]))
    parts.append(F.lit(pattern[at:]))
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
