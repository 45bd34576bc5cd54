"""Which format a file has, from its first lines or, for SQLite files, its table names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Non-empty lines that are looked at, and lines before each that are looked at with it.
LINES, BEFORE = 500, 5
#: Patterns of the text formats, in the order that decides when a line has several.
TEXT_PATTERNS = (("BIBTEX", r"(?i)@\w+\{"), ("RIS", r"(?i)^\s*TY\s+-\s+"), ("RSS", r"(?is)xml.*rss"))
#: Patterns of the older detection, which looks at 100 lines one by one.
LEGACY_LINES = 100
LEGACY_PATTERNS = (
    ("MODS", r"(?i)<mods"), ("MEDLINE", r"<PubmedArticle>"), ("BIBTEX", r"(?i)@\w+\{"), ("ISI", r"^\s*FN ISI"), ("ENDNOTE", r"^\s*%0 "), ("RIS", r"(?i)^\s*TY\s+-\s+"),
)
#: Tables that tell a library file's maker: all names of a group must be there.
LIBRARIES = {"ZOTERO": ("zoteroDummyTable",), "MENDELEY": ("DocumentContributors", "RunsSinceLastCleanup"), "NATIVE": ("Publications", "Fulltext")}


def _bound(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def text_format(content: Column) -> Column:
    """The format by the first line that shows one, alone or with the lines before it; null if none does."""
    lines = F.slice(F.filter(F.split(content, r"\r\n|\r|\n"), lambda x: x != ""), 1, LINES)

    def found(lines: Column) -> Column:
        def at(line: Column, k: Column) -> Column:
            first = F.greatest(k - BEFORE, F.lit(0))

            def shown(near: Column) -> Column:
                out = F.when(F.lit(False), F.lit(""))
                for name, pattern in TEXT_PATTERNS:
                    out = out.when(line.rlike(pattern) | near.rlike(pattern), F.lit(name))
                return out

            return _bound(F.array_join(F.slice(lines, first + 1, k - first + 1), ""), shown)

        # what a line shows stands in all lines together, too: most texts need no look at single lines
        some = F.array_join(lines, "").rlike(r"(?is)@\w+\{|TY\s+-\s+|xml.*rss")
        return F.when(some, F.get(F.filter(F.transform(lines, at), lambda x: x.isNotNull()), 0))

    return _bound(lines, found)


def legacy_format(content: Column) -> Column:
    """One of six formats by the first line that shows one; PAPER-like binary content has none."""
    lines = F.slice(F.split(content, r"\r\n|\r|\n"), 1, LEGACY_LINES)

    def at(line: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name, pattern in LEGACY_PATTERNS:
            out = out.when(line.rlike(pattern), F.lit(name))
        return out

    return F.get(F.filter(F.transform(lines, at), lambda x: x.isNotNull()), 0)


def is_sqlite(content: Column) -> Column:
    return F.substring(content, 1, 6) == F.lit(b"SQLite")


def library_format(tables: DataFrame) -> DataFrame:
    """tables: path, name. Returns path and the one library kind whose tables are all there, else null."""
    sets = tables.groupBy("path").agg(F.collect_set("name").alias("names"))
    kinds = F.array(*(F.when(F.forall(F.array(*map(F.lit, need)), lambda t: F.array_contains("names", t)), F.lit(kind)) for kind, need in LIBRARIES.items()))
    found = F.filter(kinds, lambda x: x.isNotNull())
    return sets.select("path", F.when(F.size(found) == 1, F.get(found, 0)).alias("format"))
