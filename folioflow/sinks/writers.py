"""Exports of publication records. Each format is a column expression over a record's fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import double_dash, elided_authors, present, strip_short_tags
from ..plugins import register
from ..sources.records import FileFormatError

#: Record fields in the order in which an entry shows them, with their BibTeX names.
BIBTEX_ORDER = (
    ("title", "title"), ("authors", "author"), ("editors", "editor"), ("booktitle", "booktitle"), ("series", "series"), ("journal", "journal"),
    ("publisher", "publisher"), ("organization", "organization"), ("school", "school"), ("address", "address"), ("edition", "edition"), ("chapter", "chapter"),
    ("howpublished", "howpublished"), ("volume", "volume"), ("number", "number"), ("issue", "issue"), ("pages", "pages"), ("year", "year"), ("month", "month"), ("day", "day"),
    ("note", "note"), ("pmid", "pmid"), ("doi", "doi"), ("url", "url"), ("annote", "comment"),
)
#: Fields that an export may leave out or add, with the default. Fixed values.
EXPORT_FIELDS = {"abstract": 0, "affiliation": 0, "eprint": 0, "issn": 0, "isbn": 0, "pmid": 1, "lccn": 0, "doi": 1, "keywords": 0}
RIS_TYPES = {"ARTICLE": "JOUR", "INBOOK": "CHAP", "INCOLLECTION": "CHAP", "BOOK": "BOOK", "PROCEEDINGS": "BOOK", "INPROCEEDINGS": "CONF", "PHDTHESIS": "THES", "MASTERSTHESIS": "THES", "TECHREPORT": "RPRT", "UNPUBLISHED": "UNPB"}
RIS_ORDER = (
    ("title", "TI"), ("journal", "JO"), ("booktitle", "T2"), ("series", "T3"), ("volume", "VL"), ("issue", "IS"), ("publisher", "PB"), ("address", "CY"),
    ("issn", "SN"), ("isbn", "SN"), ("doi", "DO"), ("url", "UR"), ("abstract", "N2"),
)


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def bibtex_entry(df: DataFrame, use_quotes: bool = False, dashes: bool = True, fields: dict[str, int] | None = None) -> Column:
    """One entry: aligned names, values in braces or quotes, absent fields left out."""
    shown = EXPORT_FIELDS | (fields or {})
    order = [(f, n) for f, n in BIBTEX_ORDER if shown.get(f, 1)] + [(f, f) for f, on in shown.items() if on and f not in dict(BIBTEX_ORDER)]
    width = max(len(n) for _, n in BIBTEX_ORDER if n in ("journal", "title")) + 1
    left, right = ('"', '"') if use_quotes else ("{", "}")
    lines = []
    for f, n in order:
        value = _field(df, f)
        text = double_dash(value) if dashes and f == "pages" else value
        lines.append(F.when(present(value), F.concat(F.lit(f"  {n.ljust(width)} = {left}"), text, F.lit(right))))
    body = F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), ",\n")
    return F.concat(F.lit("@"), F.coalesce(_field(df, "pubtype"), F.lit("MISC")), F.lit("{"), F.coalesce(_field(df, "citekey"), F.lit("")), F.lit(",\n"), body, F.lit("\n}\n"))


def ris_entry(df: DataFrame) -> Column:
    """One record of tagged lines."""
    kind = F.lit("GEN")
    for bib, ris in RIS_TYPES.items():
        kind = F.when(_field(df, "pubtype") == bib, F.lit(ris)).otherwise(kind)
    many = lambda name, tag, by: F.when(present(_field(df, name)), F.array_join(F.transform(F.split(_field(df, name), by), lambda x: F.concat(F.lit(f"{tag}  - "), F.trim(x))), "\n"))
    one = [F.when(present(_field(df, f)), F.concat(F.lit(f"{t}  - "), _field(df, f))) for f, t in RIS_ORDER]
    pages = F.split(_field(df, "pages"), "-+")
    page = lambda k, tag: F.when(present(_field(df, "pages")) & F.get(pages, F.lit(k)).isNotNull(), F.concat(F.lit(f"{tag}  - "), F.get(pages, F.lit(k))))
    date = F.when(present(_field(df, "year")), F.concat(F.lit("PY  - "), F.concat_ws("/", _field(df, "year"), F.coalesce(_field(df, "month"), F.lit("")), F.coalesce(_field(df, "day"), F.lit("")), F.lit(""))))
    parts = [F.concat(F.lit("TY  - "), kind), many("authors", "AU", r"\s+and\s+"), many("editors", "A2", r"\s+and\s+"), date, *one, page(0, "SP"), page(1, "EP"), many("keywords", "KW", ";"), F.lit("ER  - ")]
    return F.concat(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n"), F.lit("\n"))


def wrapped(c: Column, width: int = 70) -> Column:
    """Lines broken at blanks so that none has more than ``width`` characters, but for longer words; runs of blanks count as one."""

    def line(text: Column) -> Column:
        words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("last"))

        def put(s: Column, w: Column) -> Column:
            fits = s["last"] + 1 + F.length(w) <= width
            first = s["last"] == 0
            return F.struct(
                F.concat(s["text"], F.when(first, F.lit("")).when(fits, F.lit(" ")).otherwise(F.lit("\n")), w).alias("text"),
                F.when(fits & ~first, s["last"] + 1 + F.length(w)).otherwise(F.length(w)).alias("last"),
            )

        return F.aggregate(words, start, put, lambda s: s["text"])

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


@dataclass(frozen=True)
class Style:
    """How a citation is put together: parts by name with what stands around them, names in one of two ways."""

    parts: tuple[tuple[str, str, str], ...]
    by: str = " "
    initials_first: bool = False
    most: int | None = None  # names beyond this many are "et al."
    last: str = ", "  # before the last name


#: Styles by name. The parts of a record that is absent are left out with what stands around them.
STYLES = {
    "nature": Style((("authors", "", ""), ("title", "", "."), ("journal", "", ""), ("volume", "", ","), ("pages", "", ""), ("year", "(", ").")), most=5, last=" & "),
    "author-date": Style((("authors", "", ""), ("year", "(", ")."), ("title", "", "."), ("journal", "", ","), ("numbers", "", ","), ("pages", "", ".")), most=7, last=", & "),
    "numeric": Style((("authors", "", "."), ("title", "", "."), ("journal", "", "."), ("year", "", ";"), ("numbers", "", ":"), ("pages", "", ".")), most=6),
    "initials first": Style((("authors", "", ","), ("title", "", ","), ("journal", "", ","), ("volume", "vol. ", ","), ("issue", "no. ", ","), ("pages", "pp. ", ","), ("year", "", ".")), initials_first=True, last=" and "),
}


def styled_names(c: Column, style: Style) -> Column:
    """Author names with initials, in a style's order, cut and joined."""

    def one(x: Column) -> Column:
        last, first = F.trim(F.get(F.split(x, ","), 0)), F.coalesce(F.trim(F.get(F.split(x, ","), 1)), F.lit(""))
        marks = F.array_join(F.transform(F.regexp_extract_all(first, F.lit(r"(\p{L})\p{L}*")), lambda i: F.concat(i, F.lit("."))), " ")
        marks = F.nullif(marks, F.lit(""))
        return F.concat_ws(" ", marks, last) if style.initials_first else F.concat_ws(", ", last, marks)

    names = F.transform(F.split(c, r"\s+and\s+"), one)
    n = F.size(names)
    joined = F.when(n == 1, F.get(names, 0)).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(style.last), F.element_at(names, -1)))
    if style.most is not None:
        joined = F.when(n > style.most, F.concat(F.get(names, 0), F.lit(" et al."))).otherwise(joined)
    return F.when(present(c), joined)


def styled_citation(df: DataFrame, style: str) -> Column:
    """A record's citation in a named style."""
    s = STYLES[style]
    value = lambda n: F.when(present(_field(df, n)), _field(df, n))
    numbers = F.concat(value("volume"), F.coalesce(F.concat(F.lit("("), value("issue"), F.lit(")")), F.lit("")))
    known = {"authors": styled_names(_field(df, "authors"), s), "journal": F.coalesce(value("journal"), value("booktitle"), value("publisher")), "numbers": numbers}
    whole = lambda n, after: F.regexp_replace(known.get(n, value(n)), r"\.$", "") if after.startswith(".") else known.get(n, value(n))
    return F.concat_ws(s.by, *(F.concat(F.lit(before), whole(n, after), F.lit(after)) for n, before, after in s.parts))


def citation(df: DataFrame) -> Column:
    """A short citation: journal volume(issue):pages, year."""
    f = lambda n: F.nullif(F.coalesce(_field(df, n), F.lit("")), F.lit(""))
    issue = F.when(f("issue").isNotNull(), F.concat(F.lit("("), f("issue"), F.lit(")")))
    place = F.nullif(F.concat_ws("", f("volume"), issue, F.when(f("pages").isNotNull(), F.concat(F.lit(":"), f("pages")))), F.lit(""))
    return F.concat_ws(", ", F.nullif(F.concat_ws(" ", F.coalesce(f("journal"), f("booktitle"), f("publisher")), place), F.lit("")), f("year"))


def citation_text(df: DataFrame) -> Column:
    """Title, authors and citation on lines of their own, without short tags; wrap with ``wrapped``."""
    return strip_short_tags(F.concat_ws("\n", _field(df, "title"), _field(df, "authors"), citation(df)))


def email_text(df: DataFrame) -> Column:
    """Title, elided authors, citation and link, absent parts skipped, with encoded line ends."""
    parts = [strip_short_tags(_field(df, "title")), elided_authors(_field(df, "authors")), citation(df), _field(df, "linkout")]
    return F.concat_ws("%0A", *(F.when(present(p), p) for p in parts))


def citekey_list(df: DataFrame, cite: bool = False) -> DataFrame:
    """All keys in order of the key, joined by commas, in a citation command if asked: one row ``text``."""
    keys = F.expr("listagg(citekey, ',') WITHIN GROUP (ORDER BY citekey)")
    return df.where(F.col("citekey").isNotNull()).agg(F.coalesce(keys, F.lit("")).alias("text")).select((F.concat(F.lit("\\cite{"), "text", F.lit("}")) if cite else F.col("text")).alias("text"))


FORMATS = {"bibtex": bibtex_entry, "ris": ris_entry, "citations": lambda df: wrapped(citation_text(df)), "email": email_text}


def export_text(df: DataFrame, out_format: str, **settings) -> DataFrame:
    """``text`` of each record in a named format; write it with ``df.write.text``."""
    name = out_format.lower()
    if name not in FORMATS:
        raise FileFormatError(f"unknown format {out_format}")
    return df.select(FORMATS[name](df, **settings).alias("text"))


class Sink:
    """Where records go: made from data and settings, which each sink explains."""

    def __init__(self, data: DataFrame, settings: dict | None = None):
        self.data, self.settings = data, settings or {}

    def write(self):
        raise NotImplementedError


@register("sink", "file")
class FileSink(Sink):
    """Text files: ``out_format`` and ``path``, and what the format has as settings; a string if there is no path."""

    def write(self) -> str | None:
        more = dict(self.settings)
        out_format, path = more.pop("out_format"), more.pop("path", None)
        rows = export_text(self.data, out_format, **more)
        if path is None:
            return "\n".join(r["text"] for r in rows.collect())  # a string is what the caller asked for
        rows.write.mode("errorifexists").text(path)
        return None


@register("sink", "library")
class LibrarySink(Sink):
    """A library of its own at ``path``."""

    def write(self) -> None:
        export_library(self.data, self.settings["path"])


def export_library(df: DataFrame, path: str) -> None:
    """A copy of the records as a library of its own, without pointers to local files."""
    df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in ("pdf", "pdf_name") if c in df.columns}).write.mode("errorifexists").parquet(path)


def write_string(rows: list[dict], schema, out_format: str, spark) -> str:
    """In-memory records as one text."""
    return "\n".join(r["text"] for r in export_text(spark.createDataFrame(rows, schema), out_format).collect())
