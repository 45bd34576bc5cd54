"""Column expressions for strings, identifiers, dates and lists of a publication record.

All run inside the JVM. A string is *absent* when it is null, empty or "0", without trimming; see
``present``. Patterns are written for Java regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """Whether a field counts as given."""
    return c.isNotNull() & ~c.isin("", "0")


def overlay(old: Column, new: Column) -> Column:
    """The new value where it is given, else the old one."""
    return F.when(present(new), new).otherwise(old)


def identity_sha1(authors: Column, title: Column) -> Column:
    """Identity of a record: 15 hex digits of the SHA-1 of authors and title, one after the other."""
    return F.substring(F.sha1(F.concat(F.coalesce(authors, F.lit("")), F.coalesce(title, F.lit(""))).cast("binary")), 1, 15)


def clean_doi(c: Column) -> Column:
    """The identifier itself, without resolver address or label; null where there is none."""
    return F.nullif(F.regexp_extract(c, r"(10\.\d{4,}/\S+)", 1), F.lit(""))


def clean_arxiv(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?i:arxiv):\s*", "")


def single_dash(c: Column) -> Column:
    """Page ranges with one dash, as records hold them."""
    return F.regexp_replace(c, r"\s*-{2,}\s*", "-")


def double_dash(c: Column) -> Column:
    """Page ranges with two dashes, as BibTeX files hold them."""
    return F.regexp_replace(c, r"(?<=\d)-(?=\d)", "--")


def year_of(c: Column) -> Column:
    """The first four digits in a row of a free-text date."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit(""))


def flat_braces(c: Column) -> Column:
    return F.translate(c, "{}", "")


def strip_tex(c: Column) -> Column:
    """Commands with an argument become the argument."""
    return F.regexp_replace(c, r"\\[A-Za-z]+\{([^{}]*)\}", "$1")


def strip_short_tags(c: Column) -> Column:
    """Removes tags of one letter."""
    return F.regexp_replace(c, r"</?\w>", "")


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def month_name(c: Column) -> Column:
    """Three-letter month names in full; all else as it is."""
    key = F.lower(F.trim(c))
    out = F.when(F.lit(False), c)
    for m in MONTHS:
        out = out.when(key == m[:3].lower(), F.lit(m))
    return out.otherwise(c)


def label_key(c: Column) -> Column:
    """A label as one search token: blanks become 99, all of it between 88s."""
    return F.concat(F.lit("88"), F.replace(c, F.lit(" "), F.lit("99")), F.lit("88"))


def mid_ellipsis(c: Column, length: int) -> Column:
    """Long strings keep their two halves of ``length`` around an ellipsis."""
    tail = -(-length // 2)
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length // 2), F.lit(" ... "), F.right(c, F.lit(tail)))).otherwise(c)


def path_parts(c: Column) -> Column:
    """dir, file, base and extension. Without a dot, the extension is the file's name and the base is empty."""
    file = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.struct(
        F.regexp_extract(c, r"^(.*)/[^/]*$", 1).alias("dir"),
        file.alias("file"),
        F.regexp_extract(file, r"^(.*)\.[^.]*$", 1).alias("base"),
        F.regexp_extract(file, r"([^.]*)$", 1).alias("extension"),
    )


def guid_of(*parts: Column) -> Column:
    """A record's 32 upper-case hex digits, from its content, so that a task that runs again gives the same."""
    return F.upper(F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")))


def new_guid() -> Column:
    """32 upper-case hex digits at random, one for each row; another each time a task runs, so write them before use."""
    return F.upper(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def lock_name(c: Column) -> Column:
    """A file name made of a path: separators become underscores, one leading one goes, the first double one is halved."""
    out = F.regexp_replace(c, r"[/\\:.]", "_")
    out = F.regexp_replace(out, r"^_", "")
    return F.regexp_replace(out, r"^(.*?)__", "$1_")


def quote_words(c: Column, words: tuple[str, ...] = ("DNA", "RNA", "CERN"), smart: bool = True, complete: bool = False) -> Column:
    """Braces around words whose case must hold: all of the title, listed words, or words with inner capitals."""
    if complete:
        return F.concat(F.lit("{"), c, F.lit("}"))
    listed = "|".join(words)
    out = F.regexp_replace(c, rf"\b({listed})\b", "{$1}") if words else c
    if smart:
        out = F.regexp_replace(out, r"(?<![{\w])(\w+[A-Z]\w*)(?![}\w])", "{$1}")
    return out


def repair_bibtex(c: Column) -> Column:
    """One closing brace is added where exactly one is missing and there is one entry."""
    kinds = "article|book|booklet|conference|inbook|incollection|inproceedings|manual|mastersthesis|misc|phdthesis|proceedings|techreport|unpublished"
    opened = F.regexp_count(c, F.lit(r"(?<!\\)\{"))
    closed = F.regexp_count(c, F.lit(r"(?<!\\)\}"))
    entries = F.regexp_count(c, F.lit(rf"(?i)@({kinds}|comment|string)"))
    return F.when((opened == closed + 1) & (entries == 1), F.concat(c, F.lit("}"))).otherwise(c)


def bibtex_counts(c: Column) -> Column:
    """Unescaped braces and entries of a text."""
    kinds = "article|book|booklet|conference|inbook|incollection|inproceedings|manual|mastersthesis|misc|phdthesis|proceedings|techreport|unpublished"
    return F.struct(
        F.regexp_count(c, F.lit(r"(?<!\\)\{")).cast("long").alias("opened"),
        F.regexp_count(c, F.lit(r"(?<!\\)\}")).cast("long").alias("closed"),
        F.regexp_count(c, F.lit(rf"(?i)@({kinds}|comment|string)")).cast("long").alias("entries"),
    )


#: Places of a PubMed or PMC number in an address, in the order in which they count. Fixed values.
PUBMED_PATTERNS = (
    r"http://www\.ncbi\.nlm\.nih\.gov/pubmed/(\d+)",
    r"http://www\.ncbi\.nlm\.nih\.gov/pubmed\?term=(\d+)",
    r"http://www\.ncbi\.nlm\.nih\.gov/sites/entrez/(\d+)",
    r"pubmed/(\d+)$",
    r"\.ncbi\.nlm\.nih\.gov/pmc/articles/(PMC\d+)/",
    r"ukpmc\.ac\.uk/articles/(PMC\d+)",
)


def pubmed_id(url: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in PUBMED_PATTERNS))


def author_list(c: Column) -> Column:
    """The names of an author string, which are joined by the word "and"."""
    return F.split(c, r"\s+and\s+")


def elided_authors(c: Column, most: int = 7, ends: int = 3) -> Column:
    """Names joined by commas; of more than ``most``, the first and last three around a count of the others."""
    names = F.transform(F.split(c, r"\band\b"), lambda x: F.trim(x))
    n = F.size(names)
    mark = F.concat(F.lit(" ... ("), (n - 2 * ends).cast("string"), F.lit(" others) ... "))
    short = F.concat(F.slice(names, 1, ends), F.array(mark), F.slice(names, -ends, ends))
    return F.array_join(F.when(n > most, short).otherwise(names), ", ")


#: Limits in seconds with a fixed text, or a unit and its seconds. Fixed values.
AGES = (
    (60, "Just now", 0),
    (90, "1 minute", 0),
    (3600, "minutes", 60),
    (5400, "1 hour", 0),
    (86400, "hours", 3600),
    (129600, "1 day", 0),
    (604800, "days", 86400),
    (907200, "1 week", 0),
    (2628000, "weeks", 604800),
    (3942000, "1 month", 0),
    (31536000, "months", 2628000),
    (47304000, "1 year", 0),
    (3153600000, "years", 31536000),
    (4730400000, "1 century", 0),
)


def pretty_date(when: Column, now: Column) -> Column:
    """How long ago a time is, in words; later times have no "ago"."""
    diff = F.unix_timestamp(now) - F.unix_timestamp(when)
    age, ago = F.abs(diff), F.when(diff < 0, F.lit("")).otherwise(F.lit(" ago"))
    rounded = lambda unit: F.floor(age / unit + F.lit(0.5)).cast("long").cast("string")
    out = F.when(age < AGES[0][0], F.lit(AGES[0][1]))
    for limit, text, unit in AGES[1:]:
        out = out.when(age < limit, F.concat(rounded(unit), F.lit(f" {text}"), ago) if unit else F.concat(F.lit(text), ago))
    return out.otherwise(F.concat(rounded(AGES[-1][0]), F.lit(" Centuries"), ago))


def seconds_ago(when: Column, now: Column, zone: str = "UTC") -> Column:
    """Seconds from a time that is written in UTC to a time on a clock of the zone."""
    return F.unix_timestamp(now) - F.unix_timestamp(F.from_utc_timestamp(when, zone))


def local_date(c: Column) -> Column:
    """A date string without its time of day."""
    return F.regexp_replace(c, r"\d+:\d+:\d+", "")


def ris_date(c: Column) -> Column:
    """year, month, day and the rest of ``Y/M/D/rest``; empty parts are null."""
    part = lambda k: F.nullif(F.trim(F.coalesce(F.get(F.split(c, "/", 4), k), F.lit(""))), F.lit(""))
    return F.struct(part(0).alias("year"), part(1).alias("month"), part(2).alias("day"), part(3).alias("rest"))


def tree_query(tree, atom) -> Column:
    """A condition from a nested (left, "and" or "or", right); leaves go through ``atom``."""
    if isinstance(tree, (list, tuple)) and len(tree) == 3 and tree[1].lower() in ("and", "or"):
        left, right = tree_query(tree[0], atom), tree_query(tree[2], atom)
        return left & right if tree[1].lower() == "and" else left | right
    return atom(tree)


#: Letters of a text that are cut out first, so that a long text isn't walked through for each run.
_STRETCH = 256


def letter_runs(c: Column, q: Column, each=lambda run: run) -> Column:
    """All runs of q letters of a text in order, or what ``each`` makes of them; none for q below 1."""
    n = F.length(c) - q + 1

    def runs(k: Column) -> Column:
        stretch = F.transform(F.array(F.substring(c, k * _STRETCH + 1, F.lit(_STRETCH - 1) + q)), lambda t: F.transform(F.sequence(F.lit(1), F.least(F.lit(_STRETCH), n - k * _STRETCH)), lambda i: each(F.substring(t, i, q))))
        return F.get(stretch, 0)

    stretches = F.when((q > 0) & (n > 0), F.sequence(F.lit(0), F.floor((n - 1) / _STRETCH).cast("int")))
    return F.flatten(F.transform(F.coalesce(stretches, F.array().cast("array<int>")), runs))
