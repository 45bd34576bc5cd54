"""Titles and authors from the text lines of document layouts.

Lines (document, position, content, font size, box, word-list counts) are gathered once by document, which has
few of them, into an array; all rules are column expressions over it. A publisher's sign says which rule reads
a document; the first that fits decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plugins import REGISTRY, register
from ..store import written

LINE = "doc string, position int, content string, fs double, xmin double, xmax double, ymin double, nr_bad_words int, nr_bad_author_words int, nr_common_words int, address_count int"


def word_features(lines: DataFrame, bad: list[str], bad_author: list[str], common: list[str]) -> DataFrame:
    """Lines with the number of their words in each of three short lists."""
    words = F.split(F.lower("content"), r"[^\p{L}\p{N}]+")
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed))) if listed else F.lit(0)
    return lines.withColumns({"nr_bad_words": count(bad), "nr_bad_author_words": count(bad_author), "nr_common_words": count(common)})


@dataclass
class FontRule:
    """Title lines in one font; author lines below, within the title's span, in another."""

    signs: tuple[str, ...]
    fonts: tuple[tuple[float, float], ...]
    skip: str
    case: int = re.I
    strict: bool = True  # stop at distances, common words and the abstract, too
    both: bool = True  # go on to the next pair until title and authors are found


#: Signs, font pairs in order, and title lines to leave out. Fixed values.
NATURE = FontRule(
    (r"Nature\sPublishing\sGroup", r"Nature\sAmerica\sInc\.", r"http://[a-z]+\.nature\.com", r"www\.nature\.com", r"doi:\s?10\.1038"),
    ((32, 9), (28, 11), (24, 12), (24, 11), (24, 10), (23, 10), (22, 12), (22, 11), (22, 10), (18, 11), (18, 10), (18, 9), (17, 8)),
    "ARTICLES",
)
SCIENCE = FontRule((r"www\.sciencemag\.org",), ((20, 10), (22, 9), (24, 10)), r"RESEARCH\sARTICLES", 0, False, False)
#: Distances in points: below the title at most, between author lines at most, left and right of the title's box. Fixed values.
BELOW, GAP, LEFT, RIGHT = 300, 30, 20, 100


Line = Callable[[Column], Column]


def _texts(lines: Column, by: str, keep: Line | None = None) -> Column:
    """The contents of the lines that are kept, joined; null without any."""
    some = F.filter(lines, keep) if keep else lines
    return F.nullif(F.array_join(F.transform(some, lambda x: x["content"]), by), F.lit(""))


def _shows(sign: str) -> Line:
    return lambda text: text.rlike(sign)


def _first(lines: Column, where: Line) -> Column:
    """The number of the first line with a property; null if none has it."""
    return F.array_min(F.transform(F.filter(lines, where), lambda x: x["at"]))


def _let(value: Column, use: Line) -> Column:
    """What ``use`` makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def by_fonts(docs: DataFrame, rule: FontRule) -> DataFrame:
    """doc, title, authors of documents (doc, lines) by the rule's pairs of fonts.

    For each pair the heading is a box. The lines in the author font whose boxes overlap its columns and don't
    start above its last line are candidates; those between the margins count up to the first line that ends
    the block. The first pair that gives authors wins; without one the last pair with a heading gives a title.
    All pairs are one expression over a document's lines, which stay where they are; pairs whose fonts don't occur are left out first."""
    lines, flags = F.col("lines"), "(?i)" if rule.case else ""
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("heading"), F.lit(float(a)).alias("names")) for t, a in rule.fonts))
    foreign = lambda x: (x["nr_bad_words"] > 0) | (x["nr_bad_author_words"] > 0)

    def box(heading: Column) -> Column:
        edge = lambda of, name: of(F.transform(heading, lambda x: x[name]))
        last = F.element_at(heading, -1)
        return F.struct(edge(F.array_min, "xmin").alias("left"), edge(F.array_max, "xmax").alias("right"), last["ymin"].alias("top"), last["at"].alias("last"))

    def ends(below: Column, block: Column, b: Column) -> Column:
        if not rule.strict:
            return F.array(_first(block, lambda x: foreign(x) | (x["nr_common_words"] > 0)))
        gaps = F.transform(block, lambda x, k: F.when((k > 0) & (x["ymin"] - F.get(block, k - 1)["ymin"] > GAP), x["at"]))
        return F.array(
            _first(lines, lambda x: x["content"].startswith("Abstract")),
            _first(below, lambda x: x["ymin"] - b["top"] > BELOW),
            _first(block, lambda x: foreign(x) | (x["address_count"] > 0) | ((x["nr_common_words"] > 0) & (x["at"] > b["last"] + 1))),
            F.array_min(gaps),
        )

    def names(font: Column, b: Column) -> Column:
        below = F.filter(lines, lambda x: (x["fs"] == font) & (x["xmax"] >= b["left"]) & (x["xmin"] <= b["right"]) & (x["ymin"] >= b["top"]))

        def text(below: Column) -> Column:
            inside = F.filter(below, lambda x: (x["xmin"] > b["left"] - LEFT) & (x["xmax"] < b["right"] + RIGHT) & (F.length(x["content"]) >= (5 if rule.strict else 0)))
            return _let(inside, lambda block: _let(F.coalesce(F.array_min(ends(below, block, b)), F.size(lines)), lambda end: _texts(block, ",", lambda x: x["at"] < end)))

        return _let(below, text)

    def pair(p: Column) -> Column:
        heading = F.filter(lines, lambda x: (x["fs"] == p["heading"]) & ~x["content"].rlike(flags + rule.skip))
        whole = lambda h: F.struct(_texts(h, " ").alias("title"), _let(box(h), lambda b: names(p["names"], b)).alias("authors"))
        return _let(heading, lambda h: F.when(F.size(h) > 0, whole(h)))

    there = F.filter(pairs, lambda p: F.exists(lines, lambda x: x["fs"] == p["heading"]))
    found = docs.select("doc", F.filter(F.transform(there, pair), lambda m: m.isNotNull()).alias("found"))
    first = F.get("found", 0)
    best = F.coalesce(F.get(F.filter("found", lambda m: m["authors"].isNotNull()), 0), F.try_element_at("found", F.lit(-1))) if rule.both else first
    return found.select("doc", best.alias("m")).select("doc", "m.title", "m.authors")


def biopolymers(docs: DataFrame) -> DataFrame:
    """Font 18 up to the abstract; font 11 up to an address."""
    size = F.size("lines")
    abstract = F.coalesce(_first(F.col("lines"), lambda x: x["content"].startswith("Abstract:")), size)
    address = F.coalesce(_first(F.col("lines"), lambda x: x["address_count"] > 0), size)
    d = docs.withColumns({"abstract": abstract, "address": address})
    title = _texts(F.col("lines"), " ", lambda x: (x["fs"] == 18) & (x["at"] <= F.col("abstract")))
    return d.select("doc", title.alias("title"), _texts(F.col("lines"), ", ", lambda x: (x["fs"] == 11) & (x["at"] <= F.col("address"))).alias("authors"))


def landes(docs: DataFrame) -> DataFrame:
    """Font 24; lines that end in a comma near the left edge in font 12, else in font 10 near the top."""
    edge = lambda x: (F.abs(37 - x["xmin"]) <= 7) & x["content"].endswith(",")
    large = _texts(F.col("lines"), ",", lambda x: (x["fs"] == 12) & edge(x))
    small = _texts(F.col("lines"), ",", lambda x: (x["fs"] == 10) & edge(x) & (x["ymin"] < 200))
    return docs.select("doc", _texts(F.col("lines"), " ", lambda x: x["fs"] == 24).alias("title"), F.coalesce(large, small).alias("authors"))


def jstor(docs: DataFrame) -> DataFrame:
    """A cover page: all before the author line is the title; without one, indented lines are authors."""
    label = F.array_max(F.transform(F.filter("lines", lambda x: x["content"].startswith("Author(s):")), lambda x: x["at"]))
    d = docs.withColumns({"label": label, "indent": F.coalesce(_first(F.col("lines"), lambda x: x["xmin"] > 50), F.size("lines"))})
    d = d.withColumn("cut", F.coalesce("label", "indent"))
    source = _first(F.col("lines"), lambda x: (x["at"] > F.col("label")) & x["content"].startswith("Source"))
    bad = _first(F.col("lines"), lambda x: (x["at"] >= F.col("indent")) & (x["nr_bad_words"] > 0))
    d = d.withColumn("end", F.coalesce(F.when(F.col("label").isNotNull(), source).otherwise(bad), F.size("lines")))
    names = _texts(F.col("lines"), " ", lambda x: (x["at"] >= F.col("cut")) & (x["at"] < F.col("end")))
    names = F.when(F.col("label").isNotNull(), F.regexp_replace(names, r"^Author\(s\):\s", "")).otherwise(F.replace(names, F.lit(";"), F.lit(",")))
    return d.select("doc", _texts(F.col("lines"), " ", lambda x: x["at"] < F.col("cut")).alias("title"), names.alias("authors"))


@dataclass
class Layout:
    """A publisher's sign in any line, and the function that reads documents with it."""

    sign: str
    read: Callable[[DataFrame], DataFrame]


#: In the order that decides where a document has several signs.
LAYOUTS: dict[str, Layout] = {
    "biopolymers": Layout(r"(?i)^Biopolymers,\sVol\.\s\d+", biopolymers),
    "jstor": Layout(r"(?i)Your\suse\sof\sthe\sJSTOR\sarchive\sindicates", jstor),
    "landes": Layout(r"Landes Bioscience", landes),
    "nature": Layout("(?i)" + "|".join(NATURE.signs), lambda docs: by_fonts(docs, NATURE)),
    "science": Layout("|".join(SCIENCE.signs), lambda docs: by_fonts(docs, SCIENCE)),
}


for _name, _layout in LAYOUTS.items():
    register("layout", _name)(_layout)


def extract_titles(lines: DataFrame, rotated: DataFrame | None = None, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """doc, title, authors of each document of a line table; both null where no layout fits.

    rotated: doc and content of texts at the page's side, where signs are looked for, too. layouts: those to try in
    their order, the registered ones if not given; a new one is any pattern with a function from (doc, lines) to
    (doc, title, authors)."""
    layouts = REGISTRY["layout"] if layouts is None else layouts
    names = [c for c in lines.columns if c not in ("doc", "position")]
    docs = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("position", *names))).alias("lines"))
    docs = docs.withColumn("lines", F.transform("lines", lambda x, k: F.struct(k.alias("at"), *(x[c].alias(c) for c in names))))
    docs = docs.withColumn("texts", F.transform("lines", lambda x: x["content"]))
    if rotated is not None:
        side = rotated.groupBy("doc").agg(F.collect_list("content").alias("side"))
        docs = docs.join(side, "doc", "left").withColumn("texts", F.concat("texts", F.coalesce("side", F.array()))).drop("side")
    which = F.lit(None).cast("string")
    for name, layout in reversed(layouts.items()):
        which = F.when(F.exists("texts", _shows(layout.sign)), F.lit(name)).otherwise(which)
    docs = written(docs.select("doc", "lines", which.alias("layout")), "layouts")  # each layout reads its own documents, grouped once
    out = docs.where("layout is null").select("doc", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("authors"))
    for name, layout in layouts.items():
        own = docs.where(F.col("layout") == name).drop("layout")
        out = out.unionByName(own.select("doc").join(layout.read(own), "doc", "left"))
    return out


def box_text(value: Column) -> Column:
    """A coordinate with two decimals."""
    return F.format_string("%.2f", value)


#: Units between the tops of words of one line at most; between columns, and between blocks, at least.
TOPS, GUTTER, LEADING = 2.0, 20.0, 18.0
#: Words of a task at most, but for documents that have more: some 900 bytes each while they are sorted.
TASK_WORDS = 250_000


def _dealt(words: DataFrame) -> DataFrame:
    """Words dealt by documents to so many tasks that their sorts stay in memory. Spark joins tasks by packed bytes, of which a word has few."""
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // TASK_WORDS))
    return words.repartition(tasks, "doc")


def _segments(words: DataFrame, within: list, low: Column, high: Column, gap: float, name: str) -> DataFrame:
    """Numbers the groups that white space of more than ``gap`` leaves along one axis: sorted by their beginnings,
    a word begins a group if it begins that far behind the end of all before it."""
    before = Window.partitionBy(*within).orderBy(low, high, "word").rowsBetween(Window.unboundedPreceding, -1)
    marked = words.withColumn("_new", F.coalesce((low - F.max(high).over(before) > gap).cast("int"), F.lit(0)))
    upto = Window.partitionBy(*within).orderBy(low, high, "word").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum("_new").over(upto)).drop("_new")


def reading_order(words: DataFrame, rounds: int = 2, gutter: float = GUTTER, leading: float = LEADING) -> DataFrame:
    """A word table with ``block``, an array by which its blocks sort as they are read.

    Pages are cut along white space that crosses them: into bands above each other, each band into columns, each column
    into bands again, and so on for some rounds. Windows never leave a page."""
    out, cuts = _dealt(words), []
    for k in range(rounds):
        for axis, low, high, gap in (("band", F.col("ymin"), F.col("ymin"), leading), ("column", F.col("xmin"), F.col("xmax"), gutter)):
            name = f"_{axis}_{k}"
            out = _segments(out, ["doc", "page", *cuts], low, high, gap, name)
            cuts.append(name)
    return out.withColumn("block", F.array(*cuts)).drop(*cuts)


def words_to_lines(words: DataFrame, tolerance: float = TOPS, by: tuple[str, ...] = ()) -> DataFrame:
    """A word table (doc, page, word, xmin, xmax, ymin, size) as lines: words of one size, each top
    within ``tolerance`` of the one above it. by: more columns that a line's words share, such as ``block`` of ``reading_order``, which has dealt them."""
    within = ["doc", "page", "size", *by]
    lines = _segments(words if by else _dealt(words), within, F.col("ymin"), F.col("ymin"), tolerance, "_line").groupBy(*within, "_line").agg(
        F.expr("listagg(word, ' ') WITHIN GROUP (ORDER BY xmin)").alias("content"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin")
    )
    return lines.withColumnRenamed("size", "fs").drop("_line")
