"""Formats, library files, sources, sinks, pages, layouts, names and similarity hashes, over records made of the standard tables."""

from __future__ import annotations

import sqlite3

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, structured, text
from ..operators import layouts, library, matching, search, webpages
from ..plugins import plugin
from ..sinks import wordprocessor, writers
from ..sources import bibtex, datasource, detect, formats, libraries, lifecycle, readers, ris
from ..store import working_folder
from ..streaming import feeds
from ..streaming.run import drained, limited
from .search_queries import query
from .tables import PUBLICATIONS_SQL, publications, spread, table


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _filled(template: str, **values) -> Column:
    """A text with its {names} replaced by columns."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), _s(c))
    return out


def _filled_sql(template: str | None, **values) -> str:
    if template is None:
        return "NULL"
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, sql in values.items():
        out = f"replace({out}, '{{{name}}}', CAST({sql} AS VARCHAR))"
    return out


_PART = {"k": "p_partkey", "name": "p_name"}


# -- formats ----------------------------------------------------------------------------------------------

#: Texts with a mark at some line, and the format that they have by the first 500 lines and the five before each.
_MARKED = (
    ("{name}\n\n@Article{x,", "BIBTEX"), ("{name}\n  ty  - JOUR", "RIS"), ('<?xml version="1.0"?>\n<rss>{name}', "RSS"), ("{name}\nplain", None),
    ("{name}\n" + "line\n" * 500 + "@book{y,", None), ("xml\n" + "{name}\n" * 6 + "rss", None), ("xml\n" + "{name}\n\n" * 4 + "rss\n@misc{z,", "RSS"), ("{name}\n" + "line\n" * 498 + "TY  - BOOK", "RIS"),
)


def _cases(key: str, of: tuple, render) -> str:
    return f"CASE {key} % {len(of)} " + " ".join(f"WHEN {k} THEN {render(x)}" for k, x in enumerate(of)) + " END"


def _case(key: str, of: tuple, render) -> Column:
    out = F.lit(None).cast("string")
    for k, x in enumerate(of):
        out = F.when(F.col(key) % len(of) == k, render(x)).otherwise(out)
    return out


@query("format_of_marked_texts", f"SELECT p_partkey, {_cases('p_partkey', _MARKED, lambda x: _filled_sql(x[1]))} AS format FROM part")
def format_of_marked_texts(spark, sf):
    """Marks inside and outside the lines that are looked at."""
    p = spread(table(spark, sf, "part"))
    return p.select("p_partkey", detect.text_format(_case("p_partkey", _MARKED, lambda x: _filled(x[0], name="p_name"))).alias("format"))


_LEGACY = (
    ("{name}\n<mods version=3>", "MODS"), ("<PubmedArticle>{name}", "MEDLINE"), ("{name}\n@inbook{k,", "BIBTEX"), ("FN ISI Export {name}", "ISI"), ("{name}\n%0 Book", "ENDNOTE"), ("{name}\nTY  - JOUR", "RIS"),
    ("{name}", None), ("{name}\n" * 100 + "@book{x,", None),
)


@query("legacy_format", f"SELECT p_partkey, {_cases('p_partkey', _LEGACY, lambda x: _filled_sql(x[1]))} AS format FROM part")
def legacy_format(spark, sf):
    """The older detection over 100 lines and six formats."""
    p = spread(table(spark, sf, "part"))
    return p.select("p_partkey", detect.legacy_format(_case("p_partkey", _LEGACY, lambda x: _filled(x[0], name="p_name"))).alias("format"))


_BIB = (
    '@string{jt = "Journal {name}"}\n@string(pr = {Press})\n@article{k{key}a, journal = jt # " of " # {Things}, title = {A {B} "c" {name}}, volume = {key}, month = nov, pages = {1--9}, DOI = "http://dx.doi.org/10.1000/x{key}"}\n'
    '@book{bad{key}, title = {never closed\n\n@book{k{key}b, title = "Quoted {"}inner{"}", publisher = pr # " Inc", year = "01-JAN-2011", comment = {c {d}}}\n@comment{left out}\n@misc{k{key}c, note = undefined # "x"}'
)


@query(
    "bibtex_grammar",
    """SELECT 'k' || s_suppkey || e AS citekey, CASE e WHEN 'a' THEN 'ARTICLE' WHEN 'b' THEN 'BOOK' ELSE 'MISC' END AS pubtype, CASE e WHEN 'a' THEN 'A B "c" ' || s_name WHEN 'b' THEN 'Quoted "inner"' END AS title,
       CASE e WHEN 'a' THEN 'Journal ' || s_name || ' of Things' END AS journal, CASE e WHEN 'a' THEN CAST(s_suppkey AS VARCHAR) END AS volume, CASE e WHEN 'a' THEN 'November' END AS month, CASE e WHEN 'a' THEN '1-9' END AS pages,
       CASE e WHEN 'a' THEN '10.1000/x' || s_suppkey END AS doi, CASE e WHEN 'b' THEN 'Press Inc' END AS publisher, CASE e WHEN 'b' THEN '2011' END AS year, CASE e WHEN 'b' THEN 'c d' END AS annote, CASE e WHEN 'c' THEN 'x' END AS note
       FROM supplier, (VALUES ('a'), ('b'), ('c')) v(e)""",
)
def bibtex_grammar(spark, sf):
    """Macros, concatenation, quotes, nested braces, and an entry that never ends: parsing goes on behind it."""
    files = table(spark, sf, "supplier").select(F.col("s_name").alias("path"), _filled(_BIB, name="s_name", key="s_suppkey").alias("content"))
    return readers.parse_files(files, bibtex.read_bibtex).select("citekey", "pubtype", "title", "journal", "volume", "month", "pages", "doi", "publisher", "year", "annote", "note")


@query("ris_charset", "SELECT 'Café ' || s_name || 'über' AS title, 'Müller, ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Zoë' ELSE 'Åse' END AS authors, CAST(s_suppkey AS VARCHAR) AS volume FROM supplier")
def ris_charset(spark, sf):
    """The character set of each file is found: Latin-1 for even keys, UTF-8 for odd ones. A line without a tag goes on without a blank."""
    content = F.concat(F.lit("TY  - JOUR\nTI  - Café "), "s_name", F.lit("\nüber\nAU  - Müller, "), F.when(F.col("s_suppkey") % 2 == 0, "Zoë").otherwise("Åse"), F.lit("\nVL  - "), _s("s_suppkey"), F.lit("\nER  - \n"))
    coded = F.when(F.col("s_suppkey") % 2 == 0, F.encode(content, "ISO-8859-1")).otherwise(F.encode(content, "UTF-8"))
    return readers.parse_files(table(spark, sf, "supplier").select(F.col("s_name").alias("path"), coded.alias("content")), ris.read_ris_bytes).select("title", "authors", "volume")


def _text_files(df: DataFrame, what: str) -> str:
    """The rows' ``text`` as files of a new folder, one for each row."""
    path = working_folder(df.sparkSession, what)
    df.select("text", F.monotonically_increasing_id().alias("k")).write.partitionBy("k").text(path)
    return path


_RSS = "<rss><channel><title>Feed {key}</title><item><title>{name} one</title><link>http://x.org/{key}/1</link><description>D</description></item><item><title>{name} one</title><link>http://x.org/{key}/2</link></item></channel></rss>"
_ATOM = '<feed><title>Feed {key}</title><entry><title>{name} two</title><id>urn:{key}</id><link rel="self" href="http://x.org/s"/><link href="http://x.org/{key}/3"/><summary>S</summary><author><name>Jane Roe</name></author><author><name>J. Doe</name></author></entry></feed>'


@query(
    "feed_items",
    """SELECT 'Feed ' || n_nationkey AS feed, n_name || CASE WHEN i < 3 THEN ' one' ELSE ' two' END AS title, 'http://x.org/' || n_nationkey || '/' || i AS linkout,
       CASE i WHEN 1 THEN 'D' WHEN 3 THEN 'S' END AS abstract, CASE WHEN i = 3 THEN 'Jane Roe and J. Doe' END AS authors, true AS needs_details FROM nation, (VALUES (1), (2), (3)) v(i)""",
)
def feed_items(spark, sf):
    """Items of RSS feeds and entries of Atom ones."""
    n = table(spark, sf, "nation")
    rows = n.select(F.explode(F.array(_filled(_RSS, key="n_nationkey", name="n_name"), _filled(_ATOM, key="n_nationkey", name="n_name"))).alias("text"))
    return readers.read_feed(spark, _text_files(rows, "feeds"))


@query("feed_source", "SELECT n_name || t AS title, true AS needs_details FROM nation, (VALUES (' one'), (' two')) v(t)")
def feed_source(spark, sf):
    """A feed's items once for each identity, all still without details."""
    n = table(spark, sf, "nation")
    rows = n.select(F.explode(F.array(_filled(_RSS, key="n_nationkey", name="n_name"), _filled(_ATOM.replace("<author><name>Jane Roe</name></author><author><name>J. Doe</name></author>", ""), key="n_nationkey", name="n_name"))).alias("text"))
    source = plugin("source", "feed")(spark, _text_files(rows, "feeds"))
    source.connect()
    return source.all().where(source.needs_completing()).select("title", "needs_details")


@query("file_source", "SELECT s_name AS title, 'N' || s_nationkey AS authors, '' AS citekey, row_number() OVER (ORDER BY s_name) AS place FROM supplier ORDER BY s_name LIMIT 40 OFFSET 10")
def file_source(spark, sf):
    """A file parsed by its format, keys blanked, each identity once; one page of it."""
    s = table(spark, sf, "supplier").select(F.lit("ARTICLE").alias("pubtype"), F.concat(F.lit("k"), _s("s_suppkey")).alias("citekey"), F.col("s_name").alias("title"), F.concat(F.lit("N"), _s("s_nationkey")).alias("authors"))
    path = working_folder(spark, "files")
    writers.export_text(s.unionByName(s), "bibtex").coalesce(1).write.text(path)
    source = plugin("source", "file")(spark, path)
    source.order = (("title", False),)
    source.connect_within(60, 600)
    return source.page(10, 40).select("title", "authors", "citekey", (F.row_number().over(_by("title")) + 10).cast("long").alias("place"))


def _by(*columns):
    from pyspark.sql.window import Window

    return Window.orderBy(*columns)


# -- library files of other programs ------------------------------------------------------------------


#: Bytes of the files that a task holds at once.
FILE_BYTES = 4 << 20


def _sqlite_files(rows: DataFrame, path: str, make) -> DataFrame:
    """(path, content): a SQLite file for each value of ``path``, made from its rows by ``make(db, list of rows)``."""
    names_ = [c for c in rows.columns if c != path]
    packed = rows.groupBy(F.col(path).cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct(*names_))).alias("rows"))

    def run(batches):
        for batch in batches:
            names_, files, size = [], [], 0
            for name, group in zip(batch.column(0), batch.column(1), strict=True):
                db = sqlite3.connect(":memory:")
                make(db, group.as_py())
                db.commit()
                names_.append(name.as_py())
                files.append(db.serialize())
                size += len(files[-1])
                db.close()
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names_, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])
                    names_, files, size = [], [], 0
            if files:
                yield pa.RecordBatch.from_arrays([pa.array(names_, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])

    return packed.mapInArrow(run, "path string, content binary")


def _zotero(db, rows):
    db.executescript(
        "CREATE TABLE zoteroDummyTable (id); CREATE TABLE items (itemID, itemTypeID); CREATE TABLE itemTypes (itemTypeID, typeName); CREATE TABLE fields (fieldID, fieldName); CREATE TABLE itemDataValues (valueID, value);"
        "CREATE TABLE itemData (itemID, fieldID, valueID); CREATE TABLE deletedItems (itemID); CREATE TABLE itemNotes (itemID, sourceItemID, note); CREATE TABLE creatorData (creatorDataID, firstName, lastName);"
        "CREATE TABLE creators (creatorID, creatorDataID); CREATE TABLE creatorTypes (creatorTypeID, creatorType); CREATE TABLE itemCreators (itemID, creatorID, creatorTypeID, orderIndex);"
        "CREATE TABLE collections (collectionID, collectionName, parentCollectionID); CREATE TABLE collectionItems (collectionID, itemID);"
    )
    db.executemany("INSERT INTO itemTypes VALUES (?, ?)", [(1, "journalArticle"), (2, "book"), (3, "webpage"), (4, "note")])
    db.executemany("INSERT INTO fields VALUES (?, ?)", [(1, "title"), (2, "date"), (3, "publicationTitle")])
    db.executemany("INSERT INTO collections VALUES (?, ?, ?)", [(1, "top", None), (2, "sub", 1), (3, "other", None)])
    db.executemany("INSERT INTO creatorTypes VALUES (?, ?)", [(1, "author"), (2, "editor")])
    for r in rows:
        k = r["s_suppkey"]
        db.execute("INSERT INTO items VALUES (?, ?)", (k, k % 4 + 1))
        for f, v in ((1, r["s_name"]), (2, f"{1990 + r['s_nationkey']}-0{k % 9 + 1}-00"), (3, "J Things")):
            db.execute("INSERT INTO itemDataValues VALUES (?, ?)", (4 * k + f, v))
            db.execute("INSERT INTO itemData VALUES (?, ?, ?)", (k, f, 4 * k + f))
        for n, (first, role) in enumerate((("Ann", 1), ("Bob", 1), ("Ed", 2))):
            db.execute("INSERT INTO creatorData VALUES (?, ?, ?)", (4 * k + n, first, f"L{k}"))
            db.execute("INSERT INTO creators VALUES (?, ?)", (4 * k + n, 4 * k + n))
            db.execute("INSERT INTO itemCreators VALUES (?, ?, ?, ?)", (k, 4 * k + n, role, 9 - n))
        db.executemany("INSERT INTO collectionItems VALUES (?, ?)", [(2, k)] + [(3, k)] * (k % 2))
        if k % 5 == 0:
            db.execute("INSERT INTO deletedItems VALUES (?)", (k,))
        db.execute("INSERT INTO itemNotes VALUES (?, ?, ?)", (10**6 + k, k, f"note {k}"))


@query(
    "zotero_library",
    """SELECT 'N' || s_nationkey AS path, s_name AS title, CASE s_suppkey % 4 WHEN 0 THEN 'ARTICLE' WHEN 1 THEN 'BOOK' ELSE 'MISC' END AS pubtype, CASE WHEN s_suppkey % 4 = 2 THEN 'Webpage' END AS howpublished, CAST(1990 + s_nationkey AS VARCHAR) AS year,
       '0' || (s_suppkey % 9 + 1) AS month, 'J Things' AS journal, 'L' || s_suppkey || ', Bob and L' || s_suppkey || ', Ann' AS authors, 'L' || s_suppkey || ', Ed' AS editors, CASE WHEN s_suppkey % 2 = 1 THEN 'other,top/sub' ELSE 'top/sub' END AS folders_tmp,
       'note ' || s_suppkey AS annote FROM supplier WHERE s_suppkey % 4 < 3 AND s_suppkey % 5 <> 0""",
)
def zotero_library(spark, sf):
    """SQLite files of one program, read on the executors: fields, people, folders, notes; no deleted items."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("N"), _s("s_nationkey")).alias("path"), "s_suppkey", "s_name", "s_nationkey")
    return libraries.read_zotero(_sqlite_files(s, "path", _zotero)).select("path", "title", "pubtype", "howpublished", "year", "month", "journal", "authors", "editors", "folders_tmp", "annote")


def _mendeley(db, rows):
    db.executescript(
        "CREATE TABLE RunsSinceLastCleanup (time); CREATE TABLE Documents (id, type, title, publication, year, city, onlyReference); CREATE TABLE DocumentContributors (id, documentId, contribution, firstNames, lastName);"
        "CREATE TABLE DocumentUrls (documentId, position, url); CREATE TABLE DocumentKeywords (documentId, keyword); CREATE TABLE DocumentTags (documentId, tag); CREATE TABLE Folders (id, name, parentId); CREATE TABLE DocumentFolders (documentId, folderId);"
    )
    db.executemany("INSERT INTO Folders VALUES (?, ?, ?)", [(1, "a", -1), (2, "b", 1)])
    for r in rows:
        k = r["s_suppkey"]
        db.execute("INSERT INTO Documents VALUES (?, ?, ?, ?, ?, ?, ?)", (k, "JournalArticle" if k % 3 else "Generic", r["s_name"], "J", 1990 + r["s_nationkey"], f"City {k}" if k % 2 else None, "false"))
        db.executemany("INSERT INTO DocumentContributors VALUES (?, ?, ?, ?, ?)", [(2 * k + 1, k, "DocumentAuthor", "B. C.", "Doe"), (2 * k, k, "DocumentAuthor", "A.", f"L{k}")])
        db.executemany("INSERT INTO DocumentTags VALUES (?, ?)", [(k, "z"), (k, "a")])
        db.execute("INSERT INTO DocumentKeywords VALUES (?, ?)", (k, f"w{k % 7}"))
        db.execute("INSERT INTO DocumentUrls VALUES (?, ?, ?)", (k, 0, f"http://x.org/{k}".encode()))
        db.execute("INSERT INTO DocumentFolders VALUES (?, ?)", (k, 2))


@query(
    "mendeley_library",
    """SELECT 'N' || s_nationkey AS path, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'MISC' ELSE 'ARTICLE' END AS pubtype, CASE WHEN s_suppkey % 3 = 0 THEN 'Generic' END AS howpublished, CAST(1990 + s_nationkey AS VARCHAR) AS year, 'J' AS journal,
       'L' || s_suppkey || ', A. and Doe, B. C.' AS authors, 'a,z' AS labels, 'w' || (s_suppkey % 7) AS keywords, 'http://x.org/' || s_suppkey AS linkout, 'a/b' AS folders_tmp,
       CASE WHEN s_suppkey % 2 = 1 THEN 'Mendeley field "city": City ' || s_suppkey || '<br />' || chr(10) ELSE '' END || 'Mendeley field "onlyReference": false<br />' || chr(10) AS note FROM supplier""",
)
def mendeley_library(spark, sf):
    """SQLite files of another program: columns that a record lacks go to the note, tags to labels."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("N"), _s("s_nationkey")).alias("path"), "s_suppkey", "s_name", "s_nationkey")
    return libraries.read_mendeley(_sqlite_files(s, "path", _mendeley)).select("path", "title", "pubtype", "howpublished", "year", "journal", "authors", "labels", "keywords", "linkout", "folders_tmp", "note")


def _native(db, rows):
    db.executescript("CREATE TABLE Publications (guid, title, citekey, year); CREATE TABLE Fulltext (guid);")
    db.executemany("INSERT INTO Publications VALUES (?, ?, ?, ?)", [(f"G{r['s_suppkey']}", r["s_name"], "own key", 1990 + r["s_nationkey"]) for r in rows])


@query("native_library", "SELECT 'G' || s_suppkey AS guid, s_name AS title, '' AS citekey, CAST(1990 + s_nationkey AS VARCHAR) AS year FROM supplier")
def native_library(spark, sf):
    """Native library files, with blank citekeys."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("N"), _s("s_nationkey")).alias("path"), "s_suppkey", "s_name", "s_nationkey")
    return libraries.read_native(_sqlite_files(s, "path", _native)).select("guid", "title", "citekey", "year")


@query("library_files", "SELECT c_name AS path, CASE c_custkey % 5 WHEN 0 THEN 'ZOTERO' WHEN 1 THEN 'MENDELEY' WHEN 2 THEN 'NATIVE' END AS format FROM customer")
def library_files(spark, sf):
    """The makers of files, by their first bytes and their tables."""
    makers = ("CREATE TABLE zoteroDummyTable (id)", "CREATE TABLE DocumentContributors (id); CREATE TABLE RunsSinceLastCleanup (time)", "CREATE TABLE Publications (guid); CREATE TABLE Fulltext (guid)", "CREATE TABLE DocumentContributors (id)")
    c = table(spark, sf, "customer").select("c_name", "c_custkey")
    made = _sqlite_files(c.where("c_custkey % 5 < 4"), "c_name", lambda db, rows: db.executescript(makers[rows[0]["c_custkey"] % 5]))
    plain = c.where("c_custkey % 5 = 4").select(F.col("c_name").alias("path"), F.lit("SQL is text here").cast("binary").alias("content"))
    return libraries.library_formats(made.unionByName(plain))


@query("deep_folders", "WITH RECURSIVE t AS (SELECT min(s_suppkey) AS k, min_by(s_name, s_suppkey) AS path FROM supplier UNION ALL SELECT s_suppkey, path || '/' || s_name FROM t JOIN supplier ON s_suppkey = k + 1) SELECT CAST(k AS VARCHAR) AS guid, path FROM t")
def deep_folders(spark, sf):
    """A chain of folders, one for each supplier, beside a cycle that has no path."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    before = s.select((k + 1).alias("s_suppkey"), k.alias("p"))
    chain = s.join(before, "s_suppkey", "left").select(_s(k).alias("guid"), _s("p").alias("parent"), F.col("s_name").alias("name"))
    cycle = table(spark, sf, "nation").where("n_nationkey < 2").select(F.concat(F.lit("x"), _s("n_nationkey")).alias("guid"), F.concat(F.lit("x"), _s(1 - F.col("n_nationkey"))).alias("parent"), F.col("n_name").alias("name"))
    return readers.folder_paths(chain.unionByName(cycle))


@query("native_library_copy", f"WITH {PUBLICATIONS_SQL} SELECT guid, title, '' AS citekey, CAST(NULL AS VARCHAR) AS pdf FROM p")
def native_library_copy(spark, sf):
    """A library exported without pointers to files, and read again with blank keys."""
    path = working_folder(spark, "library")
    writers.export_library(publications(spark, sf).select("guid", "title", F.col("guid").alias("citekey"), F.concat(F.lit("/tmp/"), "guid").alias("pdf")), path)
    return readers.read_library(spark, path).select("guid", "title", "citekey", "pdf")


# -- sources and directories ----------------------------------------------------------------------------


@query("url_match", "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN p_name || ' found' ELSE p_name END AS title, CASE WHEN p_partkey % 4 IN (0, 1) THEN CAST(1990 + p_partkey % 30 AS VARCHAR) END AS year, 'k' AS citekey FROM part")
def url_match(spark, sf):
    """Records completed from the pages that they link to; word-processor and empty links are refused."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    link = F.when(k % 4 < 2, F.concat(F.lit("http://x.org/"), _s(k))).when(k % 4 == 2, F.concat(F.lit("http://x.org/"), _s(k), F.lit(".doc")))
    records = p.select(_s(k).alias("guid"), link.alias("linkout"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("year"), F.lit("k").alias("citekey"))
    html = _filled('<meta name="citation_title" content="{name} found"><meta name="citation_date" content="{year}/01">', name="p_name", year=k % 30 + 1990)
    pages = p.where("p_partkey % 4 < 3").select(link.alias("url"), html.alias("html"))
    return lifecycle.url_match(records, pages).select(F.col("guid").cast("long").alias("p_partkey"), "title", "year", "citekey")


@query("provider_page", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'hot') ORDER BY 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') LIMIT 20 OFFSET 20")
def provider_page(spark, sf):
    """The second page of a provider's answers, with as many records as its pages hold."""
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), F.lpad(_s("p_partkey"), 9, "0")).alias("guid"), "p_partkey", F.col("p_name").alias("title"))
    source = plugin("source", "provider")(spark, "ACM", p, {"title": F.col("title")}, query="hot")
    source.connect()
    return source.page(source.limit).select("p_partkey", F.col("title").alias("p_name"))


@query("library_pages", f"WITH {PUBLICATIONS_SQL} SELECT guid, n_chars FROM p WHERE NOT trashed ORDER BY n_chars DESC, guid LIMIT 30 OFFSET 5")
def library_pages(spark, sf):
    """A library's page is sorted as long as there are not more records than a limit that a caller may set."""
    source = plugin("source", "db")(spark, publications(spark, sf), {"title": F.col("title")}, sort_limit=10**9)
    source.order = (("n_chars", True), ("guid", False))
    return source.page(5, 30).select("guid", "n_chars")


def _touched(names_: DataFrame, folder: str) -> None:
    """Small files with the given names below a folder that all executors share; each task makes those of its rows."""

    def make(batches):
        store, at = datasource._store(folder)
        made = set()
        for batch in batches:
            for n in batch.column(0).to_pylist():
                file = f"{at.rstrip('/')}/{n}"
                if (parent := file.rpartition("/")[0]) not in made:
                    store.create_dir(parent, recursive=True)
                    made = made | {parent} if len(made) < 1000 else {parent}
                with store.open_output_stream(file) as out:
                    out.write(b"%PDF")
            yield batch

    names_.mapInArrow(make, names_.schema).write.format("noop").mode("overwrite").save()


#: A file name for each supplier: three that end in .pdf, two of them below a folder, then others.
_FILE_SQL = "CASE s_suppkey % 6 WHEN 0 THEN s_name || '.pdf' WHEN 1 THEN 'deep/er/' || s_name || '.PDF' WHEN 2 THEN 'deep/' || s_name || '.Pdf' WHEN 3 THEN s_name || '.pdf.zip' WHEN 4 THEN '.' || s_name || '.pdf' ELSE s_name || '.dir/x' END"


def _supplier_files(spark, sf, what: str) -> str:
    path = working_folder(spark, what)
    _touched(table(spark, sf, "supplier").select(F.expr(_FILE_SQL).alias("f")).repartition(spark.sparkContext.defaultParallelism), path)
    return path


@query(
    "directory",
    f"""WITH f AS (SELECT {_FILE_SQL} AS f FROM supplier), d AS (SELECT DISTINCT CASE WHEN contains(f, '/') THEN 'DIR' ELSE 'FILE' END AS type, split_part(f, '/', 1) AS name FROM f)
        SELECT type, name, CAST(row_number() OVER (ORDER BY type, name) AS INTEGER) AS place FROM d WHERE NOT starts_with(name, '.') AND (type = 'DIR' OR lower(name) LIKE '%.pdf')""",
)
def directory(spark, sf):
    """Folders, then files, in code-point order; hidden ones and other extensions are left out. A file for each supplier."""
    path = _supplier_files(spark, sf, "directory")
    found = readers.list_directory(spark, path, ("pdf",))
    assert not readers.file_stat(spark, f"{path}/none")["exists"] and all(readers.file_stat(spark, f"{path}/{r['name']}")["readable"] for r in found[:1])
    return spark.createDataFrame([(r["type"], r["name"], k) for k, r in enumerate(found, 1)], "type string, name string, place int")


@query("pdf_files", f"SELECT regexp_extract({_FILE_SQL}, '([^/]*)$', 1) AS name FROM supplier WHERE s_suppkey % 6 < 3")
def pdf_files(spark, sf):
    """All files of a tree whose names end in .pdf, any case; hidden ones are left out."""
    return readers.find_pdfs(spark, _supplier_files(spark, sf, "pdfs")).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


@query("watched_files", f"SELECT regexp_extract({_FILE_SQL}, '([^/]*)$', 1) AS name FROM supplier WHERE s_suppkey % 6 < 3")
def watched_files(spark, sf):
    """Files of a folder as a stream."""
    return drained(feeds.watched_files(spark, _supplier_files(spark, sf, "watched"), "*.[pP][dD][fF]")).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


@query("limited_search", "SELECT count(*) AS total FROM part WHERE list_contains(string_split(p_name, ' '), 'gear')")
def limited_search(spark, sf):
    """A search under the limits of an online one: its answer comes in time."""
    p = table(spark, sf, "part")
    total = limited(spark, lambda: search.search(p, "gear", {"name": F.col("p_name")}).count(), lifecycle.SEARCH_WARN * 4, lifecycle.SEARCH_END * 4)
    return spark.createDataFrame([(total,)], "total long")


@query("enough_typed", "SELECT p_partkey, length(replace(t, ' ', '')) >= 3 OR t = '' AS enough FROM (SELECT p_partkey, substr(p_name, 1, CAST(p_partkey % 6 AS INTEGER)) AS t FROM part)")
def enough_typed(spark, sf):
    """Whether what was typed so far is long enough to search for."""
    return table(spark, sf, "part").select("p_partkey", lifecycle.enough_typed(F.substr("p_name", F.lit(1), (F.col("p_partkey") % 6).cast("int"))).alias("enough"))


# -- sinks ------------------------------------------------------------------------------------------------


def _records(spark, sf) -> DataFrame:
    p = spread(table(spark, sf, "part"))
    return p.select(
        "p_partkey", F.lit("ARTICLE").alias("pubtype"), F.concat(F.lit("k"), _s("p_partkey")).alias("citekey"), F.concat("p_name", F.lit(" and "), "p_type", F.lit(" <i>in</i> words that go on until a line must end, "), "p_brand").alias("title"),
        F.concat(F.lit("Roe, "), "p_brand").alias("authors"), F.lit("Journal").alias("journal"), _s("p_size").alias("volume"), (F.col("p_partkey") % 100 + 1900).cast("string").alias("year"), F.lit("").alias("linkout"),
    )


#: Words packed into lines of 70: each is put behind the last line, or begins a new one.
_WRAP = "list_reduce(string_split({0}, ' '), lambda a, w: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) <= 70 THEN a || ' ' || w ELSE a || chr(10) || w END)"
_TITLE = "p_name || ' and ' || p_type || ' in words that go on until a line must end, ' || p_brand"


@query("citations_wrapped", f"SELECT p_partkey, {_WRAP.format(_TITLE)} || chr(10) || 'Roe, ' || p_brand || chr(10) || 'Journal ' || p_size || ', ' || (1900 + p_partkey % 100) AS text FROM part")
def citations_wrapped(spark, sf):
    """Citations with lines of at most 70 characters."""
    r = _records(spark, sf)
    return r.select("p_partkey", writers.wrapped(writers.citation_text(r)).alias("text"))


@query("sink_formats", "SELECT 'k' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'ris' ELSE 'bibtex' END AS format FROM part")
def sink_formats(spark, sf):
    """Text files written by sinks of two names, told apart by their contents."""
    r = _records(spark, sf).withColumn("title", F.col("citekey"))
    out = None
    for k, name in enumerate(("RIS", "Bibtex")):
        path = working_folder(spark, "sink")
        plugin("sink", "file")(r.where(F.col("p_partkey") % 2 == k), {"out_format": name, "path": path}).write()
        assert formats.guess_format(spark, path).name == name.upper()
        part = formats.read_any(spark, path).select(F.col("title").alias("key"), F.lit(name.lower()).alias("format"))
        out = part if out is None else out.unionByName(part)
    return out


@query("text_of_records", "SELECT string_agg('TY  - JOUR' || chr(10) || 'TI  - ' || r_name || chr(10) || 'ER  - ' || chr(10), chr(10) ORDER BY r_name) AS text FROM region")
def text_of_records(spark, sf):
    """A few records in memory as one string."""
    rows = [{"title": r["r_name"], "pubtype": "ARTICLE"} for r in table(spark, sf, "region").orderBy("r_name").collect()]
    return spark.createDataFrame([(writers.write_string(rows, "title string, pubtype string", "ris", spark),)], "text string")


@query("citation_style", "SELECT p_partkey, 'Roe, B. & Doe, J. K. ' || p_name || '. Journal ' || p_size || ', 1-9 (' || (1900 + p_partkey % 100) || ').' AS text FROM part")
def citation_style(spark, sf):
    """A citation in a named style."""
    r = _records(spark, sf).withColumns({"title": F.regexp_extract("title", "^(.*?) and ", 1), "authors": F.lit("Roe, Bob and Doe, Jane Kim"), "pages": F.lit("1-9")})
    return r.select("p_partkey", writers.styled_citation(r, "nature").alias("text"))


#: Values of a record's fields, for both formats.
_WHOLE = {
    "pubtype": "ARTICLE", "citekey": "k{k}", "title": "On {name}", "authors": "Roe, B. and van der Doe, J.", "editors": "Ed, E.", "booktitle": "Book {k}", "series": "S {k}", "journal": "J {name}", "publisher": "P {k}", "address": "A {k}",
    "edition": "{k}", "chapter": "{k}", "volume": "{k}", "issue": "7", "pages": "{k}-{k}9", "year": "1999", "month": "May", "day": "3", "note": "N {k}", "doi": "10.1000/x{k}", "url": "http://x.org/{k}", "annote": "C {name}",
    "organization": "O {k}", "school": "U {k}", "howpublished": "H {k}", "number": "4", "pmid": "{k}", "abstract": "{name} {k}", "affiliation": "F {k}", "eprint": "e{k}", "issn": "1234-5678", "isbn": "0-1{k}", "lccn": "l{k}", "keywords": "a;b {k}",
}
_RIS_WHOLE = {f: v for f, v in _WHOLE.items() if f in ("title", "journal", "booktitle", "series", "volume", "issue", "publisher", "address", "issn", "doi", "url", "abstract", "keywords", "pages", "year", "month", "day", "editors", "pubtype")} | {"authors": "Roe, B. and Doe, J."}


def _whole(spark, sf, fields: dict) -> DataFrame:
    return spread(table(spark, sf, "part")).select("p_partkey", *(_filled(v, k=F.col("p_partkey") + 1, name="p_name").alias(f) for f, v in fields.items()))


@query("bibtex_whole_records", "SELECT " + ", ".join(f"{_filled_sql(v, k='(p_partkey + 1)', name='p_name')} AS {f}" for f, v in _WHOLE.items()) + " FROM part")
def bibtex_whole_records(spark, sf):
    """Records with every field written with all options on, and parsed again."""
    r = _whole(spark, sf, _WHOLE)
    text_ = writers.bibtex_entry(r, fields=dict.fromkeys(writers.EXPORT_FIELDS, 1))
    return readers.parse_files(r.select(F.lit("x").alias("path"), text_.alias("content")), bibtex.read_bibtex).select(*_WHOLE)


@query("ris_whole_records", "SELECT " + ", ".join(f"{_filled_sql(v, k='(p_partkey + 1)', name='p_name')} AS {f}" for f, v in _RIS_WHOLE.items()) + " FROM part")
def ris_whole_records(spark, sf):
    r = _whole(spark, sf, _RIS_WHOLE)
    return readers.parse_files(r.select(F.lit("x").alias("path"), writers.ris_entry(r).alias("content")), ris.read_ris).select(*_RIS_WHOLE)


# -- names, markup, dates, tables --------------------------------------------------------------------------

#: Name forms with first, von, last and junior parts.
_NAMES = (
    ("{a} {b}", "{a}", None, "{b}", None), ("{b}, {a}", "{a}", None, "{b}", None), ("{a} van der {b}", "{a}", "van der", "{b}", None), ("van der {b}, Jr, {a} K.", "{a} K.", "van der", "{b}", "Jr"),
    ("{{a} and {b} Inc}", None, None, "{a} and {b} Inc", None), ("{a} K. {b}", "{a} K.", None, "{b}", None), ("de la {b}, {a}", "{a}", "de la", "{b}", None),
)
_AB = {"a": "upper(substr(p_brand, 1, 1)) || lower(replace(substr(p_brand, 2), '#', ''))", "b": "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))"}


def _ab() -> dict[str, Column]:
    return {"a": F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lower(F.replace(F.substring("p_brand", 2, 99), F.lit("#"), F.lit("")))), "b": F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 99)))}


@query("split_names", "SELECT p_partkey, " + ", ".join(f"{_cases('p_partkey', _NAMES, lambda x, k=k: _filled_sql(x[k], **_AB))} AS {c}" for k, c in ((1, "first"), (2, "von"), (3, "last"), (4, "jr"))) + " FROM part")
def split_names(spark, sf):
    """Names in seven forms by their four parts."""
    return table(spark, sf, "part").select("p_partkey", names.name_parts(_case("p_partkey", _NAMES, lambda x: _filled(x[0], **_ab()))).alias("n")).select("p_partkey", "n.*")


@query("freestyle_names", f"SELECT p_partkey, {_cases('p_partkey', (('{b}, {a}',), ('van der {b}, {a}',), ('{b}, {a} K.',)), lambda x: _filled_sql(x[0], **_AB))} AS name FROM part")
def freestyle_names(spark, sf):
    """Names as pages write them, in one form."""
    @F.pandas_udf("string")
    def one(column: pd.Series) -> pd.Series:
        return column.map(names.freestyle_bibtex)

    return table(spark, sf, "part").select("p_partkey", one(_case("p_partkey", ("{a} {b}", "{a} van der {b}", "{a} K. {b}"), lambda x: _filled(x, **_ab()))).alias("name"))


_MARKUP = (("\\emph{{a}} x", "<i>{a}</i> x"), ("\\textbf{{a}} \\textit{{b}}", "<b>{a}</b> <i>{b}</i>"), ("H\\textsubscript{{a}}\\textsuperscript{{b}}", "H<sub>{a}</sub><sup>{b}</sup>"), ("plain {a}", "plain {a}"))


@query("tex_markup", f"SELECT p_partkey, {_cases('p_partkey', _MARKUP, lambda x: _filled_sql(x[1], **_AB))} AS html FROM part")
def tex_markup(spark, sf):
    return table(spark, sf, "part").select("p_partkey", structured.tex_to_html(_case("p_partkey", _MARKUP, lambda x: _filled(x[0], **_ab()))).alias("html"))


_ACCENTS = (('{a}\\"{u}ber', "{a}über"), ("Gr\\\"o{\\ss}e {a}", "Größe {a}"), ("{\\'e}t\\'e {a}", "été {a}"), ("\\v{c}{a}", "č{a}"), ("{a} \\o re", "{a} øre"), ("\\~n{a}", "ñ{a}"))


@query("tex_accents", f"SELECT p_partkey, {_cases('p_partkey', _ACCENTS, lambda x: _filled_sql(x[1], **_AB))} AS text FROM part")
def tex_accents(spark, sf):
    """Accents and letters that TeX writes as commands."""
    @F.pandas_udf("string")
    def one(column: pd.Series) -> pd.Series:
        return column.map(bibtex.decode_tex)

    return table(spark, sf, "part").select("p_partkey", one(_case("p_partkey", _ACCENTS, lambda x: _filled(x[0], **_ab()))).alias("text"))


@query("job_durations", "SELECT user_id AS jobid, count(*) AS n, CASE WHEN arg_max(event_type, ts) IN ('purchase', 'signup') THEN greatest(CAST(floor(epoch(max(ts) FILTER (event_type IN ('purchase', 'signup')))) - floor(epoch(max(ts) FILTER (event_type = 'view'))) AS BIGINT), 1) END AS duration FROM events GROUP BY user_id")
def job_durations(spark, sf):
    """Seconds from the last start of a job to its last end, one at least, for jobs that are over."""
    status = F.when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "signup", "ERROR").otherwise("PAUSED")
    e = table(spark, sf, "events").select(F.col("user_id").alias("jobid"), F.lit("PDF_IMPORT").alias("type"), status.alias("status"), F.col("ts").alias("at"))
    return feeds.job_states(e).join(e.groupBy("jobid").agg(F.count(F.lit(1)).alias("n")), "jobid").select("jobid", "n", "duration")


@query("reads_counted", "SELECT user_id, count(*) + 3 AS times_read, max(ts) AS last_read FROM events GROUP BY user_id UNION ALL SELECT -1, 3, TIMESTAMP '2001-01-01'")
def reads_counted(spark, sf):
    """How often and when records were read last, after the events."""
    e = table(spark, sf, "events")
    old = e.select(_s("user_id").alias("guid")).distinct().unionByName(spark.createDataFrame([("-1",)], "guid string"))
    old = old.withColumns({"times_read": F.lit(3), "last_read": F.lit("2001-01-01 00:00:00").cast(e.schema["ts"].dataType)})
    out = library.mark_read(old, e.select(_s("user_id").alias("guid"), F.col("ts").alias("at")))
    return out.select(F.col("guid").cast("long").alias("user_id"), F.col("times_read").cast("long").alias("times_read"), "last_read")


@query("seconds_ago", "SELECT event_id, CAST(epoch(TIMESTAMP '2024-07-01 12:00:00') - floor(epoch(ts)) - CASE WHEN ts < TIMESTAMP '2024-03-31 01:00:00' THEN 3600 ELSE 7200 END AS BIGINT) AS seconds FROM events")
def seconds_ago(spark, sf):
    """Seconds from a time in UTC to one on a clock in Vienna, in winter and in summer."""
    now = F.lit("2024-07-01 12:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", text.seconds_ago(F.col("ts").cast("timestamp"), now, "Europe/Vienna").alias("seconds"))


@query("change_counter", "SELECT s_name AS guid, row_number() OVER (ORDER BY s_name) AS place FROM supplier")
def change_counter(spark, sf):
    """A log's counter grows in the order of changes; here the order that it gives."""
    from pyspark.sql.window import Window

    log = library.numbered(table(spark, sf, "supplier").select(F.col("s_name").alias("guid"), F.lit("INSERT").alias("type")), [F.col("guid")])
    return log.select("guid", F.row_number().over(Window.orderBy("counter")).cast("long").alias("place"))


@query("schema_migration", "SELECT s_suppkey, upper(s_name) AS title, s_nationkey + 1 AS n FROM supplier")
def schema_migration(spark, sf):
    """A table taken from version 1 to version 4 step by step."""
    steps = {1: lambda t: t.withColumnRenamed("s_name", "title"), 2: lambda t: t.withColumn("title", F.upper("title")), 3: lambda t: t.withColumn("n", F.col("s_nationkey") + 1).drop("s_nationkey", "s_acctbal")}
    return library.migrated(table(spark, sf, "supplier"), 1, 4, steps)


@query("variance_by_flag", "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
def variance_by_flag(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.var_samp("l_quantity"), 6).alias("v"))


@query("box_text", "SELECT l_returnflag, printf('%.2f', l_quantity / 3) AS t, count(*) AS n FROM lineitem GROUP BY ALL")
def box_text(spark, sf):
    """Coordinates as text with two decimals."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag", layouts.box_text(F.col("l_quantity") / 3).alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("listed_values", "SELECT p_brand, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') GROUP BY p_brand")
def listed_values(spark, sf):
    """Membership in a list of values."""
    return table(spark, sf, "part").where(F.array_contains(F.array(F.lit("ECONOMY"), F.lit("STANDARD")), F.col("p_type"))).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("redirects", "SELECT event_id, event_type IN ('view', 'click') AS allowed FROM events")
def redirects(spark, sf):
    """Requests that change something are not sent again elsewhere."""
    method = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "HEAD").otherwise("Post")
    return table(spark, sf, "events").select("event_id", webpages.redirect_allowed(method).alias("allowed"))


@query("jobs_by_type", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'search' ELSE 'update' END AS did FROM events WHERE event_type = 'view'")
def jobs_by_type(spark, sf):
    """Pending jobs, each by the handler of its type."""
    kind = F.element_at(F.array(*map(F.lit, feeds.JOB_TYPES)), (F.col("event_id") % 3 + 1).cast("int"))
    jobs = table(spark, sf, "events").select("event_id", kind.alias("type"), F.when(F.col("event_type") == "view", "PENDING").otherwise("DONE").alias("status"))
    did = lambda what: lambda df: df.select("event_id", F.lit(what).alias("did"))
    return feeds.dispatched(jobs, dict(zip(feeds.JOB_TYPES, map(did, ("import", "search", "update")), strict=True)))


@query(
    "authors_reconciled",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Roe, Jane ' || s_name || ' and Doe, J.' WHEN 1 THEN 'Roe, J. and Doe, J.' ELSE 'Roe, J. K. and Doe, John' END AS authors FROM supplier""",
)
def authors_reconciled(spark, sf):
    """Given names from a page's list where both lists have as many names."""
    k = F.col("s_suppkey") % 3
    known = F.when(k == 2, "Roe, J. K. and Doe, J.").otherwise("Roe, J. and Doe, J.")
    shown = F.when(k == 0, F.array(F.concat(F.lit("Jane "), "s_name", F.lit(" Roe")), F.lit("J. Doe"))).when(k == 1, F.array(F.lit("Jane Roe"))).otherwise(F.array(F.lit("J.K. Roe"), F.lit("John Doe")))
    return table(spark, sf, "supplier").select("s_suppkey", matching.reconciled_authors(known, shown).alias("authors"))


#: All columns that a keyword query may name, each bound to something of the documents.
def _bound() -> tuple[dict, dict]:
    d = lambda c: F.col(c)
    fields = {"text": d("text"), "abstract": d("text"), "notes": d("text"), "title": d("title"), "author": d("journal"), "year": F.concat(F.lit("y"), _s(d("n_chars") % 10)), "journal": d("journal"), "keyword": d("labels")}
    return fields, {"guid": d("guid"), "key": F.concat(F.lit("k"), _s(d("doc_id") % 7)), "folderid": F.concat(F.lit("F"), _s(d("doc_id") % 5)), "labelid": d("labels")}


@query(
    "search_every_field",
    f"""WITH {PUBLICATIONS_SQL} SELECT doc_id FROM p WHERE NOT trashed AND labels IN ('en', 'fr') AND doc_id % 5 = 2 AND journal <> 'src1' AND regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])the($|[^\\p{{L}}\\p{{N}}])')
        UNION ALL SELECT doc_id FROM p WHERE labels = 'en' AND doc_id % 7 = 3 AND n_chars % 10 = 4 UNION ALL SELECT doc_id FROM p WHERE guid = 'G21' AND doc_id % 7 = 0""",
)
def search_every_field(spark, sf):
    """Queries that name key, folder, label, year, keyword, author, abstract and guid."""
    fields, ids = _bound()
    p = publications(spark, sf)
    found = search.search(p.where("labels in ('en', 'fr') and journal <> 'src1'"), "folderid:F2 abstract:the", fields, ids, False)
    more = search.search(p, "keyword:en key:k3 year:y4", fields, ids)
    return found.select("doc_id").unionByName(more.select("doc_id")).unionByName(search.search(p, "guid:G21 key:k0", fields, ids).select("doc_id"))


# -- pages ------------------------------------------------------------------------------------------------

_WHO = {"authors": "Roe, Jane and Doe, John"}
#: Address, page, and the record that it gives.
_PAGES = (
    ("http://www.thelancet.com/{k}", '<h1>{name}</h1><a class="ja50-ce-author">Jane Roe</a><a class="ja50-ce-author">John Doe</a><div id="article_cite">The Lancet, Volume {k}, Issue 97, Pages 8 - 9, 5 March 2011</div><div id="article_DOI">doi:10.1016/{k} Cite or Link</div><div class="ja50-ce-abstract-section">On {name}</div>',
     _WHO | {"pubtype": "ARTICLE", "title": "{name}", "journal": "The Lancet", "volume": "{k}", "issue": "97", "pages": "8-9", "year": "2011", "doi": "10.1016/{k}", "abstract": "On {name}"}),
    ("http://www.emeraldinsight.com/{k}", '<div class="toc">Title: {name} Author(s): Jane Roe, John Doe Journal: J {k} Year: 2009 Volume: 3 Issue: 2 Page: 5 - 9 DOI: 10.1/{k} Publisher: Emerald</div>',
     _WHO | {"pubtype": "ARTICLE", "title": "{name}", "journal": "J {k}", "volume": "3", "issue": "2", "pages": "5-9", "year": "2009", "doi": "10.1/{k}", "publisher": "Emerald"}),
    ("http://www.dovepress.com/{k}", '<div id="breadcrumb">Journal: Dove {k}</div><span class="allowEm"></span><h1>{name}</h1><h3>Volume 2010:{k}</h3><p>Jane Roe1, John Doe2</p><p>Place</p><p>On {name}</p><p>Keywords: x</p>',
     _WHO | {"pubtype": "ARTICLE", "title": "{name}", "journal": "Dove {k}", "volume": "{k}", "year": "2010", "abstract": "On {name}"}),
    ("http://books.google.com/books?id={k}", '<td class="metadata_label">Title</td><td class="metadata_value">{name}</td><td class="metadata_label">Authors</td><td class="metadata_value">Jane Roe, John Doe</td><td class="metadata_label">Publisher</td><td class="metadata_value">Press {k}, 2004</td><td class="metadata_label">Length</td><td class="metadata_value">320 pages</td>',
     _WHO | {"pubtype": "BOOK", "title": "{name}", "publisher": "Press {k}", "year": "2004", "pages": "320"}),
    ("http://www.sciencedirect.com/{k}", '<div class="artiHead">J {k} Volume 4, Issues 1-2, 15 May 2009, Pages 7-19</div><div class="articleTitle">{name}</div><a target="doilink">doi:10.1016/{k}</a><div class="articleText_indent">Abstract On {name}</div><div id="authorsAnchors">Jane Roe and John Doe, a</div>',
     _WHO | {"pubtype": "ARTICLE", "title": "{name}", "journal": "J {k}", "volume": "4", "issue": "1-2", "pages": "7-19", "month": "May", "year": "2009", "doi": "10.1016/{k}", "abstract": "On {name}"}),
    ("http://www.nature.com/{k}", '<meta name="citation_title" content="{name}"><div id="abs"><a href="#top">Top of page</a><h2>Abstract</h2><p>On <i>{name}</i></p></div>', {"pubtype": "MISC", "title": "{name}", "abstract": "On {name}"}),
    ("http://www.nature.com/doifinder/10.{k}", '<meta name="citation_title" content="{name}">', {"error": "UnknownSiteError"}),
    ("http://www.landesbioscience.com/{k}", '<meta name="citation_title" content="{name}"><b>DOI: 10.4161/cc.{k}</b>', {"pubtype": "MISC", "title": "{name}", "doi": "10.4161/cc.{k}"}),
    ("http://ieeexplore.ieee.org/{k}", '<meta name="citation_title" content="{name}"><meta name="citation_journal_title" content="J {k}"><div class="abstract"><h2>Abstract</h2> On {name}</div>', {"pubtype": "ARTICLE", "title": "{name}", "journal": "J {k}", "abstract": "On {name}"}),
    ("http://www.springerlink.com/{k}", '<meta name="dc.title" content="{name}"><p class="authors">Jane Roe and John Doe</p>', _WHO | {"pubtype": "MISC", "title": "{name}"}),
    ("http://x.org/{k}", "<pre>@article{key{k}, title={{name}}, year=1999, journal={J {k}}}</pre>", {"pubtype": "ARTICLE", "title": "{name}", "year": "1999", "journal": "J {k}"}),
    ("http://x.org/r{k}", "TY  - JOUR\nTI  - {name}\nVL  - {k}\nER  - \n", {"pubtype": "ARTICLE", "title": "{name}", "volume": "{k}"}),
    ("http://x.org/m{k}", '<meta name="citation_title" content="{name}"><meta name="citation_author" content="Jane Roe"><meta name="citation_author" content="Doe, John"><meta name="citation_firstpage" content="3"><meta name="citation_lastpage" content="9"><meta name="citation_date" content="2010/05/01"><meta name="citation_doi" content="doi:10.1000/x.{k}">',
     _WHO | {"pubtype": "MISC", "title": "{name}", "pages": "3-9", "year": "2010", "doi": "10.1000/x.{k}"}),
    ("http://x.org/n{k}", "<p>{name}</p>", {"error": "UnknownSiteError"}),
    ("http://x.org/{k}.doc", '<meta name="citation_title" content="{name}">', {"error": "UnknownSiteError"}),
)
_PAGE_FIELDS = ("pubtype", "title", "authors", "journal", "volume", "issue", "pages", "month", "year", "doi", "publisher", "abstract", "error")


@query("site_records", "SELECT p_partkey, " + ", ".join(f"{_cases('p_partkey', _PAGES, lambda x, f=f: _filled_sql(x[2].get(f), **_PART))} AS {f}" for f in _PAGE_FIELDS) + " FROM part")
def site_records(spark, sf):
    """Records from pages of the known sites, from embedded texts and meta tags, and the errors of pages without one."""
    values = {"k": "p_partkey", "name": "p_name"}
    pages = spread(table(spark, sf, "part")).select("p_partkey", _case("p_partkey", _PAGES, lambda x: _filled(x[0], **values)).alias("url"), _case("p_partkey", _PAGES, lambda x: _filled(x[1], **values)).alias("html"))
    return webpages.extract_records(pages, key="p_partkey").select("p_partkey", *_PAGE_FIELDS)


#: Pages that want more, what is loaded for them, and the record's title, volume and pages.
_LINKED = (
    ("http://iopscience.iop.org/{k}/2/", '<meta name="citation_title" content="T">', "http://iopscience.iop.org/export?articleId={k}/2&exportFormat=iopexport_bib&exportType=abs", "@article{k, title={{name}}, volume={{k}}}", ("{name}", "{k}", None)),
    ("http://la-press.com/{k}", '<a class="endnote" href="exp.php?id={k}">e</a><div class="journalListingAuthor">J 2010:4 5-9</div>', "http://la-press.com/exp.php?id={k}", "TY  - JOUR\nTI  - {name}\nVL  - 99\nER  - \n", ("{name}", "4", "5-9")),
    ("http://onlinelibrary.wiley.com/{k}", '<a href="/documentcitationdownload?a={k}&amp;b=2">c</a>', "http://onlinelibrary.wiley.com/documentcitationdownload?a={k}&b=2", "TY  - JOUR\nTI  - {name}\nVL  - {k}\nER  - \n", ("{name}", "{k}", None)),
    ("http://x.org/f{k}", '<frameset><frame src="m.html"><frame src="http://x.org/frame{k}"></frameset>', "http://x.org/frame{k}", '<meta name="citation_title" content="{name}">', ("{name}", None, None)),
    ("http://x.org/p{k}", '<meta name="citation_title" content="Short"><meta name="citation_pmid" content="{k}">', "http://x.org/unused{k}", "", ("{name} whole", "7", None)),
    ("http://lww.com/{k}", '<a href="http://lww.com/export/{k}">x</a>', "http://lww.com/none{k}", "", (None, None, None)),
)


@query("linked_records", "SELECT p_partkey, " + ", ".join(f"{_cases('p_partkey', _LINKED, lambda x, k=k: _filled_sql(x[4][k], **_PART))} AS {c}" for k, c in enumerate(("title", "volume", "pages"))) + " FROM part")
def linked_records(spark, sf):
    """Records completed from a site's export, from frames, and from a provider's record of the same number."""
    p, values = spread(table(spark, sf, "part")), {"k": "p_partkey", "name": "p_name"}
    of = lambda k: _case("p_partkey", _LINKED, lambda x: _filled(x[k], **values))
    linked = p.select(of(2).alias("url"), of(3).alias("html"))
    pubmed = p.select(_s("p_partkey").alias("pmid"), F.concat("p_name", F.lit(" whole")).alias("title"), F.lit("7").alias("volume"))
    return webpages.extract_records(p.select("p_partkey", of(0).alias("url"), of(1).alias("html")), key="p_partkey", linked=linked, pubmed=pubmed).select("p_partkey", "title", "volume", "pages")


@query("embedded_entries", "SELECT p_partkey, '@ARTICLE{k' || p_partkey || ', title={' || p_name || ' {in {braces}}}, year=1999}' AS entry FROM part")
def embedded_entries(spark, sf):
    """The entry in a page's text, to the brace that closes it."""
    @F.pandas_udf("string")
    def one(column: pd.Series) -> pd.Series:
        return column.map(bibtex.balanced_entry)

    return table(spark, sf, "part").select("p_partkey", one(_filled("<p>{x}</p><pre>@ARTICLE{k{k}, title={{name} {in {braces}}}, year=1999}</pre> } more", k="p_partkey", name="p_name")).alias("entry"))


# -- layouts ----------------------------------------------------------------------------------------------

_LINES = """n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem),
       ln AS (SELECT l_orderkey AS doc, pos, 'line ' || l_partkey || CASE WHEN l_returnflag = 'A' THEN ' www.nature.com' ELSE '' END || CASE WHEN l_partkey % 50 = 0 THEN ' RESEARCH ARTICLES' ELSE '' END AS content,
         CASE l_suppkey % 4 WHEN 0 THEN 24 WHEN 1 THEN 18 WHEN 2 THEN 10 ELSE 11 END AS fs, l_quantity * 3 AS xmin, l_quantity * 3 + 60 + l_partkey % 90 AS xmax, pos * 15 + l_partkey % 40 AS ymin,
         l_partkey % 11 = 0 AS bad, l_partkey % 5 = 0 AS common, l_partkey % 13 = 0 AS address FROM n)"""


def _line_table(spark, sf) -> DataFrame:
    from pyspark.sql.window import Window

    n = table(spark, sf, "lineitem").withColumn("position", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1)
    p, s = F.col("l_partkey"), F.col("l_suppkey") % 4
    flag = lambda m: (p % m == 0).cast("int")
    content = F.concat(F.lit("line "), _s(p), F.when(F.col("l_returnflag") == "A", " www.nature.com").otherwise(""), F.when(p % 50 == 0, " RESEARCH ARTICLES").otherwise(""))
    return n.select(
        _s("l_orderkey").alias("doc"), "position", content.alias("content"), F.when(s == 0, 24.0).when(s == 1, 18.0).when(s == 2, 10.0).otherwise(11.0).alias("fs"), (F.col("l_quantity") * 3).alias("xmin"),
        (F.col("l_quantity") * 3 + 60 + p % 90).alias("xmax"), (F.col("position") * 15 + p % 40).cast("double").alias("ymin"), flag(11).alias("nr_bad_words"), F.lit(0).alias("nr_bad_author_words"), flag(5).alias("nr_common_words"), flag(13).alias("address_count"),
    )


@query(
    "titles_by_fonts",
    f"""WITH {_LINES}, signed AS (SELECT doc FROM ln GROUP BY doc HAVING bool_or(contains(content, 'www.nature.com'))),
       pair AS (SELECT * FROM (VALUES (1, 24, 11), (2, 24, 10), (3, 18, 11), (4, 18, 10)) v(k, tf, af)),
       head AS (SELECT doc, k, af, min(xmin) AS x0, max(xmax) AS x1, max(pos) AS last, arg_max(ymin, pos) AS top, string_agg(content, ' ' ORDER BY pos) AS title
                FROM ln JOIN signed USING (doc) JOIN pair ON fs = tf WHERE NOT contains(content, 'ARTICLES') GROUP BY ALL),
       below AS (SELECT h.*, pos, content, ymin, bad, common, address, xmin > x0 - 20 AND xmax < x1 + 100 AND length(content) >= 5 AS inside FROM head h JOIN ln USING (doc) WHERE fs = af AND xmax >= x0 AND xmin <= x1 AND ymin >= top),
       stop AS (SELECT doc, k, pos FROM below WHERE ymin - top > 300
                UNION ALL SELECT doc, k, pos FROM below WHERE inside AND (bad OR address OR (common AND pos > last + 1))
                UNION ALL SELECT doc, k, pos FROM (SELECT doc, k, pos, ymin - lag(ymin) OVER (PARTITION BY doc, k ORDER BY pos) AS gap FROM below WHERE inside) WHERE gap > 30),
       block AS (SELECT b.doc, b.k, string_agg(b.content, ',' ORDER BY b.pos) AS authors FROM below b LEFT JOIN (SELECT doc, k, min(pos) AS e FROM stop GROUP BY ALL) s ON s.doc = b.doc AND s.k = b.k WHERE inside AND b.pos < coalesce(e, 1000000) GROUP BY ALL),
       both_ AS (SELECT h.doc, h.k, title, authors FROM head h LEFT JOIN block b ON b.doc = h.doc AND b.k = h.k),
       best AS (SELECT doc, coalesce(min(k) FILTER (authors IS NOT NULL), max(k)) AS k FROM both_ GROUP BY doc)
       SELECT CAST(d.doc AS VARCHAR) AS doc, title, authors FROM (SELECT DISTINCT doc FROM ln) d LEFT JOIN (SELECT doc, title, authors FROM both_ JOIN best USING (doc, k)) USING (doc)""",
)
def titles_by_fonts(spark, sf):
    """Titles and authors of documents by pairs of fonts, boxes, gaps and word lists."""
    return layouts.extract_titles(_line_table(spark, sf))


@query(
    "titles_by_layout",
    f"""WITH {_LINES}, a AS (SELECT doc, min(pos) FILTER (address) AS e FROM ln GROUP BY doc)
       SELECT CAST(doc AS VARCHAR) AS doc, string_agg(content, ' ' ORDER BY pos) FILTER (fs = 18) AS title, string_agg(content, ', ' ORDER BY pos) FILTER (fs = 11 AND pos <= coalesce(e, 1000000)) AS authors FROM ln JOIN a USING (doc) GROUP BY doc""",
)
def titles_by_layout(spark, sf):
    """One publisher's rule for all documents: one font for the title, another up to an address for the authors."""
    return layouts.extract_titles(_line_table(spark, sf), layouts={"own": layouts.Layout("^line", layouts.biopolymers)})


@query("line_features", "SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'der', 'la'))) AS nr_common_words, len(list_filter(w, lambda x: x IN ('of', 'die'))) AS nr_bad_words FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents)")
def line_features(spark, sf):
    """How many words of a text stand in each of two lists."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return layouts.word_features(d, ["of", "die"], [], ["the", "and", "der", "la"]).select("doc_id", F.col("nr_common_words").cast("long").alias("nr_common_words"), F.col("nr_bad_words").cast("long").alias("nr_bad_words"))


@query("words_in_lines", "SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_quantity AS fs, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY x) AS content, min(x) AS xmin FROM (SELECT *, l_partkey * 1000.0 + l_suppkey + l_extendedprice / 1e6 AS x FROM lineitem) GROUP BY l_orderkey, l_quantity, l_linenumber")
def words_in_lines(spark, sf):
    """Words of one size and height put together to lines, from left to right."""
    x = F.col("l_partkey") * 1000.0 + F.col("l_suppkey") + F.col("l_extendedprice") / 1e6
    words = table(spark, sf, "lineitem").select(_s("l_orderkey").alias("doc"), F.lit(1).alias("page"), _s("l_partkey").alias("word"), x.alias("xmin"), (x + 5).alias("xmax"), (F.col("l_linenumber") * 10.0 + F.col("l_partkey") % 10 / 20).alias("ymin"), F.col("l_quantity").alias("size"))
    return layouts.words_to_lines(words).select("doc", "fs", "content", "xmin")


# -- word processor ----------------------------------------------------------------------------------------

_ASKED = "<xml><documentID>D{k}</documentID><style>Numeric</style><citations><citation><item>S{k}</item><item>N{n}</item></citation><citation><item>N{n}</item></citation><citation><item>none</item><item>S{k}</item></citation></citations></xml>"


@query(
    "word_citations",
    """SELECT 'D' || s_suppkey AS document, '[1,2];[2];[3,1]' AS marks, 'S' || s_suppkey || ' N' || s_nationkey || ';N' || s_nationkey || ';none S' || s_suppkey AS ids,
       '1. Roe, J. ' || s_name || '. J. 2001;' || chr(10) || '2. ' || n_name || '. ' || (1990 + n_nationkey) || ';' || chr(10) || '3.' AS bibliography, 's' || s_suppkey || ',n' || n_nationkey AS kept
       FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def word_citations(spark, sf):
    """Citations of many documents formatted, and the records that each document then keeps, read back."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    none = F.lit(None).cast("string")
    records = s.select(F.concat(F.lit("S"), _s("s_suppkey")).alias("guid"), F.col("s_name").alias("title"), F.lit("Roe, Jane").alias("authors"), F.lit("J").alias("journal"), F.lit("2001").alias("year"), F.concat(F.lit("s"), _s("s_suppkey")).alias("citekey"))
    records = records.unionByName(n.select(F.concat(F.lit("N"), _s("n_nationkey")).alias("guid"), F.col("n_name").alias("title"), none.alias("authors"), none.alias("journal"), _s(F.col("n_nationkey") + 1990).alias("year"), F.concat(F.lit("n"), _s("n_nationkey")).alias("citekey")))
    got = wordprocessor.format_citations(s.select(_filled(_ASKED, k="s_suppkey", n="s_nationkey").alias("xml")), records)
    shape = "citations struct<citation:array<string>>, ids struct<citation:array<struct<item:array<string>>>>, bibliography string, documentLibraryString string"
    a = got.select("documentID", structured.from_xml_text(F.col("xml"), shape, "xml").alias("a"))
    again = wordprocessor.opened(a.select(F.concat(F.lit("<xml><documentID>"), "documentID", F.lit("</documentID><documentLibrary>"), "a.documentLibraryString", F.lit("</documentLibrary></xml>")).alias("xml")))
    kept = again.groupBy("documentID").agg(F.array_join(F.sort_array(F.collect_list("citekey"), asc=False), ",").alias("kept"))
    ids = F.array_join(F.transform("a.ids.citation", lambda c: F.array_join(c["item"], " ")), ";")
    return a.join(kept, "documentID").select(F.col("documentID").alias("document"), F.array_join("a.citations.citation", ";").alias("marks"), ids.alias("ids"), F.col("a.bibliography").alias("bibliography"), "kept")


@query("word_search", "SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_name AS title FROM part WHERE list_contains(string_split(p_name, ' '), 'gear') ORDER BY 1 LIMIT 15")
def word_search(spark, sf):
    """Matches for a word processor, out of the XML answer."""
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), F.lpad(_s("p_partkey"), 9, "0")).alias("guid"), F.col("p_name").alias("title"))
    xml = wordprocessor.command(spark, "search", library=p, query="gear", fields={"title": F.col("title")}, limit=15)
    return xml.select(F.explode(structured.from_xml_text(F.col("xml"), "result array<struct<id:string,title:string>>", "xml")["result"]).alias("r")).select("r.id", "r.title")


@query("word_styles", "SELECT s_suppkey, ['author-date', 'initials first', 'nature', 'numeric'][1 + s_suppkey % 4] AS style FROM supplier")
def word_styles(spark, sf):
    """Each supplier's document in one of the styles that a word processor is told of."""
    listed = structured.from_xml_text(F.lit(wordprocessor.command(spark, "list_styles").first()["xml"]), "style array<string>", "xml")["style"]
    return table(spark, sf, "supplier").select("s_suppkey", F.get(F.array_sort(listed), (F.col("s_suppkey") % 4).cast("int")).alias("style"))
