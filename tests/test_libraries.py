"""Library files of other programs: small SQLite files made here, in the layouts that the readers know."""

import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.sources import libraries, readers
from folioflow.sources.records import CanceledError, DatabaseVersionError, FileError, FolioError, NetGetError


def database(path, script, rows):
    db = sqlite3.connect(path)
    db.executescript(script)
    for table, values in rows.items():
        for v in values:
            db.execute(f"INSERT INTO {table} VALUES ({','.join('?' * len(v))})", v)
    db.commit()
    db.close()


ZOTERO = """
CREATE TABLE zoteroDummyTable (id INTEGER PRIMARY KEY);
CREATE TABLE items (itemID INTEGER PRIMARY KEY, itemTypeID INT); CREATE TABLE itemTypes (itemTypeID INTEGER PRIMARY KEY, typeName TEXT);
CREATE TABLE fields (fieldID INTEGER PRIMARY KEY, fieldName TEXT); CREATE TABLE itemDataValues (valueID INTEGER PRIMARY KEY, value); CREATE TABLE itemData (itemID INT, fieldID INT, valueID INT);
CREATE TABLE deletedItems (itemID INTEGER PRIMARY KEY); CREATE TABLE itemNotes (itemID INTEGER PRIMARY KEY, sourceItemID INT, note TEXT);
CREATE TABLE creatorData (creatorDataID INTEGER PRIMARY KEY, firstName TEXT, lastName TEXT); CREATE TABLE creators (creatorID INTEGER PRIMARY KEY, creatorDataID INT);
CREATE TABLE creatorTypes (creatorTypeID INTEGER PRIMARY KEY, creatorType TEXT); CREATE TABLE itemCreators (itemID INT, creatorID INT, creatorTypeID INT, orderIndex INT);
CREATE TABLE collections (collectionID INTEGER PRIMARY KEY, collectionName TEXT, parentCollectionID INT); CREATE TABLE collectionItems (collectionID INT, itemID INT, orderIndex INT);
"""


def zotero_file(path):
    fields = ["title", "publicationTitle", "volume", "date", "DOI", "ISBN", "url"]
    values = ["Paper one", "Journal of Things", "18", "2008-01-00 January 2008", "10.1000/x.1", "0-1234-5678-9", "http://x.org/1", "Big book", "2002-00-00 2002", "A page", "Gone"]
    data = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (1, 5, 5), (2, 1, 8), (2, 4, 9), (2, 6, 6), (3, 1, 10), (3, 7, 7), (4, 1, 11)]
    database(path, ZOTERO, {
        "itemTypes": [(1, "journalArticle"), (2, "book"), (3, "webpage"), (4, "note")], "items": [(1, 1), (2, 2), (3, 3), (4, 1), (5, 4)], "deletedItems": [(4,)],
        "fields": [(k + 1, f) for k, f in enumerate(fields)], "itemDataValues": [(k + 1, v) for k, v in enumerate(values)], "itemData": data,
        "creatorData": [(1, "Jane", "Roe"), (2, "John", "Doe"), (3, "", "Team X")], "creators": [(1, 1), (2, 2), (3, 3)], "creatorTypes": [(1, "author"), (2, "editor")],
        "itemCreators": [(1, 2, 1, 10), (1, 1, 1, 2), (2, 3, 1, 0), (2, 1, 2, 1)], "itemNotes": [(5, 1, "<p>look</p>"), (6, None, "alone")],
        "collections": [(1, "c1", None), (2, "sub", 1), (3, "subsub", 2), (4, "c2", None)], "collectionItems": [(3, 1, 0), (4, 1, 0), (1, 2, 0)],
    })


MENDELEY = """
CREATE TABLE RunsSinceLastCleanup (time INT); CREATE TABLE DocumentContributors (id INTEGER PRIMARY KEY, documentId INT, contribution TEXT, firstNames TEXT, lastName TEXT);
CREATE TABLE Documents (id INTEGER PRIMARY KEY, type TEXT, title TEXT, publication TEXT, year INT, pages TEXT, doi TEXT, city TEXT, dateAccessed TEXT, onlyReference TEXT, note TEXT);
CREATE TABLE DocumentUrls (documentId INT, position INT, url BLOB); CREATE TABLE DocumentKeywords (documentId INT, keyword TEXT); CREATE TABLE DocumentTags (documentId INT, tag TEXT);
CREATE TABLE Folders (id INTEGER PRIMARY KEY, name TEXT, parentId INT); CREATE TABLE DocumentFolders (documentId INT, folderId INT);
"""


def mendeley_file(path):
    database(path, MENDELEY, {
        "Documents": [(1, "JournalArticle", "On genes", "PLoS ONE", 2011, "e1", "10.1371/x", None, "13/03/11", "false", ""), (2, "Generic", "Guide", "Desktop", 2011, "1-16", None, "London", None, "false", "own words")],
        "DocumentContributors": [(2, 1, "DocumentAuthor", "A. B.", "Roe"), (10, 1, "DocumentAuthor", "C.", "Doe"), (1, 1, "DocumentEditor", "E.", "Ed")], "DocumentUrls": [(1, 0, b"http://x.org/2")],
        "DocumentKeywords": [(2, "manual"), (2, "how-to")], "DocumentTags": [(1, "Favorites")], "Folders": [(1, "f", -1), (2, "g", 1)], "DocumentFolders": [(2, 2)],
    })


def native_file(path):
    database(path, "CREATE TABLE Publications (rowid INTEGER PRIMARY KEY, guid TEXT, title TEXT, citekey TEXT, year TEXT, extra TEXT); CREATE TABLE Fulltext (guid TEXT);", {"Publications": [(1, "G1", "Own", "key1", "1999", "x")]})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("libraries")
    zotero_file(d / "zotero.sqlite")
    mendeley_file(d / "mendeley.sqlite")
    native_file(d / "native.db")
    database(d / "other.db", "CREATE TABLE t (x INT);", {})
    (d / "text.txt").write_text("SQL no")
    return d


def test_formats_from_files(spark, folder):
    got = {r["path"].rpartition("/")[2]: r["format"] for r in libraries.library_formats(readers.binary_files(spark, str(folder))).collect()}
    assert got == {"zotero.sqlite": "ZOTERO", "mendeley.sqlite": "MENDELEY", "native.db": "NATIVE", "other.db": None, "text.txt": None}


def test_zotero(spark, folder):
    got = {r["title"]: {k: v for k, v in r.asDict().items() if v is not None} for r in libraries.read_zotero(readers.binary_files(spark, str(folder))).drop("path", "item").collect()}
    assert got == {
        "Paper one": {"title": "Paper one", "pubtype": "ARTICLE", "journal": "Journal of Things", "volume": "18", "year": "2008", "month": "01", "doi": "10.1000/x.1", "authors": "Roe, Jane and Doe, John", "annote": "<p>look</p>", "folders_tmp": "c1/sub/subsub,c2"},
        "Big book": {"title": "Big book", "pubtype": "BOOK", "year": "2002", "isbn": "0-1234-5678-9", "authors": "Team X", "editors": "Roe, Jane", "folders_tmp": "c1"},
        "A page": {"title": "A page", "pubtype": "MISC", "howpublished": "Webpage", "linkout": "http://x.org/1"},
    }


def test_mendeley(spark, folder):
    got = {r["title"]: {k: v for k, v in r.asDict().items() if v is not None} for r in libraries.read_mendeley(readers.binary_files(spark, str(folder))).drop("path", "item").collect()}
    assert got["On genes"] == {
        "title": "On genes", "pubtype": "ARTICLE", "journal": "PLoS ONE", "year": "2011", "pages": "e1", "doi": "10.1371/x", "authors": "Roe, A. B. and Doe, C.", "editors": "Ed, E.", "linkout": "http://x.org/2", "labels": "Favorites",
        "note": 'Mendeley field "dateAccessed": 13/03/11<br />\nMendeley field "onlyReference": false<br />\n',
    }
    g = got["Guide"]
    assert (g["pubtype"], g["howpublished"], g["keywords"], g["folders_tmp"], g["annote"]) == ("MISC", "Generic", "how-to;manual", "f/g", "own words")
    assert g["note"] == 'Mendeley field "city": London<br />\nMendeley field "onlyReference": false<br />\n'


def test_all_libraries(spark, folder, tmp_path):
    got = libraries.read_libraries(spark, str(folder)).collect()
    assert sorted(r["title"] for r in got) == ["A page", "Big book", "Guide", "On genes", "Own", "Paper one"]
    own = next(r for r in got if r["title"] == "Own")
    assert (own["guid"], own["citekey"], own["year"]) == ("G1", "", "1999")
    (tmp_path / "x.txt").write_text("none")
    assert libraries.read_libraries(spark, str(tmp_path)).count() == 0


def test_deep_folders_and_cycles(spark):
    deep = [(str(k), str(k - 1) if k else None, f"n{k}") for k in range(150)] + [("a", "b", "a"), ("b", "a", "b"), ("c", "a", "c"), ("d", "gone", "d"), ("e", "ROOT", "e")]
    got = {r["guid"]: r["path"] for r in readers.folder_paths(spark.createDataFrame(deep, "guid string, parent string, name string")).collect()}
    assert got["149"] == "/".join(f"n{k}" for k in range(150)) and got["e"] == "e" and len(got) == 151
    assert readers.folder_paths(spark.createDataFrame([], "guid string, parent string, name string")).count() == 0


def test_deep_paths_are_not_written_whole(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(p.stat().st_size for p in Path(base).rglob("*.parquet"))
    names = [f"{k * 7919 % 100003:06d}" for k in range(1200)]
    before = size()
    found = readers.folder_paths(spark.createDataFrame([(k, k - 1 if k else None, names[k]) for k in range(1200)] + [(2000, 500, "side"), (2001, 2000, None), (2002, 2001, "end"), (3000, 3001, "x"), (3001, 3000, "y")], "guid long, parent long, name string"))
    written = size() - before
    got = {r["guid"]: r["path"] for r in found.collect()}
    assert len(got) == 1203 and all(got[k] == "/".join(names[: k + 1]) for k in range(1200))
    assert got[2002] == "/".join(names[:501]) + "/side/end" and got[2001] == got[2000]
    assert written < 1.5e6, written
    twice = readers.folder_paths(spark.createDataFrame([("a", None, "x"), ("a", None, "y"), ("b", "a", "z")], "guid string, parent string, name string"))
    assert sorted(r["path"] for r in twice.collect()) == ["x", "x/z", "y", "y/z"]


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>Arrivals</title><entry><title>One</title><id>urn:1</id><link rel="self" href="http://x.org/self"/><link href="http://x.org/1"/><summary>S</summary><author><name>Jane Roe</name></author><author><name>John Doe</name></author></entry>'
        "<entry><title>Two</title><id>http://x.org/2</id><content>C</content></entry></feed>"
    )
    got = sorted(readers.read_feed(spark, str(tmp_path / "a.xml")).select("feed", "title", "linkout", "abstract", "authors", "needs_details").collect())
    assert [tuple(r) for r in got] == [("Arrivals", "One", "http://x.org/1", "S", "Jane Roe and John Doe", True), ("Arrivals", "Two", "http://x.org/2", "C", None, True)]


def test_errors_tell_what_they_are_about():
    import pickle

    e = pickle.loads(pickle.dumps(NetGetError("no answer", 404)))
    assert (str(e), e.payload, e.about) == ("no answer", 404, "code") and issubclass(DatabaseVersionError, FileError)

    def below(c):
        return {c}.union(*map(below, c.__subclasses__()))

    assert len(below(FolioError)) >= 21


def test_limited(spark):
    import threading

    from folioflow.streaming.run import limited

    assert limited(spark, lambda: spark.range(10).count(), 60, 60) == 10
    with pytest.raises(ZeroDivisionError):
        limited(spark, lambda: 1 / 0, 60, 60)
    warned = []
    slow = lambda: spark.range(8).repartition(4).selectExpr("java_method('java.lang.Thread', 'sleep', 30000L)").collect()
    with pytest.raises(CanceledError):
        limited(spark, slow, 0.2, 1.5, lambda: warned.append(1))
    assert warned == [1]
    stop = threading.Event()
    stop.set()
    with pytest.raises(CanceledError):
        limited(spark, slow, 60, 60, canceled=stop)
    assert spark.range(5).where(F.col("id") > 2).count() == 2


def test_files_are_made_in_small_batches(spark, monkeypatch):
    from folioflow.plans import source_queries

    rows = spark.range(300).select(F.format_string("f%03d", "id").alias("path"), "id").coalesce(1)
    monkeypatch.setattr(source_queries, "FILE_BYTES", 1 << 16)
    files = source_queries._sqlite_files(rows, "path", lambda db, some: db.execute(f"CREATE TABLE t{some[0]['id']} (id)"))
    sizes = files.mapInArrow(lambda batches: batches, files.schema).select("path", F.length("content").alias("n"))
    assert sizes.count() == 300 and sizes.where("n > 0").count() == 300
    names = {(r["path"], r["name"]) for r in libraries.sqlite_tables(files).collect()}
    assert names == {(f"f{k:03d}", f"t{k}") for k in range(300)}
