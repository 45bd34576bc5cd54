"""Library files of other programs: SQLite files as rows, and records from them.

A file's bytes are opened in memory on the executor that has them, so any store that Spark reads will do and
each file is opened once: its tables become rows of one work table, and all joins, paths and folding are Spark's.
"""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import written
from .detect import LIBRARIES, is_sqlite, library_format
from .readers import binary_files, folder_paths
from .records import FIELDS, PUBLICATION, with_fields

#: Rows that go on at once.
ROWS = 10_000
#: What stands for the list of a file's tables.
NAMES = "*"


def _opened(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def _text(value) -> str | None:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else None if value is None else str(value)


_ROW = T.StructType([T.StructField("path", T.StringType()), T.StructField("table", T.StringType()), T.StructField("row", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])


def sqlite_rows(files: DataFrame, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """path, table and row (column to text) of the SQLite files among ``files`` (path, content), each opened once.

    wanted: columns by table; a table or column that a file lacks is absent from its rows, and one more row, of the table NAMES, has
    the names of all its tables. Without ``wanted``, each table gives one row without columns. A file that can't be read gives one row with its ``error`` beside what could be read before."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_ROW.names)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one file's bytes at a time
                path, db = path.as_py(), None
                try:
                    db = _opened(content.as_py())
                    have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                    if wanted is None:
                        if have:
                            yield batch_of([(path, name, [], None) for name in sorted(have)])
                        continue
                    yield batch_of([(path, NAMES, [(name, None) for name in sorted(have)], None)])
                    for table, columns in wanted.items():
                        if table not in have:
                            continue
                        own = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
                        some = [c for c in columns if c in own]
                        found = db.execute(f"SELECT {', '.join(some) or '1'} FROM \"{table}\"")
                        while rows := found.fetchmany(ROWS):
                            yield batch_of([(path, table, [(c, _text(v)) for c, v in zip(some, r, strict=False)], None) for r in rows])
                except sqlite3.Error as e:
                    yield batch_of([(path, None, None, str(e))])
                finally:
                    if db is not None:
                        db.close()

    return files.where(is_sqlite(F.col("content"))).select("path", "content").mapInArrow(run, _ROW)


def sqlite_tables(files: DataFrame) -> DataFrame:
    """path and name of every table of the files that are SQLite ones."""
    return sqlite_rows(files).where("error is null").select("path", F.col("table").alias("name"))


def read_errors(files: DataFrame) -> DataFrame:
    """path and error of the files that begin as SQLite ones do but can't be read."""
    return sqlite_rows(files).where("error is not null").select("path", "error")


class Tables:
    """The tables of all library files of one maker that can be read, from one pass over the files; joins are Spark's."""

    def __init__(self, files: DataFrame, needs: tuple[str, ...], wanted: dict[str, list[str]]):
        rows = written(sqlite_rows(files, wanted), "library")
        own = rows.where(F.col("table") == NAMES).where(F.size(F.array_intersect(F.map_keys("row"), F.array(*map(F.lit, needs)))) == len(needs))
        bad = rows.where("error is not null").select("path")
        self.rows, self.wanted = rows.join(own.select("path"), "path", "left_semi").join(bad, "path", "left_anti"), wanted

    def __call__(self, table: str) -> DataFrame:
        return self.rows.where(F.col("table") == table).select("path", *(F.col("row")[c].alias(c) for c in self.wanted[table]))


def library_formats(files: DataFrame) -> DataFrame:
    """path and the maker of each file; null for files that are no known library."""
    return files.select("path").join(library_format(sqlite_tables(files)), "path", "left")


# -- reference managers: public file layouts of the versions around 2010 -------------------------------

#: Item types with their publication types; all others are MISC. Fixed values.
ZOTERO_TYPES = {
    "journalArticle": "ARTICLE", "magazineArticle": "ARTICLE", "newspaperArticle": "ARTICLE", "book": "BOOK", "bookSection": "INCOLLECTION", "conferencePaper": "INPROCEEDINGS",
    "thesis": "PHDTHESIS", "report": "TECHREPORT", "manuscript": "UNPUBLISHED",
}
#: Item fields with their record fields. Fixed values.
ZOTERO_FIELDS = {
    "title": "title", "publicationTitle": "journal", "bookTitle": "booktitle", "proceedingsTitle": "booktitle", "series": "series", "volume": "volume", "issue": "issue", "pages": "pages", "publisher": "publisher", "place": "address",
    "edition": "edition", "university": "school", "institution": "organization", "ISBN": "isbn", "ISSN": "issn", "DOI": "doi", "url": "linkout", "abstractNote": "abstract", "language": "language",
}


#: The tables that are read, with their columns. Fixed values.
ZOTERO_TABLES = {
    "items": ["itemID", "itemTypeID"], "itemTypes": ["itemTypeID", "typeName"], "deletedItems": ["itemID"], "itemData": ["itemID", "fieldID", "valueID"], "fields": ["fieldID", "fieldName"], "itemDataValues": ["valueID", "value"],
    "itemCreators": ["itemID", "creatorID", "creatorTypeID", "orderIndex"], "creatorTypes": ["creatorTypeID", "creatorType"], "creators": ["creatorID", "creatorDataID"], "creatorData": ["creatorDataID", "lastName", "firstName"],
    "itemNotes": ["sourceItemID", "note"], "collections": ["collectionID", "collectionName", "parentCollectionID"], "collectionItems": ["collectionID", "itemID"],
}


def read_zotero(files: DataFrame) -> DataFrame:
    """path and the fields of each item that is a record; collections as paths in ``folders_tmp``, notes in ``annote``."""
    table = Tables(files, (*LIBRARIES["ZOTERO"], "items"), ZOTERO_TABLES)
    by = lambda c: ["path", c]
    items = table("items").join(table("itemTypes"), by("itemTypeID")).join(table("deletedItems"), by("itemID"), "left_anti").where(~F.col("typeName").isin("note", "attachment"))
    data = table("itemData").join(table("fields"), by("fieldID")).join(table("itemDataValues"), by("valueID")).select("path", "itemID", F.col("fieldName").alias("field"), "value")
    items = items.join(data, by("itemID"), "left").select("path", F.col("itemID").alias("item"), F.col("typeName").alias("kind"), "field", "value")
    people = table("itemCreators").join(table("creatorTypes"), by("creatorTypeID")).join(table("creators"), by("creatorID")).join(table("creatorData"), by("creatorDataID"))
    people = people.select("path", F.col("itemID").alias("item"), F.col("orderIndex").alias("position"), F.col("creatorType").alias("role"), F.col("lastName").alias("last"), F.col("firstName").alias("first"))
    notes = table("itemNotes").where("sourceItemID is not null").select("path", F.col("sourceItemID").alias("item"), "note")
    folders = table("collections").toDF("path", "guid", "name", "parent")
    inside = table("collectionItems").toDF("path", "collection", "item")
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    by_field: dict[str, list] = {}
    for source, target in ZOTERO_FIELDS.items():
        by_field.setdefault(target, []).append(value(source))
    kind = F.lit(None).cast("string")
    for name, pubtype in ZOTERO_TYPES.items():
        kind = F.when(F.col("kind") == name, F.lit(pubtype)).otherwise(kind)
    records = items.groupBy("path", "item", "kind").agg(*(F.coalesce(*c).alias(t) for t, c in by_field.items()), value("date").alias("_date"))
    records = records.withColumns({
        "pubtype": F.coalesce(kind, F.lit("MISC")),
        "howpublished": F.when(kind.isNull(), F.concat(F.upper(F.substring("kind", 1, 1)), F.substring("kind", 2, 100))),
        "year": F.nullif(F.regexp_extract("_date", r"(\d{4})", 1), F.lit("")),
        "month": F.nullif(F.regexp_extract("_date", r"^\d{4}-(0[1-9]|1[0-2])\b", 1), F.lit("")),
    })
    return _with_people(records, people, {"author": "authors", "editor": "editors"}).join(_joined(notes, "note", "annote", "\n"), ["path", "item"], "left").join(_folders(folders, inside), ["path", "item"], "left").transform(_finished)


#: Document types with their publication types; all others are MISC. Fixed values.
MENDELEY_TYPES = {"JournalArticle": "ARTICLE", "MagazineArticle": "ARTICLE", "NewspaperArticle": "ARTICLE", "Book": "BOOK", "BookSection": "INCOLLECTION", "ConferenceProceedings": "INPROCEEDINGS", "Thesis": "PHDTHESIS", "Report": "TECHREPORT", "WorkingPaper": "UNPUBLISHED"}
#: Document columns with their record fields; columns with another meaning go to the note. Fixed values.
MENDELEY_FIELDS = {"title": "title", "publication": "journal", "volume": "volume", "issue": "issue", "pages": "pages", "year": "year", "month": "month", "day": "day", "publisher": "publisher", "edition": "edition", "series": "series", "abstract": "abstract", "doi": "doi", "issn": "issn", "isbn": "isbn", "pmid": "pmid", "arxivId": "arxivid", "note": "annote"}
MENDELEY_NOTED = ("sourceType", "city", "country", "institution", "department", "dateAccessed", "onlyReference", "medium", "genre", "userType")


#: The tables that are read beside the documents, with their columns. Fixed values.
MENDELEY_TABLES = {
    "DocumentContributors": ["documentId", "id", "contribution", "lastName", "firstNames"], "DocumentUrls": ["documentId", "url"], "DocumentKeywords": ["documentId", "keyword"],
    "DocumentTags": ["documentId", "tag"], "Folders": ["id", "name", "parentId"], "DocumentFolders": ["folderId", "documentId"],
}


def read_mendeley(files: DataFrame) -> DataFrame:
    """path and the fields of each document; columns that a record lacks go to ``note``, tags to ``labels``.

    A column that a program's version doesn't have is null in the records of its files."""
    columns = [*MENDELEY_FIELDS, *MENDELEY_NOTED]
    table = Tables(files, (*LIBRARIES["MENDELEY"], "Documents"), MENDELEY_TABLES | {"Documents": ["id", "type", *columns]})
    docs = table("Documents").withColumnsRenamed({"id": "item", "type": "kind"})
    kind = F.lit(None).cast("string")
    for name, pubtype in MENDELEY_TYPES.items():
        kind = F.when(F.col("kind") == name, F.lit(pubtype)).otherwise(kind)
    noted = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.format_string('Mendeley field "%s": %s<br />', F.lit(c), F.col(c))) for c in MENDELEY_NOTED]
    lines = F.array_join(F.filter(F.array(*noted), lambda x: x.isNotNull()), "\n")
    records = docs.select(
        "path", "item", *(F.nullif(F.col(c), F.lit("")).alias(t) for c, t in MENDELEY_FIELDS.items()), F.coalesce(kind, F.lit("MISC")).alias("pubtype"),
        F.when(kind.isNull(), F.col("kind")).alias("howpublished"), F.when(lines != "", F.concat(lines, F.lit("\n"))).alias("note"),
    )
    people = table("DocumentContributors").toDF("path", "item", "position", "role", "last", "first")
    folders = table("Folders").select("path", F.col("id").alias("guid"), "name", F.when(F.col("parentId").cast("long") > 0, F.col("parentId")).alias("parent"))
    inside = table("DocumentFolders").toDF("path", "collection", "item")
    per = lambda name, column: table(name).withColumnRenamed("documentId", "item").select("path", "item", column)
    out = _with_people(records, people, {"DocumentAuthor": "authors", "DocumentEditor": "editors"})
    first = per("DocumentUrls", "url").groupBy("path", "item").agg(F.min("url").alias("linkout"))
    for more in (first, _joined(per("DocumentKeywords", "keyword"), "keyword", "keywords", ";"), _joined(per("DocumentTags", "tag"), "tag", "labels", ","), _folders(folders, inside)):
        out = out.join(more, ["path", "item"], "left")
    return _finished(out)


def read_native(files: DataFrame) -> DataFrame:
    """path and the fields of each record of a native library file, with blank citekeys; a field that a file lacks is null."""
    columns = [f for f in FIELDS if f != "citekey"]
    found = Tables(files, LIBRARIES["NATIVE"], {"Publications": columns})("Publications")
    return with_fields(found.withColumn("citekey", F.lit("")))


def _joined(rows: DataFrame, column: str, name: str, by: str) -> DataFrame:
    """The values of each item, sorted and joined."""
    return rows.groupBy("path", "item").agg(F.array_join(F.array_sort(F.collect_set(column)), by).alias(name))


def _with_people(records: DataFrame, people: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Author and editor strings from names in their order."""
    name = F.concat_ws(", ", F.nullif(F.trim("last"), F.lit("")), F.nullif(F.trim("first"), F.lit("")))
    one = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(F.col("position").cast("long").alias("position"), name.alias("name"))))), lambda x: x["name"]), " and ")
    per = people.groupBy("path", "item").agg(*(F.nullif(one(r), F.lit("")).alias(f) for r, f in roles.items()))
    return records.join(per, ["path", "item"], "left")


def _folders(folders: DataFrame, inside: DataFrame) -> DataFrame:
    """The paths of each item's folders, from the root, joined by commas."""
    key = F.struct("path", F.col("guid").alias("k"))
    tree = folders.select(key.alias("guid"), F.when(F.coalesce("parent", F.lit("")) != "", F.struct("path", F.col("parent").alias("k"))).alias("parent"), "name")
    paths = folder_paths(tree).select(F.col("guid.path").alias("path"), F.col("guid.k").alias("collection"), F.col("path").alias("_folder"))
    return _joined(inside.join(paths, ["path", "collection"]), "_folder", "folders_tmp", ",")


def _finished(records: DataFrame) -> DataFrame:
    """All record fields, absent ones as nulls, in an order that doesn't depend on tasks' timing."""
    have = [f for f in FIELDS if f in records.columns]
    return records.select("path", F.col("item").cast("long").alias("item"), *(F.nullif(F.col(f), F.lit("")).alias(f) for f in have)).transform(with_fields)


READERS = {"ZOTERO": read_zotero, "MENDELEY": read_mendeley, "NATIVE": read_native}


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """Records of all library files at a path, each read by its maker's layout."""
    files = binary_files(spark, path)
    kinds = {r["format"] for r in library_formats(files).select("format").distinct().collect()}  # a row for each maker
    out = spark.createDataFrame([], T.StructType([*PUBLICATION.fields, T.StructField("path", T.StringType())]))
    for name, read in READERS.items():
        if name in kinds:
            out = out.unionByName(read(files).select(*FIELDS, "path"))
    return out
