"""File sources: whole files to records, feeds, libraries, directory listings, and registered formats."""

from __future__ import annotations

import itertools
import math
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import guid_of, identity_sha1
from ..store import written
from .bibtex import bibtex_records, read_bibtex
from .records import FIELDS, PUBLICATION, FileFormatError, FileReadError
from .ris import read_ris, ris_byte_records

PARSERS = {"BIBTEX": read_bibtex, "RIS": read_ris}
PARSED = T.StructType([T.StructField("path", T.StringType()), T.StructField("position", T.IntegerType()), *PUBLICATION.fields])


#: Records that are put together before they go on.
BATCH_RECORDS = 2_000


def parse_files(files: DataFrame, parser) -> DataFrame:
    """files: path, content (string or binary). Records of each file with path and position; unknown fields are left out.

    Of a parser that gives one record at a time, no more than some are held, whatever a file has."""

    def run(batches):
        for batch in batches:
            found = (
                (path.as_py(), k, r)
                for path, content in zip(batch.column(0), batch.column(1), strict=True)
                for k, r in enumerate(parser(content.as_py() or (b"" if pa.types.is_binary(content.type) else "")))
            )
            while rows := list(itertools.islice(found, BATCH_RECORDS)):
                paths, places, records = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.int32()), *(pa.array([r.get(f) for r in records], pa.string()) for f in FIELDS)], names=PARSED.names)

    return files.select("path", "content").mapInArrow(run, PARSED)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def read_bibtex_files(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    return parse_files(text_files(spark, path), lambda t: bibtex_records(t, strip))


def read_ris_files(spark: SparkSession, path: str) -> DataFrame:
    """The character set of each file is found from its bytes."""
    return parse_files(binary_files(spark, path), ris_byte_records)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files and entries of Atom ones, with the feed's title; every record still needs its details."""
    text = lambda names: [T.StructField(c, T.StringType()) for c in names]
    items = T.StructType(text(("title", "link", "description", "pubDate", "guid")))
    channel = T.StructType([*text(("title",)), T.StructField("item", T.ArrayType(items))])
    link = T.StructType(text(("_href", "_rel")))
    entries = T.StructType([*text(("title", "id", "summary", "content", "published")), T.StructField("link", T.ArrayType(link)), T.StructField("author", T.ArrayType(T.StructType(text(("name",)))))])
    feed = T.StructType([*text(("title",)), T.StructField("entry", T.ArrayType(entries))])
    rss = spark.read.format("xml").option("rowTag", "channel").schema(channel).load(path).select(F.col("title").alias("feed"), F.explode("item").alias("i"))
    atom = spark.read.format("xml").option("rowTag", "feed").schema(feed).load(path).select(F.col("title").alias("feed"), F.explode("entry").alias("i"))
    shown = F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    authors = F.nullif(F.array_join(F.transform("i.author", lambda x: x["name"]), " and "), F.lit(""))
    rss = rss.select("feed", F.col("i.title").alias("title"), F.col("i.link").alias("linkout"), F.col("i.description").alias("abstract"), F.lit(None).cast("string").alias("authors"))
    atom = atom.select("feed", F.col("i.title").alias("title"), F.coalesce(F.get(shown, 0)["_href"], F.col("i.id")).alias("linkout"), F.coalesce("i.summary", "i.content").alias("abstract"), authors.alias("authors"))
    return rss.unionByName(atom).withColumn("needs_details", F.lit(True))


def import_records(records: DataFrame) -> DataFrame:
    """What an import does to parsed records: blank citekeys, identity, guid, and one record of each identity."""
    from pyspark.sql.window import Window

    out = records.withColumn("citekey", F.lit("")).withColumn("sha1", identity_sha1(F.col("authors"), F.col("title")))
    out = out.withColumn("guid", F.coalesce(F.nullif("guid", F.lit("")), guid_of(F.col("sha1"))))
    order = [F.col(c) for c in ("path", "position") if c in out.columns] or [F.col("guid")]
    first = F.row_number().over(Window.partitionBy("sha1").orderBy(*order))
    return out.withColumn("_k", first).where("_k = 1").drop("_k")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """A stored library's publications with blank citekeys."""
    return spark.read.parquet(path).withColumn("citekey", F.lit(""))


# -- library files of other programs, as extracted tables -------------------------------------------


def _doubled(now: DataFrame, rounds: int) -> DataFrame:
    """Of rows (k, up, land, path and others) those that end: each round joins a row's path to that of the row ``up`` that it has
    reached, and gives it that row's ``up`` and ``land``. Some rows may never end, so there are at most so many rounds."""
    for _ in range(rounds):
        now = written(now, "folders")
        far = now.where("up is not null")
        if far.isEmpty():
            break
        ahead = now.select(F.col("k").alias("up"), F.col("up").alias("_up"), F.col("land").alias("_land"), F.col("path").alias("_path")).hint("merge")
        path = F.when(F.coalesce("_path", "path").isNotNull(), F.concat_ws("/", "_path", "path"))  # names that are null are left out
        step = far.drop("land").join(ahead, "up").withColumns({"path": path, "up": F.col("_up"), "land": F.col("_land")})
        now = now.where("up is null").unionByName(step.select(*now.columns))
    return now.where("up is null").drop("up")


#: Levels from one landing to the next, at least; of trees with so many levels at most, whole paths are doubled.
STRIDE, FEW_LEVELS = 16, 64


def _from_landings(rows: DataFrame, deepest: int, rounds: int) -> DataFrame:
    """k and the whole path of rows (k, p, path, depth) of trees, put together when it is read.

    Whole paths are written for trees of few levels only. Of others, roots and the levels at multiples of a stride, the square root of the greatest
    depth, are landings. Paths are doubled from each row up to the landing above it; the landings, with these paths for names, are trees of
    as many levels as the depth has strides, whose whole paths are found alike and joined to those of the rows between."""
    if deepest < FEW_LEVELS:
        return _doubled(rows.select("k", F.col("p").alias("up"), F.lit(None).cast(rows.schema["k"].dataType).alias("land"), "path"), rounds).select("k", "path")
    stride = max(STRIDE, math.isqrt(deepest))
    level = F.col("depth") % stride
    parts = rows.select("k", F.when(level != 1, F.col("p")).alias("up"), F.when(level == 1, F.col("p")).alias("land"), "path", "depth")
    parts = _doubled(parts, rounds)
    landings = parts.where(level == 0).select("k", F.col("land").alias("p"), "path", F.expr(f"depth div {stride}").alias("depth"))
    landings = _from_landings(landings, deepest // stride, rounds)
    whole = parts.where(level != 0).join(landings.select(F.col("k").alias("land"), F.col("path").alias("_path")).hint("merge"), "land")
    return landings.unionByName(whole.select("k", F.when(F.coalesce("_path", "path").isNotNull(), F.concat_ws("/", "_path", "path")).alias("path")))


def folder_paths(collections: DataFrame, key: str = "guid", parent: str = "parent", name: str = "name") -> DataFrame:
    """key and the path of names from the root, joined by "/", for trees of any depth.

    First the depths: each round joins every folder to the ancestor it has reached, so as many rounds do as the depth has
    binary digits. Then the paths, by landings (``_from_landings``): on the way there are a stride of names for each folder, the same for
    each landing, and whole paths of a few levels only; the last joins, which are not written, put them together. Where keys repeat, every way
    up is a path, and whole paths are doubled. Folders in or below a cycle, or with a parent that isn't there,
    have no path. A folder's parent is absent if it is null, empty or "ROOT"."""
    p = F.col(parent)
    kind = collections.schema[parent].dataType
    top = p.isNull() | (p.isin("", "ROOT") if isinstance(kind, T.StringType) else F.lit(False))
    none = F.lit(None).cast(collections.schema[key].dataType)
    rows = written(collections.select(F.col(key).alias("k"), F.when(~top, p).alias("up"), none.alias("land"), F.col(name).alias("path")), "folders")
    rounds = rows.count().bit_length() + 1
    if not rows.where("k is not null").groupBy("k").count().where("count > 1").isEmpty():
        return _doubled(rows, rounds).select(F.col("k").alias(key), "path")
    now = rows.select("k", F.col("up").alias("p"), "up", "path", F.col("up").isNotNull().cast("long").alias("depth"))
    for _ in range(rounds):
        now = written(now, "folders")
        far = now.where("up is not null")
        if far.isEmpty():
            break
        ahead = now.select(F.col("k").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth")).hint("merge")
        step = far.join(ahead, "up").withColumns({"depth": F.col("depth") + F.col("_depth"), "up": F.col("_up")})
        now = now.where("up is null").unionByName(step.select(*now.columns))
    rooted = now.where("up is null").drop("up")
    deepest = rooted.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    return _from_landings(rooted, deepest, rounds).withColumnRenamed("k", key)


def zotero_records(items: DataFrame, collections: DataFrame, members: DataFrame) -> DataFrame:
    """items: id and record fields; members: collection, item. Adds folders_tmp: paths joined by ","."""
    paths = folder_paths(collections)
    of = members.join(paths, members["collection"] == paths["guid"]).groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("folders_tmp"))
    return items.join(of, items["id"] == of["item"], "left").drop("item")


def mendeley_records(documents: DataFrame, unknown: DataFrame, tags: DataFrame) -> DataFrame:
    """documents: id and record fields; unknown: id, key, value; tags: id, tag. Unknown fields go to the note, tags to labels."""
    lines = unknown.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string('Mendeley field "%s": %s<br />', "key", "value"))), "\n").alias("_more"))
    labels = tags.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("labels"))
    out = documents.join(lines, "id", "left").join(labels, "id", "left")
    note = F.concat_ws("\n", F.nullif(F.col("note"), F.lit("")) if "note" in documents.columns else F.lit(None), "_more")
    return out.withColumn("note", F.nullif(note, F.lit(""))).drop("_more")


# -- files and directories ------------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    """Spark's own file layer for a path, and the path there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def list_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), hidden: bool = False, mode: str = "BOTH") -> list[dict]:
    """Directories, then files, each in code-point order, of one folder of any store that Spark reads."""
    fs, p, jvm = _hadoop(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        raise FileReadError(f"no folder at {path}", path)
    held = fs.listStatus(p)
    if not len(held):
        return []
    # all paths come as one text; no name has a "/", so the folder's own path parts them
    own = held[0].getPath().getParent().toString().rstrip("/") + "/"
    names = jvm.scala.runtime.ScalaRunTime.stringOf(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(held)).removeprefix(f"Array({own}")[:-1].split(f", {own}")
    found = sorted((n, own + n, s.isDirectory()) for n, s in zip(names, held, strict=True))
    shown = [x for x in found if hidden or not x[0].startswith(".")]
    wanted = {e.lower() for e in extensions}
    dirs = [{"name": n, "path": full, "type": "DIR"} for n, full, is_dir in shown if is_dir]
    files = [{"name": n, "path": full, "type": "FILE"} for n, full, is_dir in shown if not is_dir and (not wanted or n.rpartition(".")[2].lower() in wanted)]
    return files if mode == "FILE" else dirs + files


def file_stat(spark: SparkSession, path: str) -> dict:
    """What can be done with a path, by its owner's, group's or everyone's rights as the store has them."""
    fs, p, jvm = _hadoop(spark, path)
    if not fs.exists(p):
        return {"exists": False, "dir": False, "readable": False, "writable": False, "executable": False, "size": None}

    def may(what: str) -> bool:
        try:
            fs.access(p, getattr(jvm.org.apache.hadoop.fs.permission.FsAction, what))
        except Exception as e:
            if "AccessControl" in str(e):
                return False
            raise
        return True

    status = fs.getFileStatus(p)
    return {"exists": True, "dir": status.isDirectory(), "readable": may("READ"), "writable": may("WRITE"), "executable": may("EXECUTE"), "size": status.getLen()}


def find_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files that end in .pdf, any case, below a folder."""
    return binary_files(spark, path).select("path", "length").where(F.lower("path").endswith(".pdf"))


# -- formats for spark.read.format / df.write.format -----------------------------------------------------


def register_formats(spark: SparkSession) -> None:
    """Makes ``spark.read``, ``readStream`` and ``write`` know format("bibtex") and format("ris")."""
    from .datasource import register_sources

    register_sources(spark)
