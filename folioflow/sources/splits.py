"""Citation files read in byte ranges: a file of any size becomes as many tasks as Spark splits it into.

Spark's text source deals ranges of whole lines. Each task cuts its lines into chunks, one for each record start that it
sees; what stands before the first start of a range belongs to the last chunk of a range before it, so one small row of each range tells
where its head goes. String macros are found in a first pass over the chunks that define some, and joined to the chunks that use them,
each by the last definition before it. Then chunks are parsed wherever they are.

A record starts with a line that begins with its mark (``@``, letters and a bracket; or ``TY  -``) and ends before the next such line at
the latest, for the whole-file readers, too, so an entry without its closing bracket harms no other one, and nothing has to look for the bracket beyond.
Null lines don't exist; an empty file has no records; a file without a mark has none. Files of any number share the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..store import working_folder, written
from . import bibtex, ris
from .records import FIELDS, PUBLICATION

#: What a line begins with that starts a record.
STARTS = {"BIBTEX": bibtex.ENTRY_LINE, "RIS": ris.RECORD_LINE}
#: Characters of chunks that go on at once.
BATCH_CHARS = 1 << 20
#: Bytes of short ranges that one task reads, where there are more than some for each core.
TASK_BYTES = 1 << 25

_CHUNK = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("text", T.StringType())])


def line_ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """path, start (the first byte of the line's range) and line, in the order of the file within each range.

    range_bytes: a range's size, if not that of the session (``spark.sql.files.maxPartitionBytes``); it is set in a session of its own."""
    if range_bytes is not None:
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    if range_bytes is None:
        return lines
    # a task reads many short ranges, one after the other: with a task and a file for each, their start would be most of the time
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-lines.rdd.getNumPartitions() * range_bytes // TASK_BYTES))
    return lines.coalesce(tasks)


def _pieces(lines: DataFrame, starts: re.Pattern) -> DataFrame:
    """(path, start, n, last, text): the chunks of each range, from 1; 0 is what stands before the first."""

    def run(batches):
        here, n, held, out, size = None, 0, [], [], 0

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=_CHUNK.names)

        for b in batches:
            for path, start, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (path, start) != here or starts.match(line):
                    if here is not None:
                        out.append((*here, n, (path, start) != here, "\n".join(held)))
                    held, n = [], n + 1 if (path, start) == here else int(bool(starts.match(line)))
                    here = (path, start)
                held.append(line)
                size += len(line)
            if size >= BATCH_CHARS and out:
                yield batch(out)
                out, size = [], 0
        if here is not None:
            out.append((*here, n, True, "\n".join(held)))
        if out:
            yield batch(out)

    return lines.select("path", "start", "line").mapInArrow(run, _CHUNK)


def chunks(spark: SparkSession, lines: DataFrame, kind: str) -> DataFrame:
    """(path, start, n, text) of all records of ``line_ranges``, each whole; written once, since lines are read in order but once."""
    folder = working_folder(spark, "chunks")
    _pieces(lines, STARTS[kind]).write.parquet(folder)
    pieces = spark.read.schema(_CHUNK).parquet(folder)
    heads = pieces.where("n = 0").select("path", "start", "text")
    ranges = pieces.where("last").select("path", "start", "n")  # a row for each range
    order = Window.partitionBy("path").orderBy("start")
    # the range whose last chunk goes on in this one's head: the last before it that has a start
    owner = F.last(F.when(F.col("n") > 0, F.col("start")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    owners = ranges.withColumn("owner", owner).where("owner is not null").select("path", "start", "owner")
    more = heads.join(owners, ["path", "start"]).groupBy("path", F.col("owner").alias("start"))
    more = more.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), "text"))), lambda x: x["text"]), "\n").alias("more"))  # the rest of one record
    ends = pieces.where("last and n > 0").join(more, ["path", "start"], "left").select("path", "start", "n", F.concat_ws("\n", "text", "more").alias("text"))
    return pieces.where("n > 0 and not last").select("path", "start", "n", "text").unionByName(ends)


_MACRO = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


def _mapped(df: DataFrame, column: str, name: str, fn: Callable, kind: T.DataType, *more: str) -> DataFrame:
    """``df`` with a column that fn makes of the text and some more columns, in Arrow batches."""
    arrow = {"names": pa.list_(pa.string()), "found": pa.list_(pa.struct([("k", pa.int32()), ("name", pa.string()), ("value", pa.string())]))}[name]
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for b in batches:
            values = [fn(*x) for x in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (column, *more)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow)], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def _at() -> Column:
    return F.struct("start", "n")


def with_macros(texts: DataFrame) -> DataFrame:
    """Chunks with ``macros``, a map of the names that a chunk uses to their values where it begins.

    A definition may use earlier ones: each round settles those whose own names are settled, so there are as many rounds as the longest chain has
    links. A name that is defined again counts from there on; names without a definition are empty."""
    defining = texts.where(F.col("text").rlike(r"(?i)@\s*string\s*[{(]"))
    if defining.isEmpty():
        return texts.withColumn("macros", F.lit(None).cast("map<string,string>"))
    names = lambda df: _mapped(df, "text", "names", bibtex.used_names, T.ArrayType(T.StringType()))
    todo, known = written(names(defining), "macros"), None
    while True:
        ready = _filled(todo, known, todo)
        found = _mapped(ready.where("settled").select("path", "start", "n", "text", "macros"), "text", "found", lambda t, m: bibtex.defined(t, dict(m or ())), _MACRO, "macros")
        found = found.select("path", "start", "n", F.explode("found").alias("m")).select("path", "start", "n", "m.k", "m.name", "m.value")
        known = written(found if known is None else known.unionByName(found), "macros")
        todo = written(ready.where("not settled").select("path", "start", "n", "text", "names"), "macros")
        if todo.isEmpty():
            return _filled(names(texts), known, None).select("path", "start", "n", "text", "macros")


def _filled(rows: DataFrame, known: DataFrame | None, open_: DataFrame | None) -> DataFrame:
    """rows with ``macros``, by the last known definition of each name before a row; ``settled`` is whether no definition that is
    still open stands between (a row of ``open_`` may define any name)."""
    used = rows.select("path", "start", "n", F.explode("names").alias("name"))
    at = ["path", "start", "n"]
    out = rows
    if known is not None:
        before = known.select("path", "name", F.struct("start", "n", "k").alias("d"), "value")
        hits = used.join(before, ["path", "name"]).where(F.struct(F.col("d.start"), F.col("d.n")) < _at())
        last = hits.groupBy(*at, "name").agg(F.max(F.struct("d", "value")).alias("v"))
        out = out.join(last.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("name", "v.value"))).alias("macros")), at, "left")
    else:
        out = out.withColumn("macros", F.lit(None).cast("map<string,string>"))
    if open_ is None:
        return out
    # an open definition of a used name before this row: its value isn't known yet
    defines = _mapped(open_.select("path", "start", "n", "text"), "text", "names", bibtex.defined_names, T.ArrayType(T.StringType()))
    defines = defines.select("path", F.col("start").alias("s"), F.col("n").alias("m"), F.explode("names").alias("name"))
    late = used.join(defines, ["path", "name"]).where(F.struct(F.col("s"), F.col("m")) < _at()).select(*at).distinct()
    return out.join(late.withColumn("_late", F.lit(True)), at, "left").withColumn("settled", F.col("_late").isNull()).drop("_late")


_PARSED = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k", T.IntegerType()), *PUBLICATION.fields])


def _parsed(rows: DataFrame, parse: Callable, *more: str) -> DataFrame:
    """Records of each chunk, with path, start, n and k, by which they sort as in their file."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), *((f, pa.string()) for f in FIELDS)])
        for b in batches:
            found = []
            for path, start, n, *given in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                found += [{"path": path, "start": start, "n": n, "k": k, **{f: r.get(f) for f in FIELDS}} for k, r in enumerate(parse(*given))]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.select("path", "start", "n", "text", *more).mapInArrow(run, _PARSED)


def read_bibtex_ranges(spark: SparkSession, path: str, strip: bool = True, range_bytes: int | None = None) -> DataFrame:
    """Records of BibTeX files in UTF-8, split into ranges; path, start, n and k give their order."""
    rows = with_macros(chunks(spark, line_ranges(spark, path, range_bytes), "BIBTEX"))
    return _parsed(rows, lambda text, macros: bibtex.read_bibtex(text, strip, dict(macros or ())), "macros")


def read_ris_ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Records of RIS files in UTF-8, split into ranges; path, start, n and k give their order."""
    return _parsed(chunks(spark, line_ranges(spark, path, range_bytes), "RIS"), ris.read_ris)
