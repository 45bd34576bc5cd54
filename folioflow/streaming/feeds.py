"""Streams: feed polling without repeats, change logs, job states, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import identity_sha1
from ..sources.records import FolioError

JOB_TYPES = ("PDF_IMPORT", "PDF_SEARCH", "METADATA_UPDATE")
#: States that a job may go to from each state. Fixed values.
TRANSITIONS = {
    "PENDING": ("RUNNING", "PAUSED", "CANCELED"), "PAUSED": ("PENDING", "CANCELED"), "RUNNING": ("DONE", "ERROR", "CANCELED"), "ERROR": ("PENDING",), "CANCELED": ("PENDING",), "DONE": (),
}


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def watched_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files that appear in a folder, as a stream of path, modificationTime and length."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "modificationTime", "length")


def new_items(items: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Items of a polled feed, each identity once within the watermark's delay; state beyond it is dropped."""
    return items.withColumn("sha1", identity_sha1(F.col("authors"), F.col("title"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha1"])


def first_by_key(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def merge_into(path: str, key: str):
    """A ``foreachBatch`` function that appends rows with keys that the table lacks; a batch that comes again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return write


def latest_states(log: DataFrame, key: str = "guid", order: str = "counter") -> DataFrame:
    """The last change of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def job_states(events: DataFrame) -> DataFrame:
    """jobid, status, type, error and duration of each job by its events (jobid, type, status, at)."""
    start, end = F.max(F.when(F.col("status") == "RUNNING", F.col("at"))), F.max(F.when(F.col("status").isin("DONE", "ERROR"), F.col("at")))
    out = events.groupBy("jobid").agg(F.max_by("status", "at").alias("status"), F.max_by("type", "at").alias("type"), start.alias("_a"), end.alias("_b"))
    seconds = F.greatest(F.unix_timestamp("_b") - F.unix_timestamp("_a"), F.lit(1))
    return out.select("jobid", "status", "type", (F.col("status") == "ERROR").alias("error"), F.when(F.col("status").isin("DONE", "ERROR"), seconds).alias("duration"))


def dispatched(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """What the handler of each job's type gives for the pending jobs of that type; a type without one is an error."""
    if unknown := set(handlers) - set(JOB_TYPES):
        raise FolioError(f"no such job type: {', '.join(sorted(unknown))}")
    due = jobs.where(F.col("status") == "PENDING")
    rest = F.raise_error(F.concat(F.lit("no handler for "), F.coalesce("type", F.lit("no type"))))
    checked = due.where(F.when(F.col("type").isin(*handlers), F.lit(True)).otherwise(rest.cast("boolean")))
    out = None
    for name, handle in handlers.items():
        part = handle(checked.where(F.col("type") == name))
        out = part if out is None else out.unionByName(part)
    return out


def allowed(old, new):
    """Whether a job may go from one state to another."""
    out = F.lit(False)
    for state, following in TRANSITIONS.items():
        if following:
            out = out | ((old == state) & new.isin(*following))
    return out


def command(jobs: DataFrame, action: str, ids: list[str] | None = None) -> DataFrame:
    """Jobs after pause, resume, cancel, retry or clear, of some ids or all."""
    mine = F.col("jobid").isin(*ids) if ids is not None else F.lit(True)
    if action == "clear":
        return jobs.where(~(mine & F.col("status").isin("DONE", "ERROR", "CANCELED")))
    to = {"pause": "PAUSED", "resume": "PENDING", "cancel": "CANCELED", "retry": "PENDING"}[action]
    froms = {"pause": ("PENDING",), "resume": ("PAUSED",), "cancel": ("PENDING", "PAUSED", "RUNNING"), "retry": ("ERROR", "CANCELED")}[action]
    return jobs.withColumn("status", F.when(mine & F.col("status").isin(*froms), F.lit(to)).otherwise(F.col("status")))


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Tumbling counts; late rows within the delay still count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
