"""Runs a stream over what there is and gives its output as a table; runs an action under a time limit."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..sources.records import CanceledError
from ..store import working_folder


def drained(stream: DataFrame, timeout: int = 600) -> DataFrame:
    """All output of an append-mode stream over its present input."""
    spark, path = stream.sparkSession, working_folder(stream.sparkSession, "stream")
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    if not run.awaitTermination(timeout):
        run.stop()
        raise TimeoutError("the stream did not end in time")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def limited(spark: SparkSession, action: Callable, warn: float, end: float, on_warn: Callable[[], None] | None = None, canceled: threading.Event | None = None):
    """What the action returns. After ``warn`` seconds on_warn is called once; after ``end`` seconds, or once the event
    is set, the action's Spark jobs are cancelled and CanceledError is raised."""
    tag, found, canceled = f"limited-{uuid.uuid4().hex}", {}, canceled or threading.Event()
    done = threading.Event()

    def run():
        spark.addTag(tag)
        try:
            found["value"] = action()
        except Exception as e:  # goes to the caller
            found["error"] = e
        finally:
            spark.removeTag(tag)
            done.set()

    worker = InheritableThread(target=run, daemon=True)
    worker.start()
    waited = 0.0
    while not done.wait(step := min(0.1, end)):
        waited += step
        if on_warn and waited >= warn:
            on_warn()
            on_warn = None
        if waited >= end or canceled.is_set():
            spark.interruptTag(tag)
            raise CanceledError("canceled" if canceled.is_set() else f"no answer within {end} seconds")
    if "error" in found:
        raise found["error"]
    return found["value"]
