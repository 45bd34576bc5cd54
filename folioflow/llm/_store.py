"""Working folders in the shared checkpoint folder, and raw files that workers map into memory.

``spark.checkpoint.dir`` names a folder that the driver and all executors share. Files there go
through ``pyarrow.fs``, so any store that it knows works; where the store is a plain file system,
workers map the files in place, elsewhere they map a copy that no folder keeps.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where the setting is absent, as in tests."""
    found = spark.conf.get(DIR_KEY, None) or spark.sparkContext.getConf().get(DIR_KEY)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{DIR_KEY} must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/folioflow-{os.getuid()}"
    return found if "://" in found else f"file://{os.path.abspath(found)}"


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write the table into the shared folder and read it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Between steps of a long operator: what no plan refers to any more goes, so that Spark's cleaner drops
    the shuffle files and broadcasts of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Drop a working folder through Spark's own file-system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, *arrays: np.ndarray) -> None:
    """Write arrays one after another under a name of its own, then rename: a retried task replaces the whole file."""
    system, path = _fs(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        for a in arrays:
            if a.size:
                out.write(memoryview(np.ascontiguousarray(a)).cast("B"))
    system.move(part, path)


def fetched(uri: str) -> np.ndarray:
    """The file's bytes in memory; none where there is no such file."""
    system, path = _fs(uri)
    try:
        with system.open_input_stream(path) as src:
            return np.frombuffer(src.read(), np.uint8)
    except FileNotFoundError:
        return np.empty(0, np.uint8)


def mapped(uri: str) -> np.ndarray:
    """The file's bytes, mapped into memory."""
    if uri.startswith("file:"):
        path = uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:")
        if not os.path.getsize(path):
            return np.empty(0, np.uint8)
        return np.memmap(path, np.uint8, "r")
    system, far = _fs(uri)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(far) as src:  # a file without a name: it goes with the last map of it
        while block := src.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, np.uint8, "r") if copy.tell() else np.empty(0, np.uint8)
