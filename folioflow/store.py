"""Working folders in the checkpoint folder that the session names, and tables written there to cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def working_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one that the session names for checkpoints; a temporary one only where it names none."""
    base = spark.conf.get(DIR_KEY, None) or spark.sparkContext.getConf().get(DIR_KEY)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{DIR_KEY} must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/folioflow-work"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The table written to a new working folder and read again: later steps start from there."""
    path = working_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
