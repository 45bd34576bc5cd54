"""Histograms and a dashboard kept up to date from changes, by signed counts.

Each measure gives the groups that a row counts in. A batch of changes subtracts the rows that went and adds those that came, and writes only the groups
whose counts change; a count is the sum of its batches. A largest value is kept as the counts of all values, so that it can go back when
its rows are deleted. Merging the batches into one leaves all counts as they are. Null groups are counted as none.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import written
from .library import whole_row

_NAME = re.compile(r"batch-(\d{8})-(\d{8})$")
_SCHEMA = "measure string, grp string, n long"


def changed_rows(before: DataFrame, after: DataFrame, key: str = "guid") -> tuple[DataFrame, DataFrame]:
    """The rows that went and those that came between two states of a table; a changed row is in both."""
    a = before.withColumn("_row", whole_row(before))
    b = after.withColumn("_row", whole_row(after))
    return a.join(b.select(key, "_row"), [key, "_row"], "left_anti").drop("_row"), b.join(a.select(key, "_row"), [key, "_row"], "left_anti").drop("_row")


@dataclass
class Counters:
    """Counts at a path. measures: a column for each name, of a group or of an array of groups."""

    spark: SparkSession
    path: str
    measures: Mapping[str, Column]

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _batches(self) -> list[tuple[int, int, str]]:
        """Those that are complete and not within a merged one."""
        fs, p = self._fs()
        found = []
        for status in fs.listStatus(p) if fs.exists(p) else []:
            name = status.getPath().toString()
            if (m := _NAME.search(name)) and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{name}/_SUCCESS")):
                found.append((int(m[1]), -int(m[2]), name))
        out: list[tuple[int, int, str]] = []
        for low, high, name in sorted(found):
            if not out or -high > out[-1][1]:
                out.append((low, -high, name))
        return out

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        out = None
        for name, c in self.measures.items():
            each = rows.select(F.explode(c).alias("g")) if rows.select(c).schema[0].dataType.typeName() == "array" else rows.select(c.alias("g"))
            part = each.where("g is not null").select(F.lit(name).alias("measure"), F.col("g").cast("string").alias("grp"), F.lit(sign).cast("long").alias("n"))
            out = part if out is None else out.unionByName(part)
        return out

    def apply(self, removed: DataFrame | None = None, added: DataFrame | None = None) -> int:
        """Counts a batch of changes; the number of groups that it writes."""
        parts = [self._signed(df, sign) for df, sign in ((removed, -1), (added, 1)) if df is not None]
        deltas = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        deltas = deltas.groupBy("measure", "grp").agg(F.sum("n").alias("n")).where("n != 0")
        number = max((high for _, high, _ in self._batches()), default=-1) + 1
        path = f"{self.path}/batch-{number:08d}-{number:08d}"
        deltas.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_SCHEMA).parquet(path).count()

    def _all(self) -> DataFrame:
        paths = [name for _, _, name in self._batches()]
        return self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)

    def counts(self, measure: str) -> DataFrame:
        """(grp, n): the groups of a measure that have rows."""
        return self._all().where(F.col("measure") == measure).groupBy("grp").agg(F.sum("n").alias("n")).where("n > 0")

    def total(self, measure: str) -> Column:
        """For ``dashboard``: the sum of a measure's counts."""
        return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))

    def largest(self, measure: str, kind: str = "string") -> Column:
        """For ``dashboard``: the largest group of a measure that still has rows, as a type."""
        return F.max(F.when((F.col("measure") == measure) & (F.col("n") > 0), F.col("grp").cast(kind)))

    def dashboard(self, **values: Column) -> DataFrame:
        """One row of totals and largest values."""
        return self._all().groupBy("measure", "grp").agg(F.sum("n").alias("n")).agg(*(c.alias(name) for name, c in values.items()))

    def compact(self) -> None:
        """Merges all batches into one; groups without rows go."""
        batches = self._batches()
        if len(batches) > 1:
            rows = written(self._all().groupBy("measure", "grp").agg(F.sum("n").alias("n")).where("n != 0"), "counts")
            rows.write.mode("overwrite").parquet(f"{self.path}/batch-{batches[0][0]:08d}-{batches[-1][1]:08d}")
