"""Result lists that are sorted once and paged through by order statistics.

Rows are dealt to ranges of their order and written, a folder for each range, with their places in it; a small table has the number of rows
of every range. Any page then opens the one range that holds it (two, at a border), however far back it is, and nothing is sorted again.
Rows that are equal in the order keep the places that they got when the list was written. A page beyond the end is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import page_count

#: Rows of a range.
RANGE_ROWS = 1_000_000
#: Bits of Spark's increasing ids that count the rows of a partition.
ROW_BITS = 33


@dataclass
class SortedList:
    """A list that was written to a path; its schema is found there if it isn't given."""

    spark: SparkSession
    path: str
    schema: T.StructType | None = None

    @classmethod
    def write(cls, df: DataFrame, order: list[Column], path: str, range_rows: int = RANGE_ROWS, rows: int | None = None) -> SortedList:
        """rows: the number of rows, where it is known."""
        ranges = max(1, -(-(df.count() if rows is None else rows) // range_rows))
        row = F.struct(*df.columns).alias("row")  # no column of the list can clash with the places
        placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        placed = placed.select(row, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("place"))
        placed.write.partitionBy("part").parquet(f"{path}/rows")
        kept = cls(df.sparkSession, path, T.StructType([T.StructField("row", df.schema), T.StructField("place", T.LongType()), T.StructField("part", T.IntegerType())]))
        kept._rows().groupBy("part").agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{path}/ranges")
        return kept

    def _rows(self) -> DataFrame:
        return (self.spark.read if self.schema is None else self.spark.read.schema(self.schema)).parquet(f"{self.path}/rows")

    def _ranges(self) -> list[tuple[int, int]]:
        return sorted((r["part"], r["rows"]) for r in self.spark.read.schema("part int, rows long").parquet(f"{self.path}/ranges").collect())  # a row for each range

    def total(self) -> int:
        return sum(n for _, n in self._ranges())

    def pages(self, size: int) -> DataFrame:
        """The number of pages."""
        return self.spark.range(1).select(page_count(F.lit(self.total()), size).alias("pages"))

    def page(self, offset: int = 0, limit: int = 10) -> DataFrame:
        """Rows offset to offset + limit, from the ranges that hold them."""
        whole = self._rows()
        begin, parts = 0, []
        for part, n in self._ranges():
            if begin < offset + limit and begin + n > offset:
                parts.append((part, begin))
            begin += n
        if not parts:
            return whole.select("row.*").limit(0)
        start = F.lit(0)
        for part, first in parts:
            start = F.when(F.col("part") == part, F.lit(first)).otherwise(start)
        at = start + F.col("place")
        rows = whole.where(F.col("part").isin([p for p, _ in parts]))
        return rows.where((at >= offset) & (at < offset + limit)).orderBy(at).select("row.*")
