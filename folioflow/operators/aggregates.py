"""Histograms, clouds, and counts over records and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Items of a cloud: the limit counts from 0 and is tested after the item is kept.
CLOUD_ITEMS = 302


def histogram(df: DataFrame, items: Column) -> DataFrame:
    """name and count of each item of a list column; absent and empty items don't count."""
    names = df.select(F.explode(items).alias("name")).where("name is not null and name <> ''")
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("count"))


def top_k(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "name").limit(k)


def cloud(counts: DataFrame, keep: int = CLOUD_ITEMS) -> DataFrame:
    """The most frequent names with a weight from 0 to 1 on a log scale and a size from 10 to 20."""
    kept = top_k(counts, keep)
    whole = Window.partitionBy()  # at most ``keep`` rows
    ln = lambda c: F.ln(F.greatest(c, F.lit(1)).cast("double"))
    low, high = F.min("count").over(whole), F.max("count").over(whole)
    weight = F.when(ln(high) > ln(low), (ln(F.col("count")) - ln(low)) / (ln(high) - ln(low))).otherwise(F.lit(1.0))
    return kept.select("name", "count", weight.alias("weight")).withColumn("size", (F.lit(10) + F.floor(F.col("weight") * 10 + F.lit(1e-9))).cast("long"))


def cloud_order(c: DataFrame, by: str = "alphabetical") -> DataFrame:
    return c.orderBy(F.lower("name"), "name") if by == "alphabetical" else c.orderBy(F.desc("count"), "name")


def dashboard(publications: DataFrame) -> DataFrame:
    """num_items, num_pdfs, num_attachments and last_imported of the records that are not in the trash."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return publications.where(~F.col("trashed")).agg(
        F.count(F.lit(1)).alias("num_items"),
        F.count_if(given("pdf")).alias("num_pdfs"),
        F.coalesce(F.sum(F.when(given("attachments"), F.size(F.split("attachments", ",")))), F.lit(0)).cast("long").alias("num_attachments"),
        F.max("created").alias("last_imported"),
    )


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Per job type: pending, done and failed jobs, progress, and the time left at the mean pace of done jobs."""
    done, pending = F.count_if((F.col("status") == "DONE") & ~F.col("error")), F.count_if(F.col("status") == "PENDING")
    out = jobs.groupBy("type").agg(
        pending.alias("num_pending"),
        done.alias("num_done"),
        F.count_if("error").alias("num_error"),
        F.avg(F.when((F.col("status") == "DONE") & ~F.col("error"), F.col("duration"))).alias("_pace"),
    )
    out = out.withColumn("progress", F.when(F.col("num_done") + F.col("num_pending") > 0, F.col("num_done") / (F.col("num_done") + F.col("num_pending"))))
    return out.withColumn("eta", F.round(F.col("_pace") * F.col("num_pending")).cast("long")).drop("_pace")


def field_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("count"))


def joined_text(df: DataFrame, by: list[str], value: str, separator: str = ",") -> DataFrame:
    """The values of each group in order, as one string."""
    return df.groupBy(*by).agg(F.expr(f"listagg({value}, '{separator}') WITHIN GROUP (ORDER BY {value})").alias("text"))
