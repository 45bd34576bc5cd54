"""The standard tables, and their rows in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, tasks: int = 4) -> DataFrame:
    """The rows of a small file dealt over all cores, some tasks each, for queries that make much of each row: Spark deals a file by its
    bytes, and a table of a few megabytes, which may be millions of rows, is one or two tasks."""
    return rows.repartition(tasks * rows.sparkSession.sparkContext.defaultParallelism)


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as publication records: the first line is the title, the source the journal, the language a label."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("G"), F.col("doc_id").cast("string")).alias("guid"),
        F.trim(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("title"),
        F.col("source").alias("journal"),
        F.col("source").alias("authors"),
        F.col("lang").alias("labels"),
        "text",
        "n_chars",
        (F.col("lang") == "es").alias("trashed"),
    )


#: The same in SQL, as a common table expression named p.
PUBLICATIONS_SQL = r"""p AS (
  SELECT doc_id, 'G' || CAST(doc_id AS VARCHAR) AS guid, trim(regexp_extract(text, '^([^\n]*)', 1), ' ') AS title, source AS journal, source AS authors,
         lang AS labels, text, n_chars, lang = 'es' AS trashed
  FROM documents
)"""
#: Lower-case words of a text in SQL.
WORDS_SQL = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
