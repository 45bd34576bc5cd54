"""Corpus preparation: the stages of a training-data run over ``documents``, in order.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; its
result is written as Parquet and read again as the next one's docs. All but the last return the columns
of ``docs``; where a stage changes a text, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontam, minhash, mixing, pii, toxicity
from folioflow.llm._store import work_dir, written
from folioflow.llm.queries import WEIGHTS

#: Near-duplicates share this many percent of their shingles of so many words.
SHINGLE, PERCENT = 5, 80


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" not in like.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(like.schema["n_chars"].dataType)).select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold; labels only train the classifier.

    Whole texts are scored, of any length. A null or empty text has the score of a text without windows and stays unless that is a language's threshold
    or more. Repeated rows and ids are judged each for itself, so they go or stay together. A score that equals the threshold goes. Without
    labels of both kinds every document has the same score. An empty table stays empty."""
    model = toxicity.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    more = ["lang"] if "lang" in docs.columns else []
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", *more)  # no column of docs can clash with the score's
    return toxicity.score(rows, model, ["row"], lang="lang").where(~F.col("toxic")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id, null ids last.

    Where ids repeat or are null, rows are judged by their texts alone, under numbers in the order of ids and texts."""
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if again.isEmpty():
        found = minhash.near_duplicates(docs, size=SHINGLE, percent=PERCENT)
        return docs.join(found.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    order = [F.col(c).asc_nulls_last() for c in ("doc_id", "text", *(c for c in ("lang", "source") if c in docs.columns))]
    rows = docs.orderBy(*order).select(F.struct(*docs.columns).alias("row"), "text").withColumn("doc_id", F.monotonically_increasing_id())
    rows = written(rows, f"{work_dir(spark, 'rows')}/numbered")  # numbers must not change between reads
    found = minhash.near_duplicates(rows.select("doc_id", "text"), size=SHINGLE, percent=PERCENT)
    return rows.join(found.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select("row.*")


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that hold ten consecutive words of a benchmark item.

    Passages that overlap go as one. Null texts stay null, empty ones empty; a text that is nothing but such passages becomes empty and stays. Repeated rows
    are changed alike. An empty benchmark, or items without words, change nothing. Texts of any length are searched whole."""
    return _recounted(decontam.remove_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind.

    Null texts stay null, empty ones empty. Spans that overlap are masked as one, by the kind of the one that begins first, the longest of these. Repeated rows are changed alike;
    texts of any length are searched whole."""
    return _recounted(pii.redact(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in a sequence that interleaves the sources by target weights.

    Every row gets a place: a null source counts as the empty one, and null or empty texts and repeated ids are rows like others. Rows of a source follow
    a hash of the whole row; rows that are equal in all columns follow each other in any order. An empty table stays empty."""
    return mixing.mix(docs, WEIGHTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("pii", mask_pii),
    ("mixing", mix_sources),
]

#: No SQL: a trained classifier and regular expressions with checksums decide; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{path}/{k}-{name}")
    return docs
