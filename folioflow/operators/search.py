"""Fielded keyword search: query strings to conditions, pages, counts, and a token index."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import SEARCH_FIELDS, QueryError

_TERM = re.compile(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))')
_WORDS = r"[^\p{L}\p{N}]+"
#: Rows that stood for "all" in a list that a person scrolls through; an option, since it drops the rest. Fixed value.
ALL_ROWS = 999_999
#: Above this many matches the ordering flag is off, where a caller asks for that.
SORT_LIMIT = 5000


def parse_query(query: str | None) -> list[tuple[str | None, str, bool]]:
    """(field, text, is phrase) of each term; terms are joined by and."""
    out = []
    for field, phrase, word in _TERM.findall(query or ""):
        if phrase or word:
            out.append((field or None, phrase or word, bool(phrase)))
    return out


def compose(base: str | None, query: str | None, field: str | None = None) -> str:
    """Base query and input side by side; a field restriction goes to each part of the input."""
    parts = (query or "").split()
    if field:
        parts = [f"{field}:{p}" for p in parts]
    return " ".join(x for x in [(base or "").strip(), *parts] if x)


def tokens(c: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), _WORDS), lambda w: w != "")


def term(column: Column, text: str) -> Column:
    """Whether the words of ``text`` stand one after the other in a column; a trailing * leaves the last word open."""
    words = [w for w in re.split(r"[\W_]+", text.lower().rstrip("*")) if w]
    if not words:
        return F.lit(True)
    edge = "" if text.endswith("*") else r"(?![\p{L}\p{N}])"
    pattern = r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(map(re.escape, words)) + edge
    return F.coalesce(F.lower(column.cast("string")).rlike(pattern), F.lit(False))


def condition(query: str | None, fields: Mapping[str, Column], ids: Mapping[str, Column] | None = None) -> Column:
    """A query as a condition. fields: searchable columns by name; ids: columns that match whole values.

    An empty query is true; a term without a field may match any searchable column."""
    out = F.lit(True)
    for field, text, _ in parse_query(query):
        if field is None:
            some = F.lit(False)
            for c in fields.values():
                some = some | term(c, text)
            out = out & some
        elif ids and field in ids:
            c = ids[field]
            out = out & F.coalesce(c == F.lit(text), F.lit(False))
        elif field in fields:
            out = out & term(fields[field], text)
        elif field in SEARCH_FIELDS:
            out = out & F.lit(False)
        else:
            raise QueryError(f"unknown field {field}")
    return out


def search(df: DataFrame, query: str | None, fields: Mapping[str, Column], ids: Mapping[str, Column] | None = None, trash: bool | None = None) -> DataFrame:
    """Matching rows; of the trash, or of the rest, where that is said."""
    if trash is not None:
        df = df.where(F.col("trashed") == F.lit(trash))
    return df.where(condition(query, fields, ids))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, offset: int = 0, limit: int = 10, order: list | None = None) -> DataFrame:
    """Rows offset to offset + limit in an order that the caller makes total; an offset beyond the end gives none."""
    return (df.orderBy(*order) if order else df).offset(offset).limit(limit)


def all_rows(df: DataFrame, order: list | None = None, most: int | None = None) -> DataFrame:
    """Every row, or the first ``most`` of them where a caller wants a bound."""
    if most is not None:
        return page(df, 0, most, order)
    return df.orderBy(*order) if order else df


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("long")


def light(df: DataFrame, columns: list[str]) -> DataFrame:
    """A projection for lists; the scan reads no other columns."""
    return df.select(*columns)


def token_index(df: DataFrame, key: str, fields: Mapping[str, Column], only: list[Column] | None = None) -> DataFrame:
    """key, field, token, pos: the inverted index as a table.

    only: conditions on ``F.col("token")``, one of which a token must meet to be in it; they are tested before rows are made."""
    parts = []
    for name, c in fields.items():
        places = F.transform(tokens(c), lambda t, k: F.struct(k.alias("pos"), t.alias("token")))
        part = df.select(F.col(key), F.lit(name).alias("field"), F.explode(places).alias("_p")).select(key, "field", "_p.pos", "_p.token")
        parts.append(part if only is None else part.where(reduce(or_, only)))
    return reduce(DataFrame.unionByName, parts)


#: Files that a stored index is dealt to by token, and parts of each by record, for tokens that nearly every record has.
BUCKETS, SALTS = 256, 8
#: Characters of texts for each part of a bucket, beyond which there are more parts; and for each task that sorts and writes.
SALT_CHARS, TASK_CHARS = 1 << 26, 1 << 22


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


@dataclass
class StoredIndex:
    """An inverted index that was written once: a folder for each bucket of tokens, in it files with rows in order of token and field.

    Tasks and parts of a bucket grow in number with the texts, so what one task sorts does not."""

    table: DataFrame
    key: str
    buckets: int

    @classmethod
    def write(cls, df: DataFrame, key: str, fields: Mapping[str, Column], path: str, buckets: int = BUCKETS) -> StoredIndex:
        size = df.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.length(c), F.lit(0)).cast("long") for c in fields.values()))), F.lit(0))).first()[0]
        salts, tasks = max(SALTS, -(-size // SALT_CHARS)), max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_CHARS))
        rows = token_index(df, key, fields).withColumn("bucket", _bucket(F.col("token"), buckets))
        rows = rows.repartition(tasks, F.col("bucket"), F.pmod(F.xxhash64(key), F.lit(salts))).sortWithinPartitions("bucket", "token", "field", key)
        rows.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#token", "true").parquet(path)
        return cls.read(df.sparkSession, path, key, buckets)

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> StoredIndex:
        return cls(spark.read.parquet(path), key, buckets)

    def hits(self, words: list[str], starts: list[str]) -> DataFrame:
        """Rows of some words, read from their buckets alone, and of words with some beginnings, read from all."""
        t = F.col("token")
        own = [(t == w) & (F.col("bucket") == _bucket(F.lit(w), self.buckets)) for w in words] + [t.startswith(x) for x in starts]
        return self.table.where(reduce(or_, own)).drop("bucket")


def _query_words(query: str) -> list[tuple[str | None, list[str], bool]]:
    """Of each term its field, its words, and whether the last one is only a beginning."""
    out = []
    for field, text, _ in parse_query(query):
        words = [w for w in re.split(r"[\W_]+", text.lower().rstrip("*")) if w]
        if words:
            out.append((field, words, text.endswith("*")))
    return out


def wanted_tokens(query: str) -> list[Column]:
    """The tokens that a query needs, as conditions for ``token_index``."""
    t = F.col("token")
    return [t.startswith(w) if open_ and k == len(words) - 1 else t == w for _, words, open_ in _query_words(query) for k, w in enumerate(words)] or [F.lit(True)]


def index_search(index: DataFrame | StoredIndex, key: str, query: str) -> DataFrame:
    """Keys whose texts hold all terms. A phrase's words stand at consecutive places of one field.

    One pass over the hits: each votes for the place where its term would begin, and a begin needs a vote of each
    word of the term. A word at the end of a term may be a beginning (``wor*``)."""
    terms = _query_words(query)
    if not terms:
        return (index.table if isinstance(index, StoredIndex) else index).select(key).distinct()
    t, words, starts, votes = F.col("token"), [], [], []
    for n, (field, parts, open_) in enumerate(terms):
        for k, w in enumerate(parts):
            prefix = open_ and k == len(parts) - 1
            (starts if prefix else words).append(w)
            hit = t.startswith(w) if prefix else t == w
            if field is not None:
                hit = hit & (F.col("field") == field)
            votes.append(F.when(hit, F.array(F.struct(F.lit(n).alias("term"), F.lit(k).alias("k"), F.lit(len(parts)).alias("size")))).otherwise(F.array().cast("array<struct<term:int,k:int,size:int>>")))
    rows = index.hits(words, starts) if isinstance(index, StoredIndex) else index.where(reduce(or_, wanted_tokens(query)))
    rows = rows.select(key, "field", "pos", F.explode(F.concat(*votes)).alias("_v"))
    begins = rows.groupBy(key, "field", "_v.term", "_v.size", (F.col("pos") - F.col("_v.k")).alias("begin")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == F.col("size"))
    return begins.select(key, "term").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(terms)).select(key)


def typeahead(journals: DataFrame, text: str) -> DataFrame:
    """Journals with a word that starts with the input, from two characters on."""
    if len(text) < 2:
        return journals.limit(0)
    starts = lambda c: F.exists(tokens(F.col(c)), lambda w: w.startswith(text.lower()))
    return journals.where(starts("short") | starts("long")).orderBy("short")
