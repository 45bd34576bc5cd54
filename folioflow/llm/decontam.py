"""Benchmark decontamination with an FM-index per shard of training text.

A benchmark item's test phrases are its windows of ``window`` consecutive words (an item of fewer
words is one phrase). A shard is a bounded number of consecutive documents of a partition. Its text is
indexed over the alphabet of the benchmark's words: every other word is a separator, neighbouring
separators are one, and so are runs too short to hold the shortest phrase, none of which can be part
of an occurrence. All phrases are searched backwards at once through wavelet-tree ranks, occurrences
are located by sampled suffix positions, and overlapping ones merge into spans.

The phrases are sent to the executors in parts of at most ``PART_BYTES`` of benchmark text; a larger
benchmark takes one pass over the documents for each part, whose spans are merged per document.

Null texts and items have no words and match nothing; a null id stays null; repeated rows are searched
each on its own; an empty benchmark hits nothing; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import alnum_words, column_bytes, fields, map_arrow
from .fmindex import FMIndex

WINDOW = 10
#: Benchmark text sent to the executors at once.
PART_BYTES = 4 << 20
#: Indexed words of a shard, and the words that it may read for them.
SHARD_WORDS, SHARD_READ = 1 << 20, 1 << 22

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


class Phrases:
    """Test phrases as right-aligned rows of word ids, and the items of each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in alnum_words((text or "").encode())]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                rows.setdefault(tuple(words[k : k + window]), set()).add(item)
        keys = list(rows)
        self.items = [sorted(rows[k], key=str) for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.matrix = np.zeros((len(keys), window), np.int32)
        for r, k in enumerate(keys):
            self.matrix[r, window - len(k) :] = k
        self.least = int(self.lengths.min()) if keys else 0


def shard_hits(phrases: Phrases, docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each document (word ids, 0 for other words) the occurrences as (start, end, phrase)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not phrases.items or not docs:
        return out
    sizes = np.array([len(d) + 1 for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    whole = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int32))])
    edge = np.flatnonzero(np.diff((whole != 0).astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= phrases.least
    begin, end = begin[long], end[long]
    if not len(begin):
        return out
    size = end - begin
    to = np.concatenate([[0], np.cumsum(size + 1)])  # each run and a separator after it
    at = np.repeat(begin - to[:-1], size + 1) + np.arange(to[-1])
    symbols = np.concatenate([[0], whole[at]]).astype(np.int32)  # a run ends at a 0 of the text or its end
    symbols[to[1:]] = 0
    at = np.concatenate([[-1], at])
    index = FMIndex(symbols, len(phrases.ids))
    lo, hi = index.search(phrases.matrix, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    if not len(found):
        return out
    which = np.repeat(found, count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)
    place = at[index.locate(rows)]
    doc = np.searchsorted(starts, place, "right") - 1
    for d, p, w in zip(doc.tolist(), (place - starts[doc]).tolist(), which.tolist(), strict=True):
        out[d].append((p, p + int(phrases.lengths[w]), w))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _shards(batches, text_at: int, ids: dict[bytes, int]):
    """Batches cut into shards: (batch slice, word ids of its documents)."""
    get = ids.get
    for batch in batches:
        docs, start, kept, read = [], 0, 0, 0
        for k, t in enumerate(column_bytes(batch.column(text_at))):
            docs.append(np.fromiter((get(w, 0) for w in alnum_words(t)), np.int32))
            kept += np.count_nonzero(docs[-1])
            read += len(docs[-1])
            if kept >= SHARD_WORDS or read >= SHARD_READ:
                yield batch.slice(start, k + 1 - start), docs
                docs, start, kept, read = [], k + 1, 0, 0
        if docs:
            yield batch.slice(start), docs


def _parts(benchmark: DataFrame, part_bytes: int):
    """The benchmark's items in parts of bounded size, read by the driver one part at a time."""
    table = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    size = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(-(-size // part_bytes)) or 1
    for k in range(n):
        part = table if n == 1 else table.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield n, part.toArrow().to_pylist()


def find_hits(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The key columns, n_words, merged ``spans`` (word numbers) and the ``items`` that occur, sorted as strings."""
    spark = docs.sparkSession
    schema = T.StructType(
        [*fields(docs, keys), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
    )
    results, n = [], 1
    for n, rows in _parts(benchmark, part_bytes):
        phrases = spark.sparkContext.broadcast(Phrases([(r["item_id"], r["text"]) for r in rows], window))
        if n == 1:
            return _search(docs, phrases, keys, text, schema)
        # the digest tells rows with equal keys apart
        own = docs.withColumn("_digest", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
        results.append(_search(own, phrases, [*keys, "_digest"], text, T.StructType([*schema[: len(keys)], T.StructField("_digest", T.StringType()), *schema[len(keys) :]])))
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    whole = (
        every.groupBy(*keys, "_digest", "n_words")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count(F.lit(1)) / n).cast("int").alias("_rows"))
        .select(*keys, "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "_rows")).alias("_row"))  # equal rows again
        .drop("_row")
    )

    def union(batch: pa.RecordBatch):
        spans = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in x])] for x in batch.column(len(keys) + 1).to_pylist()]
        return [*(batch.column(k) for k in range(len(keys) + 1)), spans, batch.column(len(keys) + 2)]

    return map_arrow(whole, union, schema)


def _search(docs: DataFrame, phrases, keys: list[str], text: str, schema: T.StructType) -> DataFrame:
    def run(batch: pa.RecordBatch):
        p, sizes, spans, items = phrases.value, [], [], []
        for _, words in _shards([batch], len(keys), p.ids):
            for d, hits in zip(words, shard_hits(p, words), strict=True):
                sizes.append(len(d))
                spans.append([{"start": a, "end": b} for a, b in merged([h[:2] for h in hits])])
                items.append(sorted({str(i) for h in hits for i in p.items[h[2]]}))
        return [*(batch.column(k) for k in range(len(keys))), sizes, spans, items]

    return map_arrow(docs.select(*keys, F.col(text).cast("string").alias("_text")), run, schema)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to its last."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of ``docs``, with the spans of benchmark phrases taken out of its text; null texts stay null.

    Every part is searched in the uncut text; its spans go along in a column, and the last pass cuts them all."""
    spark, at, width = docs.sparkSession, docs.columns.index(text), len(docs.columns)
    schema = T.StructType(fields(docs, docs.columns))
    along = T.StructType([*schema, T.StructField("_" * (1 + max(map(len, docs.columns))), T.ArrayType(SPAN))])  # longer than any name of docs
    out = docs
    for k, (n, rows) in enumerate(_parts(benchmark, part_bytes)):
        phrases = spark.sparkContext.broadcast(Phrases([(r["item_id"], r["text"]) for r in rows], window))

        def run(batch: pa.RecordBatch, phrases=phrases, first=k == 0, last=k == n - 1):
            p, spans = phrases.value, []
            for piece, words in _shards([batch], at, p.ids):
                before = [()] * piece.num_rows if first else piece.column(width).to_pylist()
                for old, hits in zip(before, shard_hits(p, words), strict=True):
                    spans.append(merged([(s["start"], s["end"]) for s in old] + [h[:2] for h in hits]))
            columns = [batch.column(c) for c in range(width)]
            if last:
                columns[at] = [without_spans(t.encode(), s).decode() if s else t for t, s in zip(columns[at].to_pylist(), spans, strict=True)]
                return columns
            return [*columns, [[{"start": a, "end": b} for a, b in x] for x in spans]]

        out = map_arrow(out, run, schema if k == n - 1 else along)
    return out
