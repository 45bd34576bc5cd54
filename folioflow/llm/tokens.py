"""Token counts through a digest cache.

Content is normalised (null to empty, runs of ASCII white space to one space, none at the ends) and
digested; the digest and the tokenizer's version digest are the key of a stored count. Only distinct
digests that the cache lacks are encoded, and their counts are appended to the cache.

The white-space step may be used because the tokenizer file's own normaliser and splitter drop white
space (``collapse`` says so; turn it off for a tokenizer for which white space counts). For the same
reason each word between ASCII white space can be encoded by the library on its own and its count be
kept for the next text; a test compares whole texts.

Defined results: a null or empty text has no bytes and no tokens; a null id stays null; repeated rows
each get a row and share one cache entry; an empty table gives an empty result and no cache entries.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import exists, work_dir, written
from ._text import SLICE_BYTES, column_bytes, fields, map_arrow, settle, slices

#: Words, and bytes of them, whose counts a worker keeps at most in each of two generations.
MEMO_WORDS, MEMO_BYTES = 150_000, 4 << 20
#: Words that the library gets at once; its encodings are large.
STEP = 2000
#: Digests that a task remembers at most, so as not to send or encode a content twice.
SEEN = 100_000
#: A digest of more than this part of all rows is hot; there are at most as many hot ones as its inverse.
HOT = 1000

CACHE = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

_kept: dict[str, tuple] = {}


def tokenizer_version(spec: str, collapse: bool = True) -> str:
    return hashlib.sha256(f"{int(collapse)}:{spec}".encode()).hexdigest()


def normalised(text: bytes, collapse: bool = True) -> bytes:
    return b" ".join(text.split()) if collapse else text


class Memo:
    """Counts of words, bounded in words and bytes. A full generation becomes the old one and replaces it, so
    words that come again and again stay while words that came once go."""

    def __init__(self, words: int = MEMO_WORDS, size: int = MEMO_BYTES):
        self.words, self.size, self.new, self.old, self.held = words, size, {}, {}, 0

    def lookup(self, words: set[bytes], lengths) -> dict[bytes, int]:
        """The count of each of the words; ``lengths`` counts those that aren't known."""
        new, old = self.new, self.old
        known = {w: new[w] for w in words if w in new}
        again = {w: old[w] for w in words if w not in known and w in old}
        missing = [w for w in words if w not in known and w not in again]
        again.update(zip(missing, lengths([w.decode() for w in missing]), strict=True))
        size = sum(map(len, again))
        if len(new) + len(again) > self.words or self.held + size > self.size:
            self.old, self.new, self.held = new, {}, 0
        if len(again) <= self.words and size <= self.size:
            self.new.update(again)
            self.held += size
        known.update(again)
        return known


def counter(spec: str, version: str, collapse: bool = True):
    """A function from a list of normalised texts to their counts; one per worker and version."""
    if version not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; a thread pool in each only waits
        from tokenizers import Tokenizer

        _kept.clear()
        _kept[version] = (Tokenizer.from_str(spec), Memo())
    tokenizer, memo = _kept[version]

    def lengths(texts: list[str]) -> list[int]:
        return [len(e.ids) for k in range(0, len(texts), STEP) for e in tokenizer.encode_batch_fast(texts[k : k + STEP], add_special_tokens=False)]

    def count(texts: list[bytes]) -> list[int]:
        if not collapse:
            return [n for t in texts for n in lengths([t.decode()])]
        split = [t.split() for t in texts]
        known = memo.lookup(set().union(*split), lengths)
        return [sum(map(known.__getitem__, words)) for words in split]

    return count


def digests(df: DataFrame, keys: list[str], text: str, collapse: bool) -> DataFrame:
    """The key columns, n_bytes and digest of each row."""
    schema = T.StructType([*fields(df, keys), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType())])

    def run(batch: pa.RecordBatch):
        sizes, out = [], []
        for t in column_bytes(batch.column(len(keys))):
            sizes.append(len(t))
            out.append(hashlib.sha256(normalised(t, collapse)).digest())
        return [*(batch.column(k) for k in range(len(keys))), sizes, out]

    return map_arrow(df.select(*keys, F.col(text).cast("string").alias("_text")), run, schema)


def contents(df: DataFrame, text: str, collapse: bool) -> DataFrame:
    """Digest and compressed normalised content; each task sends a digest once, or more often beyond SEEN of them."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("content", T.BinaryType())])

    def run(batches):
        seen, pack = set(), zstandard.ZstdCompressor(1)
        for batch in batches:
            for piece in slices(batch):
                ids, out = [], []
                for t in column_bytes(piece.column(0)):
                    n = normalised(t, collapse)
                    d = hashlib.sha256(n).digest()
                    if d not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        ids.append(d)
                        out.append(pack.compress(n))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.binary())], names=["digest", "content"])
        settle()

    return df.select(F.col(text).cast("string")).mapInArrow(run, schema)


def fill_cache(df: DataFrame, cache: str, spec: str, text: str = "text", collapse: bool = True) -> None:
    """Encode the distinct contents that the cache lacks and append their counts to it."""
    spark, version = df.sparkSession, tokenizer_version(spec, collapse)
    todo = contents(df, text, collapse)
    if exists(spark, cache):
        known = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).select("digest")
        todo = todo.join(known, "digest", "left_anti")
    sent = spark.sparkContext.broadcast(spec)  # one tokenizer file, a few MB

    def encode(batches):
        seen, unpack, count = set(), zstandard.ZstdDecompressor(), counter(sent.value, version, collapse)

        def out(ids, texts):
            return pa.RecordBatch.from_arrays([pa.array([version] * len(ids), pa.string()), pa.array(ids, pa.binary()), pa.array(count(texts), pa.int64())], names=CACHE.names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for k in range(batch.num_rows):
                d = batch.column(0)[k].as_py()
                if d in seen:  # the same digest from several tasks
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                ids.append(d)
                texts.append(unpack.decompress(batch.column(1)[k].as_py()))
                size += len(texts[-1])
                if size >= SLICE_BYTES:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield out(ids, texts)
        settle()

    todo.repartition("digest").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)


def count_tokens(df: DataFrame, keys: list[str], cache: str, spec: str, text: str = "text", collapse: bool = True) -> DataFrame:
    """The key columns, n_bytes and n_tokens of each row; new counts are in the cache afterwards.

    Rows meet the cache by digest. Digests of more than a thousandth of all rows are at most a thousand: these
    counts are broadcast, so a text with very many copies doesn't land in one task."""
    fill_cache(df, cache, spec, text, collapse)
    version, spark = tokenizer_version(spec, collapse), df.sparkSession
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    rows = written(digests(df, keys, text, collapse), f"{work_dir(spark, 'digests')}/rows")
    often = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, rows.count() // HOT))
    hot = known.join(F.broadcast(often.select("digest")), "digest").groupBy("digest").agg(F.max("n_tokens").alias("hot"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    rare = rows.where("hot is null").drop("hot")
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # an append that was retried may repeat a row
    out = rare.join(known, "digest", "left").select(*keys, "n_bytes", "n_tokens")
    return rows.where("hot is not null").select(*keys, "n_bytes", F.col("hot").alias("n_tokens")).unionByName(out)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def brute_counts(texts: list[str | None], spec: str) -> list[int]:
    """What the library gives for whole texts; for tests."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]

