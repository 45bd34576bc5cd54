"""Target-distribution importance resampling with a dictionary of distinct n-gram strings.

1. Tasks gather texts by some ``GATHER`` bytes, find their distinct n-grams with their counts by sorting numbers, and deal the n-gram
   strings to shards, packed: an n-gram is one entry of each such piece, however often the piece has it, so no n-gram is hot.
2. A shard merges the strings of all pieces into its part of the global dictionary, hashes each distinct string
   once and adds its counts to its bucket.
3. Buckets are aggregated to the gains of the target distribution (a row for each bucket, a fixed number).
4. The gains are joined back, by buckets, to the n-gram counts of every document. There a bucket is put together from hashes of the distinct words
   (a crc32 of a string follows from those of its parts), so nothing of the dictionary's size goes back to the documents.
5. Documents get their random keys and the highest are drawn: a sort by ranges, whose sizes give the ranks.

Null and empty texts have no features and weight 0. Repeated rows count each for itself. With an empty table of
documents or of targets the other's counts still give gains. Ranks of rows that are equal in score and id are in any order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._store import work_dir, written
from ._text import alnum_spaced, column_bytes, fields, map_arrow, settle
from .blocks import classes, numbered, packed, parted, squeezed, unpacked, word_array

#: Whose n-grams are counted.
SIDES = ("documents", "target")
#: Words of an n-gram at most.
MOST = 3
#: Numbers of hash buckets, and what smooths their logarithms.
BUCKETS = 10_000
#: Bytes of text whose n-grams a task counts at once, unless a single text has more.
GATHER = 16 << 20
#: Bytes of text for each shard of the dictionary, and parts of a shard that are merged one after the other.
SHARD_BYTES, PARTS = 40 << 20, 4


def grams(ids: np.ndarray, edge: int, most: int = MOST):
    """For each length: the distinct n-grams as columns of word numbers, sorted; where n-grams start; the distinct one there; their counts."""
    inside = ids != edge
    starts = np.flatnonzero(inside)
    which = np.zeros(len(ids), np.int64)
    for n in range(1, most + 1):
        if n > 1:
            starts = starts[inside[starts + n - 1]]  # a boundary stands behind every text, so this is inside the array
        some, inverse, counts = classes(which[starts] << 32 | ids[starts + n - 1])
        yield ids[starts[some][None, :] + np.arange(n)[:, None]], starts, inverse, counts
        which[starts] = inverse  # n-grams of the next length start where some of these do


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _dealt(columns: np.ndarray, digests: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram, by its words alone."""
    mix = np.zeros(columns.shape[1], np.uint64)
    for j, c in enumerate(columns):
        mix += (digests[c] + np.uint64(j + 1)) * _ODD[j % len(_ODD)]
    mix ^= mix >> np.uint64(29)
    mix *= _ODD[0]
    return ((mix >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by their shards, else as they stand, and where each shard's begin."""
    small = shard.astype(np.uint16) if shards <= 1 << 16 else shard  # numbers of two bytes are sorted by radix
    order = np.argsort(small, kind="stable").astype(np.int32 if len(shard) < 1 << 31 else np.int64)
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
#: Bytes of strings that are hashed side by side; longer ones are hashed one by one.
SIDE_BY_SIDE = 96


def crc32_of(strings: pa.Array) -> np.ndarray:
    """zlib's crc32 of each string, a byte of all strings at a time."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    size = np.diff(ends)
    out = np.empty(len(strings), np.int64)
    for k in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        out[k] = zlib.crc32(raw[ends[k] : ends[k + 1]])
    short = np.flatnonzero(size <= SIDE_BY_SIDE)
    order = short[np.argsort((SIDE_BY_SIDE - size[short]).astype(np.uint8), kind="stable")]
    start, longer = ends[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    n = np.searchsorted(-longer, -np.arange(int(longer.max(initial=0)))) if len(order) else ()  # strings with a byte at each place
    for k in n:
        crc[:k] = _CRC[(crc[:k] ^ raw[start[:k]]) & np.uint32(255)] ^ crc[:k] >> np.uint32(8)
        start[:k] += 1
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _shift_tables() -> np.ndarray:
    """For each number of bytes, what a crc32 becomes when so many zeros follow, by its four bytes."""
    out = np.empty((SIDE_BY_SIDE + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(SIDE_BY_SIDE):
        out[k + 1] = _CRC[out[k] & np.uint32(255)] ^ out[k] >> np.uint32(8)
    return out.reshape(-1)


_SHIFTS = _shift_tables()


def gram_hashes(words: list[bytes], ids: np.ndarray, most: int = MOST):
    """For each length: where n-grams start, and the crc32 of each one's bytes, put together from those of its words."""
    tails = [b" " + w for w in words]
    own, tail = (np.fromiter(map(zlib.crc32, x), np.uint32, len(x)) for x in (words, tails))
    size = np.fromiter(map(len, tails), np.int64, len(tails))
    inside = ids != len(words)
    starts = np.flatnonzero(inside)
    crc = own[ids[starts]]
    for n in range(1, most + 1):
        if n > 1:
            go_on = inside[starts + n - 1]  # a boundary stands behind every text, so this is inside the array
            starts, crc = starts[go_on], crc[go_on]
            last = ids[starts + n - 1]
            long = np.flatnonzero(size[last] > SIDE_BY_SIDE)
            by_hand = [zlib.crc32(tails[w], int(c)) for w, c in zip(last[long].tolist(), crc[long].tolist(), strict=True)]
            at = np.minimum(size[last], SIDE_BY_SIDE) * 1024
            shifted = tail[last]
            for j in range(4):
                shifted ^= _SHIFTS[at + (256 * j) + (crc >> np.uint32(8 * j) & np.uint32(255))]
            crc = shifted
            crc[long] = by_hand
        yield starts, crc


def _digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.adler32(w) << 32 | zlib.crc32(w) for w in words), np.uint64, len(words))


def _strings(known: pa.Array, columns: np.ndarray) -> pa.Array:
    parts = [known.take(pa.array(c)) for c in columns]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))


def _read(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary of some texts, and their words' numbers with a boundary behind every text."""
    return numbered(parted(b" \xff ".join(map(alnum_spaced, texts)) + b" \xff"))


def _piece(texts: list[bytes], shards: int):
    """(shard, blob): the distinct n-grams of some texts with their counts, by part of the shard."""
    words, ids = _read(texts)
    if not words:
        return
    digests, parts = _digests(words), []
    for columns, _, _, counts in grams(ids, len(words)):
        parts.append((columns.astype(np.int32), counts.astype(np.int32), *_by_shard(_dealt(columns, digests, shards * PARTS), shards * PARTS)))
    del ids, digests
    place = np.empty(len(words), np.int64)
    for s in range(shards):
        own = [[(c[:, o[e[k] : e[k + 1]]], n[o[e[k] : e[k + 1]]]) for c, n, o, e in parts] for k in range(s * PARTS, (s + 1) * PARTS)]
        used = np.zeros(len(words), bool)
        for c, _ in (x for part in own for x in part):
            used[c] = True
        used = np.flatnonzero(used)
        if not len(used):
            continue
        place[used] = np.arange(len(used))
        sent = [squeezed([words[k] for k in used.tolist()])]
        for part in own:
            out = []
            for c, n in part:
                c = place[c]
                out += [np.diff(c[0], prepend=0), *c[1:], n - 1]
            sent.append(packed(*out))
        yield s, np.array([len(x) for x in sent], np.int64).tobytes() + b"".join(sent)


def _sent(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, side, blob): the distinct n-grams of each piece of the texts (side, text), with their counts."""
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("side", T.StringType()), T.StructField("blob", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0

        def out():
            for side, some in held.items():
                for s, blob in _piece(some, shards):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([side]), pa.array([blob], pa.binary())], schema=arrow)
            held.clear()

        for batch in batches:
            for side, t in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)), strict=True):
                held.setdefault(side, []).append(t)
                size += len(t)
                if size >= GATHER:
                    yield from out()
                    size = 0
                    settle()
        yield from out()
        settle()

    return texts.select("side", "text").mapInArrow(run, schema)


def _received(blob: bytes, part: int) -> tuple[pa.Array, np.ndarray]:
    """The n-gram strings of a part of a blob, and their counts."""
    ends = 8 * (PARTS + 1) + np.cumsum(np.frombuffer(blob, np.int64, PARTS + 1))
    known, own = word_array(blob[8 * (PARTS + 1) : ends[0]]), unpacked(blob[ends[part] : ends[part + 1]])
    strings, counts, at = [], [], 0
    for n in range(1, MOST + 1):
        strings.append(_strings(known, np.stack([np.cumsum(own[at]), *own[at + 1 : at + n]])))
        counts.append(own[at + n] + 1)
        at += n + 1
    return pa.concat_arrays(strings), np.concatenate(counts)


def _dictionary(sent: DataFrame, buckets: int) -> DataFrame:
    """(sums): of each shard's distinct strings, each hashed once, the counts by bucket."""
    schema = T.StructType([T.StructField("sums", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def merged(table: pa.Table) -> pa.Table:
        sides, sums = table.column("side").to_pylist(), {side: np.zeros(buckets, np.int64) for side in SIDES}
        for k in range(PARTS):
            strings, counts = zip(*(_received(b.as_py(), k) for b in table.column("blob")), strict=True)
            entries = pa.concat_arrays(strings).dictionary_encode()
            del strings
            hashed = crc32_of(entries.dictionary) % buckets  # each distinct string once
            place, at = entries.indices.to_numpy(), 0
            n_entries = {side: np.zeros(len(hashed), np.int64) for side in SIDES}
            for some, side in zip(counts, sides, strict=True):
                n_entries[side][place[at : at + len(some)]] += some  # a piece's strings are distinct
                at += len(some)
            for side, n in n_entries.items():
                np.add.at(sums[side], hashed, n)
            del entries, place, hashed, n_entries, counts
            settle()
        return pa.table([pa.array([packed(*sums.values())], pa.binary())], schema=arrow)

    return sent.groupBy("shard").applyInArrow(merged, schema)


def _bucket_sums(dictionary: DataFrame) -> DataFrame:
    """(bucket, s, t): n-grams of the documents and of the target in each bucket."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "s", "t")])

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                s, t = unpacked(blob.as_py())
                some = np.flatnonzero(s + t)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(s[some]), pa.array(t[some])], names=["bucket", "s", "t"])

    rows = dictionary.mapInArrow(run, schema)
    return rows.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def gains(sums: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of each bucket over the documents': as many numbers as buckets."""
    spark = sums.sparkSession
    whole = spark.range(buckets).select(F.col("id").alias("bucket")).join(sums, "bucket", "left").fillna(0, ["s", "t"])
    rows = np.array(sorted((r["bucket"], r["s"], r["t"]) for r in whole.collect()), np.int64)  # one row for each bucket, a fixed number
    s, t = rows[:, 1].astype(float), rows[:, 2].astype(float)
    every, wanted = float(rows[:, 1].sum()), float(rows[:, 2].sum())
    return np.floor(1000 * np.log((t + 1) * (every + buckets) / ((s + 1) * (wanted + buckets)))).astype(np.int64)


def feature_weights(docs: DataFrame, target: DataFrame, keys: list[str], buckets: int = BUCKETS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """keys, n_words, n_features and the sum of gains of every document's n-grams.

    docs and target need a column ``text``. An n-gram's gain is found by its bucket: a table of ``buckets`` numbers goes to every task."""
    spark = docs.sparkSession
    path = work_dir(spark, "importance")
    texts = docs.select(F.lit(SIDES[0]).alias("side"), "text").unionByName(target.select(F.lit(SIDES[1]).alias("side"), "text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, size // shard_bytes + 1)
    dictionary = written(_dictionary(_sent(texts, shards), buckets), f"{path}/dictionary")
    gain = gains(_bucket_sums(dictionary), buckets)
    schema = T.StructType([*fields(docs, keys), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batch: pa.RecordBatch):
        words, ids = _read(list(column_bytes(batch.column(len(keys)))))
        ends = np.flatnonzero(ids == len(words))
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
        n_features, weight = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        for starts, crc in gram_hashes(words, ids):
            own = doc[starts]
            n_features += np.bincount(own, minlength=len(ends))
            weight += np.bincount(own, gain[crc % np.uint32(buckets)], len(ends)).astype(np.int64)  # whole numbers far below 2 ** 53
        return [*(batch.column(k) for k in range(len(keys))), pa.array(np.diff(ends, prepend=-1) - 1), pa.array(n_features), pa.array(weight)]

    return written(map_arrow(docs.select(*keys, "text"), run, schema), f"{path}/weights")


def random_key(seed: Column) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) that a string fixes: the Gumbel part of a draw without replacement."""
    h = F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, order: list[Column], path: str, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in a total order, from 1: sorted by ranges, and ranges counted before."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_at", T.LongType())])
    arrow = to_arrow_schema(schema)

    def places(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int64)), pa.array(np.arange(at, at + b.num_rows))], schema=arrow)
            at += b.num_rows

    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(places, schema), path)
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    before, sofar = [], 0
    for part, n in sizes:
        before.append((part, sofar))
        sofar += n
    offsets = spark.createDataFrame(before, "_part long, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).select(*df.columns, name)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Every document's n_words, n_features, weight and score; rank of those that are drawn, null for the others.

    Drawn are the ``percent`` of the documents with ``least_words`` words at least that have the highest scores."""
    spark = docs.sparkSession
    found = feature_weights(docs, target, [key])
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    scored = found.withColumn("score", F.col("weight") + random_key(name))
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.col("score").desc(), F.col(key).asc_nulls_last()]
    top = ranked(fit, order, f"{work_dir(spark, 'ranked')}/rows").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
