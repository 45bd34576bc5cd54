"""Removal of repeated substrings by a distributed difference-cover suffix sort.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier: in a document with
a smaller id, or earlier in the same one. Strings are judged on the input and never cross documents.

Suffixes need only be ordered by their first LENGTH bytes, so the sort can be dealt to shards by what those
bytes contain: each string of LENGTH bytes has an anchor, the smallest hash of a ``GRAM``-byte piece in
it, and equal strings have equal anchors. Neighbouring strings with one anchor at one place form a run; a run's
text is its context. The texts are written once, to files of the shared folder; no later step shuffles them.

1. Which anchors are shared: every task sends the anchors of a file once, with the number of their runs. An
   anchor of one run only holds no repeat. Each file gets the list of its anchors that have more.
2. The contexts of these anchors go to shards by anchor; a task sends equal ones (compared byte by byte) once,
   since of them all but the first are repeats. Each shard is sorted by the difference cover modulo 3: triples at sampled
   places are sorted and named, names are sorted recursively until they cover LENGTH bytes, the other suffixes
   are merged in; then adjacent prefixes are compared byte by byte. Of each class of equal strings all but
   the first are repeats. The contexts of an anchor that has more than ``MOST_CONTEXTS`` of them are cut into
   their strings, which go to shards by their own hash.
3. Each file gets the repeats of its documents, merged to spans, and they are taken out of the texts.

Hashes only decide what is compared with what; every repeat is found by comparing bytes.

Anchors prefer rare pieces: pieces that recur in a bounded sample of documents (``SAMPLE_DOCS`` of them)
rank behind all others. That list only steers the choice of anchors, which any fixed order makes right;
it keeps strings that lie partly in a very common passage out of that passage's shard.

Defined results: a null or empty text has no bytes; rows with equal text: the smallest id comes first;
rows with the same id but different texts come in order of their texts' digests, null ids come last;
rows equal in both are one document, judged once; every row gets a result; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import fetched, put, work_dir, written
from ._text import column_bytes, fields, map_arrow, settle
from .dc3 import equal_prefixes, suffix_order
from .ngrams import _merged, _pack, _unpack

LENGTH, GRAM = 100, 24
#: Bits for a place in a chunk; longer texts are hashed in overlapping pieces.
PLACE_BITS = 24
PIECE = 1 << 22
#: Bytes hashed at once, text bytes per anchor shard, context bytes per sorting shard, least shards.
CHUNK, SHARD_BYTES, SORT_BYTES, LEAST_SHARDS = 1 << 18, 16 << 20, 1 << 20, 64
#: Usual bytes of a context; from them and the number of contexts follows the number of sorting shards.
CONTEXT = 140
#: Runs that a task gathers before it sends their anchors, and bytes of contexts before it sends these.
RUNS, SEND_BYTES = 1 << 21, 24 << 20
#: Rows of a file of texts at most.
FILE_ROWS = 1 << 20
#: Contexts of one anchor that are sorted together at most.
MOST_CONTEXTS = 5000
#: Documents of the sample for common pieces, and pieces in the list.
SAMPLE_DOCS, COMMON = 4000, 1 << 14
#: Bits of the table that marks common pieces; a piece that shares its place with one ranks behind, too.
MARK_BITS = 20
_SENT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("data", T.BinaryType())])
#: What goes back to a file of texts.
_REPLY = T.StructType([T.StructField("file", T.LongType()), T.StructField("data", T.BinaryType())])

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(18, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _tables[size] = tuple(out)
    return _tables[size]


class Hasher:
    """Hashes of any substring of a byte array, from running sums of a polynomial."""

    def __init__(self, s: np.ndarray):
        self.up, self.down = _powers(len(s) + 1)
        self.sums = np.empty(len(s) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((s.astype(np.uint64) + np.uint64(1)) * self.up[: len(s)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def runs(s: np.ndarray, doc: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the strings in a chunk of whole documents.

    s: bytes; doc: the document number of each byte; common: marks of common pieces. Returns anchor, context hash, start, strings."""
    width = LENGTH - GRAM + 1
    if len(s) < LENGTH:
        return tuple(np.empty(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64))
    hashed = Hasher(s)
    key = hashed.all(GRAM) >> np.uint64(1)
    if len(common):
        key |= common[key & np.uint64(len(common) - 1)]
    # the leftmost of the smallest: high bits of the hash, then the place
    place = np.uint64((1 << PLACE_BITS) - 1)
    low, w = (key & ~place) | np.arange(len(key), dtype=np.uint64), 1
    while 2 * w <= width:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    n = len(s) - LENGTH + 1
    low = np.minimum(low[:n], low[width - w : width - w + n]) & place
    valid = doc[:n] == doc[LENGTH - 1 :]
    cut = np.ones(n, bool)
    cut[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n)
    ok = valid[first]
    first, last = first[ok], last[ok]
    return key[low[first].astype(np.int64)], hashed.at(first, last + LENGTH - 1), first, last - first


def chunks(texts):
    """Documents, or overlapping pieces of long ones, some together: document numbers, offsets, bytes."""
    number, offset, held, size = [], [], [], 0
    for k, t in enumerate(texts):
        for lo in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            number.append(k)
            offset.append(lo)
            held.append(t[lo : lo + PIECE + LENGTH - 1])
            size += len(held[-1])
            if size >= CHUNK:
                yield np.array(number), np.array(offset), held
                number, offset, held, size = [], [], [], 0
    if held:
        yield np.array(number), np.array(offset), held


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in held], np.int64)
    return np.frombuffer(b"".join(held), np.uint8), np.repeat(np.arange(len(held)), sizes), np.cumsum(sizes) - sizes


def _batch(schema: T.StructType, keys: list, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32() if schema.names[0] == "shard" else pa.int64()), pa.array(data, pa.binary())], names=schema.names)


def _by_key(batches) -> Iterator[tuple[int, list[bytes]]]:
    """The data of each key of a task, key by key."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for s, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(s, []).append(d)
    for s in sorted(held):
        yield s, held.pop(s)


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, overlapping and touching ones merged."""
    by = np.lexsort((end, start, doc))
    doc, start, end = doc[by], start[by], end[by]
    if not len(doc):
        return doc, start, end
    # running maximum of ends within a document
    edge = np.concatenate([[True], doc[1:] != doc[:-1]])
    lift = np.cumsum(edge) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], (start + lift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def common_pieces(docs: DataFrame) -> np.ndarray:
    """Pieces that are anchors in several documents of a bounded sample, at most COMMON of them, as marks."""
    picked = docs.where(F.octet_length("text") >= LENGTH).select("doc").distinct().orderBy(F.xxhash64(F.lit("sample"), "doc")).limit(SAMPLE_DOCS)
    texts = docs.join(F.broadcast(picked), "doc").select("text")  # at most SAMPLE_DOCS ids
    schema = T.StructType([T.StructField("key", T.LongType())])

    def run(batches):
        for batch in batches:
            out = [np.empty(0, np.uint64)]
            for t in column_bytes(batch.column(0)):
                for _, _, pieces in chunks([t]):
                    s, piece, _ = _joined(pieces)
                    out.append(np.unique(runs(s, piece, np.empty(0, np.uint64))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["key"])

    counts = texts.mapInArrow(run, schema).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow()
    marks = np.zeros(1 << MARK_BITS, np.uint64)
    marks[rows["key"].to_numpy() & ((1 << MARK_BITS) - 1)] = 1 << 63
    return marks


def _cut(batches):
    """Chunks of a task's texts (doc, file, text): bytes, the piece of each byte, and doc, file and offset of each piece's first byte."""
    for batch in batches:
        ids, files = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for number, offset, held in chunks(column_bytes(batch.column(2))):
            s, piece, starts = _joined(held)
            yield s, piece, ids[number], files[number], offset - starts


def share_anchors(texts: DataFrame, shards: int, common: np.ndarray, uri: str, most: int = MOST_CONTEXTS) -> int:
    """Step 1: for each file of texts the anchors that have runs elsewhere, too. Returns the number of contexts to expect."""
    listed = texts.sparkSession.sparkContext.broadcast(common)  # a table of fixed size

    def send(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out():
            anchor, context, file = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((context, anchor, file))
            a, c, f = anchor[by], context[by], file[by]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (f[1:] != f[:-1])]))
            runs_of = np.diff(np.append(first, len(a)))
            new = np.ones(len(a), np.int64)
            new[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (f[1:] != f[:-1])
            contexts = np.add.reduceat(new, first)
            a, f = a[first], f[first]
            shard = (_mixed(a) >> np.uint64(33)).astype(np.int64) % shards
            by = np.lexsort((a, f, shard))
            a, f, shard = a[by], f[by], shard[by]
            # the number of contexts, and whether there are several runs
            n = (np.minimum(contexts[by], 1 << 30) * 2 + (runs_of[by] > 1)).astype(np.uint32)
            edge = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (f[1:] != f[:-1])]))
            keys, data = shard[edge].tolist(), []
            for lo, hi in zip(edge, np.append(edge[1:], len(a)), strict=True):
                data.append(int(f[lo]).to_bytes(8, "little", signed=True) + _pack(np.diff(a[lo:hi], prepend=np.uint64(0)), n[lo:hi]))
            return _batch(_SENT, keys, data)

        for s, piece, _, files, _ in _cut(batches):
            a, c, at, _ = runs(s, piece, listed.value)
            held.append((a, c, files[piece[at]]))
            size += len(a)
            if size >= RUNS:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        settle()

    def reply(batches):
        for _, parts in _by_key(batches):
            got = [_unpack(d[8:], np.uint64, np.uint32) for d in parts]
            anchors = [np.cumsum(a, dtype=np.uint64) for a, _ in got]
            keys, contexts, several = _merged(np.concatenate(anchors), np.concatenate([n >> 1 for _, n in got]).astype(np.int64), np.concatenate([n & 1 for _, n in got]).astype(np.int64))
            shared = (contexts > 1) | (several > 0)
            files, data = [-1], [int(contexts[shared].sum()).to_bytes(8, "little")]
            for d, a in zip(parts, anchors, strict=True):
                at = np.searchsorted(keys, a)
                if (own := shared[at]).any():
                    files.append(int.from_bytes(d[:8], "little", signed=True))
                    data.append(_pack(np.diff(a[own], prepend=np.uint64(0)), (contexts[at[own]] > most).view(np.uint8)))
            yield _batch(_REPLY, files, data)
        settle()

    def keep(batches):
        for file, parts in _by_key(batches):
            if file == -1:
                yield _batch(_REPLY, [file], [sum(int.from_bytes(d, "little") for d in parts).to_bytes(8, "little")])
                continue
            got = [_unpack(d, np.uint64, np.uint8) for d in parts]
            anchors = np.concatenate([np.cumsum(a, dtype=np.uint64) for a, _ in got])
            by = np.argsort(anchors)
            put(f"{uri}/anchors-{file}", anchors[by], np.concatenate([h for _, h in got])[by])
        settle()

    asked = texts.mapInArrow(send, _SENT).repartition(shards, "shard").mapInArrow(reply, _REPLY).repartition("file")
    return sum(int.from_bytes(r["data"], "little") for r in asked.mapInArrow(keep, _REPLY).collect())  # one row


def sorted_repeats(doc: np.ndarray, start: np.ndarray, texts: list[bytes], file: np.ndarray) -> tuple[np.ndarray, ...]:
    """File, doc, start and size of spans of strings that stand earlier in these contexts: suffix order, then adjacent prefixes."""
    # in the order of documents, so that a place in the joined contexts tells which of two strings comes first
    by = np.lexsort((start, doc))
    doc, start, file, texts = doc[by], start[by], file[by], [texts[k] for k in by.tolist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    ends = begin + sizes
    used = np.bincount(raw, minlength=256) > 0
    symbols = np.cumsum(used).astype(np.uint8 if used.sum() < 255 else np.int32) + 1  # bytes in use, numbered from 2
    s = symbols[raw]
    s[ends] = 1  # the end of a context
    mark = np.zeros(len(s) + 1, np.int32)  # steps into and out of the places where fewer than LENGTH bytes of a context are left
    np.add.at(mark, np.maximum(ends - LENGTH + 1, begin), 1)
    np.add.at(mark, ends + 1, -1)
    whole = np.cumsum(mark[:-1]) == 0
    order = suffix_order(s, int(used.sum()) + 1, LENGTH, wanted=whole)
    same = equal_prefixes(raw, order[:-1], order[1:], LENGTH) if len(order) > 1 else np.empty(0, bool)
    if not same.any():
        return tuple(np.empty(0, np.int64) for _ in range(4))
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    first = np.concatenate([[0], np.flatnonzero(~same) + 1])  # where classes of equal strings begin
    head = np.repeat(np.minimum.reduceat(order, first), np.diff(np.append(first, len(order))))
    late = order != head
    at, head = order[late], head[late]
    # a string of a document in another row of it is the same string
    other = (doc[of[at]] != doc[of[head]]) | (start[of[at]] + at - begin[of[at]] != start[of[head]] + head - begin[of[head]])
    at = np.sort(at[other])
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    cut = np.flatnonzero((np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]])) + 1
    lo, hi = at[np.concatenate([[0], cut])], at[np.append(cut, len(at)) - 1]
    return file[of[lo]], doc[of[lo]], start[of[lo]] + lo - begin[of[lo]], hi - lo + LENGTH


def sort_contexts(texts: DataFrame, shards: int, common: np.ndarray, anchors: str, uri: str) -> None:
    """Step 2: the contexts of shared anchors, sorted shard by shard; the repeats among them, written for each file of texts."""
    listed = texts.sparkSession.sparkContext.broadcast(common)

    def send(batches):
        first: dict[bytes, tuple] = {}  # of equal contexts the one that comes first
        held: dict[int, list] = {}
        gone: list[tuple] = []
        size = 0
        known = (None, None, None)

        def out():
            for text, (doc, start, file, shard) in first.items():
                if shard >= 0:
                    held.setdefault(shard, []).append((doc, start, file, text))
                else:
                    for at in range(len(text) - LENGTH + 1):
                        string = text[at : at + LENGTH]
                        held.setdefault(xxhash.xxh64_intdigest(string) % shards, []).append((doc, start + at, file, string))
            data = []
            for k in sorted(held):
                rows = held[k]
                head = _pack(*(np.array([r[c] for r in rows], np.int64) for c in range(3)), np.array([len(r[3]) for r in rows], np.int64))
                data.append(len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(1).compress(b"".join(r[3] for r in rows)))
            keys = sorted(held)
            if gone:  # to the files of texts through any shard
                keys.append(gone[0][1] % shards)
                data.append((0).to_bytes(8, "little") + _pack(*(np.array(x, np.int64) for x in zip(*gone, strict=True))))
            return _batch(_SENT, keys, data)

        for s, piece, ids, files, offset in _cut(batches):
            a, _, at, n = runs(s, piece, listed.value)
            own = piece[at]
            raw = s.tobytes()
            for f in np.unique(files[own]).tolist():
                if known[0] != f:
                    known = (f, *_listed(f"{anchors}/anchors-{f}"))
                if not len(known[1]):
                    continue
                mine = np.flatnonzero(files[own] == f)
                place = np.minimum(np.searchsorted(known[1], a[mine]), len(known[1]) - 1)
                ok = known[1][place] == a[mine]
                mine, place = mine[ok], place[ok]
                shard = np.where(known[2][place] > 0, -1, (_mixed(a[mine]) >> np.uint64(33)).astype(np.int64) % shards)
                doc, start = ids[own[mine]], at[mine] + offset[own[mine]]
                for d, p, lo, hi, k in zip(doc.tolist(), start.tolist(), at[mine].tolist(), (at[mine] + n[mine] + LENGTH - 1).tolist(), shard.tolist(), strict=True):
                    text = raw[lo:hi]
                    there = first.get(text)
                    if there is None:
                        first[text] = (d, p, f, k)
                        size += hi - lo
                    elif there[:2] == (d, p):  # another row of the same document
                        held.setdefault(k if k >= 0 else 0, []).append((d, p, f, text))
                    elif there[:2] < (d, p):
                        gone.append((f, d, p, hi - lo))
                    else:
                        gone.append((there[2], there[0], there[1], hi - lo))
                        first[text] = (d, p, f, k)
            if size >= SEND_BYTES:
                yield out()
                first, held, gone, size = {}, {}, [], 0
        if first:
            yield out()
        settle()

    def sort(batches):
        for _, parts in _by_key(batches):
            doc, start, file, held, found = [], [], [], [], []
            for d in parts:
                n = int.from_bytes(d[:8], "little")
                if not n:
                    found.append(tuple(_unpack(d[8:], *[np.int64] * 4)))
                    continue
                a, b, f, size = _unpack(d[8 : 8 + n], *[np.int64] * 4)
                body, at = zstandard.ZstdDecompressor().decompress(d[8 + n :]), 0
                doc.append(a)
                start.append(b)
                file.append(f)
                for k in size.tolist():
                    held.append(body[at : at + k])
                    at += k
            if doc:
                found.append(sorted_repeats(np.concatenate(doc), np.concatenate(start), held, np.concatenate(file)))
            file, doc, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
            keys, data = [], []
            for f in np.unique(file):
                own = file == f
                keys.append(int(f))
                data.append(_pack(*merged_spans(doc[own], start[own], (start + size)[own])))
            if keys:
                yield _batch(_REPLY, keys, data)
        settle()

    def keep(batches):
        for file, parts in _by_key(batches):
            doc, start, end = (np.concatenate(x) for x in zip(*(_unpack(d, *[np.int64] * 3) for d in parts), strict=True))
            put(f"{uri}/spans-{file}", *merged_spans(doc, start, end))
        settle()
        yield _batch(_REPLY, [], [])

    found = texts.mapInArrow(send, _SENT).repartition(shards, "shard").mapInArrow(sort, _REPLY).repartition("file")
    found.mapInArrow(keep, _REPLY).write.format("noop").mode("overwrite").save()


def _listed(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Shared anchors of a file of texts, and which have very many contexts."""
    data = fetched(uri)
    n = len(data) // 9
    return data[: 8 * n].view(np.uint64), data[8 * n :]


def _numbered(df: DataFrame, text: str, path: str) -> DataFrame:
    """Every row's doc_id, text and ``doc``, its document's number in order."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if again.isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    # number distinct rows in order of id and digest
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    order = rows.select("doc_id", digest.alias("_digest")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "_digest")
    order = written(order.withColumn("doc", F.monotonically_increasing_id()), f"{path}/order")
    keyed = rows.withColumn("_digest", digest).alias("r").join(order.alias("o"), F.expr("r._digest = o._digest and r.doc_id <=> o.doc_id"))
    return keyed.select("r.doc_id", "r.text", "o.doc")


def repeated_spans(df: DataFrame, text: str = "text", most: int = MOST_CONTEXTS) -> tuple[DataFrame, str]:
    """The texts (doc_id, doc, file, text), and the folder that holds the repeats of each file of them."""
    spark = df.sparkSession
    path = work_dir(spark, "substrings")
    rows = _numbered(df, text, path)
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/texts")
    texts = spark.read.schema(rows.schema).parquet(f"{path}/texts").withColumn("file", F.xxhash64("_metadata.file_path"))
    parts = texts.select("doc", "file", "text")
    size = parts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    common = common_pieces(texts)
    contexts = share_anchors(parts, max(LEAST_SHARDS, -(-size // SHARD_BYTES)), common, f"{path}/anchors", most)
    if contexts:
        sort_contexts(parts, max(LEAST_SHARDS, -(-contexts * CONTEXT // SORT_BYTES)), common, f"{path}/anchors", f"{path}/spans")
    return texts, f"{path}/spans"


def remove_repeats(df: DataFrame, text: str = "text", most: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, text without its repeats (``kept``), n_bytes, n_removed, n_spans of each row."""
    texts, spans = repeated_spans(df, text, most)
    schema = T.StructType(
        [*fields(texts, ["doc_id"]), T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]
    )
    opened: dict[int, tuple] = {}

    def of(file: int):
        if file not in opened:
            opened.clear()
            opened[file] = tuple(fetched(f"{spans}/spans-{file}").view(np.int64).reshape(3, -1))
        return opened[file]

    def run(batch: pa.RecordBatch):
        kept, counts = [], []
        for d, f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), column_bytes(batch.column(3)), strict=True):
            doc, start, end = of(f)
            lo, hi = np.searchsorted(doc, [d, d + 1])
            out, last = [], 0
            for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True):
                out.append(t[last:a])
                last = b
            out.append(t[last:])
            kept.append(b"".join(out))
            counts.append((len(t), len(t) - len(kept[-1]), int(hi - lo)))
        return [batch.column(0), kept, *([c[k] for c in counts] for k in range(3))]

    return map_arrow(texts.select("doc_id", "doc", "file", "text"), run, schema)


def brute_force(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by comparing every string; for tests."""
    seen, result = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        result[doc, text] = (doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [result[r] for r in rows]
