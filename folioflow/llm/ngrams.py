"""Interpolated modified Kneser-Ney model of order three, counted in Spark, scored from mapped arrays.

Tokens are the words of a text and one end mark; two marks of the beginning stand before them as context.

1. words: each task counts its words by 64-bit hash; shards by hash range merge the counts and write
   sorted hash arrays. A word's id orders by a rough class of its count, frequent ones first, so that ids in
   messages are small.
2. triples: each task counts triples of ids and deals them by the hash of their first two. A shard merges its
   triples and writes them as a sorted hash array with counts; their contexts, all of which it has, get an array with
   their total and how many of their triples occur once, twice and more often. It tells the shards of the last
   two words how many different words stand before these.
3. pairs: those shards add this up, write a sorted hash array of pairs with it, and tell the words' shards
   the same of single words, and of words as contexts.

What tasks send are sorted, delta-coded, compressed arrays rather than rows. Shards go by hashes of pairs, so no
frequent word makes a large one. A hash array keeps 32 bits of each hash in buckets that its upper bits number; a
search halves one bucket, so its cost doesn't grow with the model. With the bits of shard and bucket, 50 and more
bits tell n-grams apart: one that was never seen takes another's count with a chance of a few in 10**9. All files
lie in the shared folder; workers map them into memory and look up a batch's words, pairs and triples in sorted
order. Nothing of the corpus's size reaches the driver: it gets sizes and counts of counts, a short row for each
shard. The number of shards grows with the text, so a shard's size does not.

Defined results: a null or empty text has just the end mark; a null id counts as an empty string for
the fold and stays null; repeated rows count and are scored each; without training texts every token
has probability 1; other columns are ignored.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import mapped, put, tidy, work_dir
from ._text import column_bytes, fields, map_arrow, settle, space_words
from .minhash import mixed

#: Text of one shard in bytes, and the least number of shards (powers of two).
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 64
#: Tokens that a task gathers before it merges, and entries that it holds before it sends.
GATHER, HOLD = 1 << 20, 1 << 22
#: Words whose hashes a worker keeps, files that it keeps mapped, and their bytes: what it has read of them counts as its memory.
MEMO_WORDS, MAPS, MAP_BYTES = 300_000, 4096, 128 << 20
#: Least counts of the classes of words; the class of all others comes last.
CLASSES = (4096, 256, 16)
#: Entries of a bucket on average.
BUCKET = 16

END = xxhash.xxh64_intdigest(b"")
_SENT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("data", T.BinaryType())])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _tokens(column: pa.Array, hashes: _Hashes):
    """Token hashes of each text, the end mark last."""
    for t in column_bytes(column):
        if len(hashes) > MEMO_WORDS:
            hashes.clear()
        words = space_words(t)
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        yield out


def _merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], *(np.add.reduceat(v[order], first) for v in values)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed; each must be of one length."""
    out = [struct.pack("<q", len(arrays[0]))]
    for a in arrays:
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join(out))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = struct.unpack_from("<q", raw)[0], 8, []
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def _rows(shards: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(data, pa.binary())], names=_SENT.names)


_SALT = np.uint64(0x9E3779B97F4A7C15)


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of ids."""
    return mixed(mixed(u.astype(np.uint64) + _SALT) + v.astype(np.uint64))


def _triple(pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hashes of triples, from those of their first two."""
    return mixed(pair + mixed(w.astype(np.uint64) ^ _SALT))


def _class(count: np.ndarray) -> np.ndarray:
    """The number of each count's class, frequent ones first."""
    return np.sum([count < c for c in CLASSES], axis=0)


def _put_keys(uri: str, keys: np.ndarray, drop: int) -> None:
    """A sorted hash array: bucket bounds by the upper bits that follow ``drop`` common ones, and 32 bits of each."""
    n = len(keys)
    bits = max(1, min(28, (n // BUCKET).bit_length()))
    k = keys << np.uint64(drop)
    bounds = np.searchsorted(k >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    put(uri, np.array([n, bits], np.int64), bounds.astype(np.uint32), ((k << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32))


def _search(data: np.ndarray, keys: np.ndarray, drop: int) -> np.ndarray:
    """The place of each key in a hash array, -1 where it isn't there."""
    n, bits = data[:16].view(np.int64).tolist()
    bounds = data[16 : 16 + 4 * ((1 << bits) + 1)].view(np.uint32)
    kept = data[16 + 4 * ((1 << bits) + 1) :].view(np.uint32)
    if not n:
        return np.full(len(keys), -1, np.int64)
    k = keys << np.uint64(drop)
    bucket = (k >> np.uint64(64 - bits)).astype(np.int64)
    want = ((k << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    lo, end = bounds[bucket].astype(np.int64), bounds[bucket + 1].astype(np.int64)
    hi = end.copy()
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        middle = (lo + hi) >> 1
        less = (kept[np.minimum(middle, n - 1)] < want) & (lo < hi)
        hi = np.where(less, hi, np.minimum(middle, hi))
        lo = np.where(less, middle + 1, lo)
    return np.where((lo < end) & (kept[np.minimum(lo, n - 1)] == want), lo, -1)


def _put_counts(uri: str, counts: np.ndarray, kind: type = np.uint8) -> None:
    """Counts in a byte each, or another kind of number; those that it can't tell from its largest one also with their places, in 64 bits."""
    most = np.iinfo(kind).max
    big = np.flatnonzero(counts >= most)
    put(uri, np.minimum(counts, most).astype(kind))
    put(f"{uri}-big", big.astype(np.int64), counts[big].astype(np.int64))


def _put_kinds(uri: str, table: np.ndarray) -> None:
    """Rows of numbers by the kinds of rows that there are: the kinds, and the kind of each row."""
    code = np.zeros(len(table), np.uint64)
    for column in table.T:
        code = mixed(code + column.astype(np.uint64))
    kinds, of = np.unique(code, return_inverse=True)
    shown = np.zeros((len(kinds), table.shape[1]), np.int64)
    shown[of] = table
    put(f"{uri}-kinds", np.array([len(kinds)], np.int64), shown.ravel())
    put(uri, of.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32))


@dataclass
class Model:
    """Where the arrays are, and the few numbers that belong to them."""

    uri: str
    shards: int
    starts: np.ndarray | None = None  # first id of each class of words and word shard
    words: int = 0  # V; also the id of the mark of the beginning
    tokens: int = 0  # N
    triples: int = 0
    types: int = 0  # different pairs
    discount: tuple = ((0.0, 0.0, 0.0),) * 3  # of triples, pairs and words
    low_types: tuple = (0, 0, 0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _file(self, name: str, kind=np.uint8) -> np.ndarray:
        held = self.__dict__.setdefault("_maps", {})
        if name not in held:
            found = mapped(f"{self.uri}/{name}")
            if len(held) >= MAPS or self.__dict__.get("_mapped", 0) + len(found) > MAP_BYTES:
                held.clear()
                self._mapped = 0
            self._mapped = self.__dict__.get("_mapped", 0) + len(found)
            held[name] = found.view(kind)
        return held[name]

    @property
    def shard_bits(self) -> int:
        return self.shards.bit_length() - 1

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.shard_bits)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct word hashes."""
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(self.shard_of(hashes), np.arange(self.shards + 1))
        for s in range(self.shards):
            h = hashes[cut[s] : cut[s + 1]]
            own = self._file(f"hash-{s}", np.uint64) if len(h) else h
            if len(own):
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                ok = own[at] == h
                n = self._counts("count", s, at[ok], np.uint32)
                out[cut[s] : cut[s + 1]][ok] = self._file(f"rank-{s}", np.uint32)[at[ok]] + self.starts[_class(n), s]
                count[cut[s] : cut[s + 1]][ok] = n
        return out, count

    def _found(self, name: str, shard: np.ndarray, keys: np.ndarray, drop: int):
        """Shard by shard: the rows whose keys are in an array, and their places there."""
        order = np.argsort((shard.astype(np.uint64) << np.uint64(64 - self.shard_bits)) | ((keys << np.uint64(drop)) >> np.uint64(self.shard_bits)))
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            rows = order[cut[s] : cut[s + 1]]
            at = _search(self._file(f"{name}-{s}"), keys[rows], drop)
            yield s, rows[at >= 0], at[at >= 0]

    def _counts(self, name: str, s: int, at: np.ndarray, kind: type = np.uint8) -> np.ndarray:
        n = self._file(f"{name}-{s}", kind)[at].astype(np.int64)
        if len(big := np.flatnonzero(n == np.iinfo(kind).max)):
            places, values = self._file(f"{name}-{s}-big", np.int64).reshape(2, -1)
            n[big] = values[np.searchsorted(places, at[big])]
        return n

    def triple_counts(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of triples by the hash of their first two and the id of the third."""
        out = np.zeros(len(w), np.int64)
        for s, rows, at in self._found("triple", self.shard_of(pair), _triple(pair, w), 0):
            out[rows] = self._counts("times", s, at)
        return out

    def contexts(self, pair: np.ndarray) -> np.ndarray:
        """For hashes of pairs as contexts: their total, and their triples that occur once, twice, more often; in columns."""
        out = np.zeros((len(pair), 4), np.int64)
        for s, rows, at in self._found("context", self.shard_of(pair), pair, self.shard_bits):
            out[rows] = self._kinds(f"context-kind-{s}", at, 4)
        return out

    def _kinds(self, name: str, at: np.ndarray, width: int) -> np.ndarray:
        kinds = self._file(f"{name}-kinds", np.int64)
        return kinds[1:].reshape(-1, width)[self._file(name, np.uint16 if kinds[0] <= 1 << 16 else np.uint32)[at]]

    def before(self, pair: np.ndarray) -> np.ndarray:
        """For hashes of pairs: how many different words stand before them."""
        out = np.zeros(len(pair), np.int64)
        for s, rows, at in self._found("pair", self.shard_of(pair), pair, self.shard_bits):
            out[rows] = self._counts("before", s, at)
        return out

    def singles(self, ids: np.ndarray) -> np.ndarray:
        """For sorted distinct ids up to V, in columns: as context the sum over pairs of different words before them, pairs
        with one, two and more such words, and in how many pairs it is the second word."""
        out = np.zeros((len(ids), 5), np.float64)
        order = np.argsort(ids % self.shards, kind="stable")  # ids are dealt in turn, so frequent words are spread
        cut = np.searchsorted(ids[order] % self.shards, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            rows = order[cut[s] : cut[s + 1]]
            out[rows] = self._kinds(f"single-{s}", ids[rows] // self.shards, 5)
        return out

    def single_probability(self, times: np.ndarray) -> np.ndarray:
        """Of a word by the number of different words before it."""
        if not self.types:
            return np.full(len(times), 1.0 / (self.words + 1))
        rest = float(np.dot(self.discount[2], self.low_types)) / self.types
        return _discounted(times, self.discount[2]) / self.types + rest / (self.words + 1)

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """For each text of token hashes: tokens, known tokens, base score, model score."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        kinds, at = np.unique(np.concatenate(texts), return_inverse=True)
        ids, count = self.ids(kinds)
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        # numbers of single words; the mark of the beginning comes last
        begin = len(kinds)
        single = np.zeros((begin + 1, 5))
        where = np.flatnonzero(ids >= 0)
        where = where[np.argsort(ids[where])]
        if self.words:
            single[where] = self.singles(ids[where])
            single[begin] = self.singles(np.array([self.words]))[0]
        low = self.single_probability(single[:begin, 4])
        one = np.where(single[:, 0] > 0, single[:, 1:4] @ np.array(self.discount[1]) / np.maximum(single[:, 0], 1), 1.0)
        # pairs: of each token with the one before it, and last of all the two marks
        previous = np.concatenate([[begin], at[:-1]])
        previous[starts] = begin
        codes, which = np.unique(np.append(previous.astype(np.int64) * (begin + 1) + at, begin * (begin + 1) + begin), return_inverse=True)
        u, w = codes // (begin + 1), codes % (begin + 1)
        id_of = np.append(ids, self.words)
        hashes = _pair(id_of[u], id_of[w])
        known = np.flatnonzero((id_of[u] >= 0) & (id_of[w] >= 0)) if self.words else np.empty(0, np.int64)
        before, context = np.zeros(len(codes)), np.zeros((len(codes), 4))
        before[known], context[known] = self.before(hashes[known]), self.contexts(hashes[known])
        second = np.append(low, 0.0)[w]  # no probability is asked of a mark
        second = _discounted(before, self.discount[1]) / np.maximum(single[u, 0], 1) + one[u] * second
        two = np.where(context[:, 0] > 0, context[:, 1:4] @ np.array(self.discount[0]) / np.maximum(context[:, 0], 1), 1.0)
        # triples: the context of a token is the pair that ends before it
        marks, which = which[-1], which[:-1]
        before_it = np.concatenate([[marks], which[:-1]])
        before_it[starts] = marks
        n = np.zeros(len(at), np.int64)
        some = np.flatnonzero((context[before_it, 0] > 0) & (ids[at] >= 0))
        n[some] = self.triple_counts(hashes[before_it[some]], ids[at[some]])
        p = _discounted(n, self.discount[0]) / np.maximum(context[before_it, 0], 1) + two[before_it] * second[which]
        add = lambda x: np.add.reduceat(x, starts)
        return sizes, add((ids >= 0)[at].astype(np.int64)), add(base[at]), add(np.log10(p))


def _discounted(times: np.ndarray, discount: tuple) -> np.ndarray:
    return np.maximum(times - np.array([0.0, *discount])[np.minimum(times, 3).astype(np.int64)], 0)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things that occur once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return (0.5, 0.5, 0.5) if n1 else (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(1 - 2 * y * n2 / n1, 1.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)


def _collected(df: DataFrame) -> list:
    """One small row per shard."""
    return df.collect()


def _reduced(sent: DataFrame, shards: int, fn, schema: str, keep_all: bool = True) -> DataFrame:
    """Bring a shard's arrays together and run fn(shard, list of data) on each shard."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for s, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(s, []).append(d)
        for s in sorted(held):
            yield from fn(s, held.pop(s))

    every = sent.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("data")) if keep_all else None
    return (sent.unionByName(every) if keep_all else sent).repartition(shards, "shard").mapInArrow(run, schema)


def train(docs: DataFrame, fold: Column, text: str = "text", uri: str | None = None) -> Model:
    """Count the texts that meet the condition ``fold`` and write the model's arrays."""
    spark = docs.sparkSession
    uri = uri or work_dir(spark, "ngrams")
    own = docs.where(fold).select(F.col(text).cast("string").alias("t"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards = LEAST_SHARDS
    while shards * SHARD_BYTES < size:
        shards *= 2
    model = Model(uri, shards)

    def gathered(batches):
        """Token hashes of texts, some GATHER tokens at a time."""
        hashes, texts, n = _Hashes(), [], 0
        for batch in batches:
            for t in _tokens(batch.column(0), hashes):
                texts.append(t)
                n += len(t)
                if n >= GATHER:
                    yield texts
                    texts, n = [], 0
        if texts:
            yield texts

    def send_words(batches):
        held = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def out(held):
            cut = np.searchsorted(model.shard_of(held[0]), np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            return _rows(some, [_pack(np.diff(held[0][cut[s] : cut[s + 1]], prepend=np.uint64(0)), held[1][cut[s] : cut[s + 1]]) for s in some])

        for texts in gathered(batches):
            k, n = np.unique(np.concatenate(texts), return_counts=True)
            held = _merged(np.concatenate([held[0], k]), np.concatenate([held[1], n]))
            if len(held[0]) >= HOLD:
                yield out(held)
                held = (np.empty(0, np.uint64), np.empty(0, np.int64))
        if len(held[0]):
            yield out(held)
        settle()

    def keep_words(shard, data):
        parts = [_unpack(d, np.uint64, np.int64) for d in data if d is not None]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts] or [np.empty(0, np.uint64)])
        times = np.concatenate([p[1] for p in parts] or [np.empty(0, np.int64)])
        keys, times = _merged(keys, times)
        kind = _class(times)
        order = np.argsort(kind, kind="stable")
        sizes = np.bincount(kind, minlength=len(CLASSES) + 1)
        rank = np.empty(len(keys), np.uint32)
        rank[order] = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        put(f"{uri}/hash-{shard}", keys)
        _put_counts(f"{uri}/count-{shard}", times, np.uint32)
        put(f"{uri}/rank-{shard}", rank)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([int(times.sum())], pa.int64())], names=["shard", "sizes", "tokens"])

    got = sorted(_collected(_reduced(own.mapInArrow(send_words, _SENT), shards, keep_words, "shard int, sizes array<long>, tokens long")))
    sizes = np.array([r["sizes"] for r in got], np.int64).T
    model.starts = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
    model.words, model.tokens = int(sizes.sum()), sum(r["tokens"] for r in got)
    kind = np.uint32 if model.words < 0xFFFFFFFF else np.uint64
    bits = max(1, int(model.words).bit_length())
    tidy(spark)

    def ordered(shard, first, second):
        """The order of (shard, first, second)."""
        if model.shard_bits + 2 * bits <= 64:
            return np.argsort((shard.astype(np.uint64) << np.uint64(2 * bits)) | (first.astype(np.uint64) << np.uint64(bits)) | second.astype(np.uint64))
        return np.lexsort((second, first, shard))

    def send_triples(batches):
        held, size = [], 0

        def out():
            u, v, w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            pair = _pair(u, v)
            key = _triple(pair, w)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n, order = np.add.reduceat(n[order], first), order[first]
            u, v, w, shard = u[order], v[order], w[order], model.shard_of(pair[order])
            order = ordered(shard, u, v)
            u, v, w, n, shard = (x[order] for x in (u, v, w, n, shard))
            cut = np.searchsorted(shard, np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            return _rows(some, [_pack(np.diff(u[lo:hi], prepend=kind(0)), v[lo:hi], w[lo:hi], n[lo:hi]) for lo, hi in ((cut[s], cut[s + 1]) for s in some)])

        for texts in gathered(batches):
            kinds, at = np.unique(np.concatenate(texts), return_inverse=True)
            w = model.ids(kinds)[0][at].astype(kind)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
            v = np.concatenate([[model.words], w[:-1]]).astype(kind)
            v[starts] = model.words
            u = np.concatenate([[model.words], v[:-1]]).astype(kind)
            u[starts] = model.words
            key = _triple(_pair(u, v), w)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key)))
            order = order[first]
            held.append((u[order], v[order], w[order], n))
            size += len(n)
            if size >= HOLD:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        settle()

    def keep_triples(shard, data):
        parts = [_unpack(d, kind, kind, kind, np.int64) for d in data if d is not None]
        empty = (np.empty(0, kind),) * 3 + (np.empty(0, np.int64),)
        u, v, w, n = (np.concatenate(x) for x in zip(empty, *((np.cumsum(p[0], dtype=kind), *p[1:]) for p in parts), strict=True))
        del parts
        pair = _pair(u, v)
        key = _triple(pair, w)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        times = np.add.reduceat(n[order], first) if len(key) else np.empty(0, np.int64)
        order = order[first]
        pair, v, w = pair[order], v[order], w[order]
        _put_keys(f"{uri}/triple-{shard}", key[first], 0)
        _put_counts(f"{uri}/times-{shard}", times)
        small = [len(times), *(int((times == k).sum()) for k in (1, 2, 3, 4))]
        # contexts, each with one of not so many kinds of numbers
        pair, *numbers = _merged(pair, times, *((times == k).astype(np.int64) for k in (1, 2)), (times >= 3).astype(np.int64))
        table = np.stack(numbers, axis=1) if len(pair) else np.empty((0, 4), np.int64)
        _put_keys(f"{uri}/context-{shard}", pair, model.shard_bits)
        _put_kinds(f"{uri}/context-kind-{shard}", table)
        # for the shards of the last two words: the number of different words before them
        to = model.shard_of(_pair(v, w))
        order = ordered(to, v, w)
        v, w, to = v[order], w[order], to[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(v))).astype(np.uint32)
        v, w, to = v[first], w[first], to[first]
        cut = np.searchsorted(to, np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cut)).tolist()
        yield _rows([*some, shard], [*(_pack(np.diff(v[cut[s] : cut[s + 1]], prepend=kind(0)), w[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]]) for s in some), b"#" + np.array(small, np.int64).tobytes()])

    def keep_pairs(shard, data):
        small = np.zeros(10, np.int64)
        parts = []
        for d in data:
            if d is not None and d[:1] == b"#":
                small[:5] += np.frombuffer(d[1:], np.int64)
            elif d is not None:
                parts.append(_unpack(d, kind, kind, np.uint32))
        empty = (np.empty(0, kind),) * 2 + (np.empty(0, np.uint32),)
        v, w, n = (np.concatenate(x) for x in zip(empty, *((np.cumsum(p[0], dtype=kind), *p[1:]) for p in parts), strict=True))
        del parts
        key = _pair(v, w)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        n = np.add.reduceat(n[order].astype(np.int64), first) if len(key) else np.empty(0, np.int64)
        order = order[first]
        v, w = v[order], w[order]
        _put_keys(f"{uri}/pair-{shard}", key[first], model.shard_bits)
        _put_counts(f"{uri}/before-{shard}", n)
        small[5:] = [len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4))]
        tops, *numbers = _merged(v, n, *((n == k).astype(np.int64) for k in (1, 2)), (n >= 3).astype(np.int64))
        ends, times = _merged(w, np.ones(len(w), np.int64))
        to, out = [], []
        of_top, of_end = (np.argsort(x % kind(shards), kind="stable") for x in (tops, ends))
        a, b = (np.searchsorted((x % kind(shards))[o], np.arange(shards + 1)) for x, o in ((tops, of_top), (ends, of_end)))
        for s in np.flatnonzero(np.diff(a) + np.diff(b)).tolist():
            top, end = of_top[a[s] : a[s + 1]], of_end[b[s] : b[s + 1]]
            left = _pack(np.diff(tops[top] // kind(shards), prepend=kind(0)), *(x[top].astype(np.uint64) for x in numbers))
            to.append(s)
            out.append(struct.pack("<q", len(left)) + left + _pack(np.diff(ends[end] // kind(shards), prepend=kind(0)), times[end].astype(np.uint64)))
        yield _rows([*to, shard], [*out, b"#" * 8 + small.tobytes()])

    def keep_singles(shard, data):
        table, small = np.zeros(((model.words - shard) // shards + 1, 5), np.int64), np.zeros(10, np.int64)
        for d in data:
            if d is None:
                continue
            if d[:8] == b"#" * 8 and len(d) == 88:
                small += np.frombuffer(d[8:], np.int64)
                continue
            n = struct.unpack_from("<q", d)[0]
            at, *numbers = _unpack(d[8 : 8 + n], kind, *[np.uint64] * 4)
            at = np.cumsum(at, dtype=np.int64)
            for k, x in enumerate(numbers):
                table[at, k] += x.astype(np.int64)
            at, times = _unpack(d[8 + n :], kind, np.uint64)
            table[np.cumsum(at, dtype=np.int64), 4] += times.astype(np.int64)
        _put_kinds(f"{uri}/single-{shard}", table)
        low = [int((table[:, 4] == k).sum()) for k in (1, 2, 3, 4)] + [int((table[:, 4] >= 3).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*small.tolist(), *low)], names=[f"c{k}" for k in range(15)])

    triples = _reduced(own.mapInArrow(send_triples, _SENT), shards, keep_triples, "shard int, data binary")
    pairs = _reduced(triples, shards, keep_pairs, "shard int, data binary")
    got = np.array([list(r) for r in _collected(_reduced(pairs, shards, keep_singles, ", ".join(f"c{k} long" for k in range(15))))], np.int64).sum(0).tolist()
    model.triples, model.types = got[0], got[5]
    model.discount = (discounts(got[1:5]), discounts(got[6:10]), discounts(got[10:14]))
    model.low_types = (got[10], got[11], got[14])
    tidy(spark)
    return model


def score(df: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, n_tokens, n_known, base_score and score (log10 probabilities) of each text."""
    kinds = (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))
    schema = T.StructType([*fields(df, keys), *(T.StructField(n, t) for n, t in kinds)])
    opened: list[Model] = []

    def run(batch: pa.RecordBatch):
        if not opened:
            opened.append(model)
        hashes, out, texts, n = _Hashes(), [], [], 0
        for t in _tokens(batch.column(len(keys)), hashes):
            texts.append(t)
            n += len(t)
            if n >= GATHER:
                out.append(opened[0].score(texts))
                texts, n = [], 0
        if texts:
            out.append(opened[0].score(texts))
        return [*(batch.column(k) for k in range(len(keys))), *(pa.array(np.concatenate(c)) for c in zip(*out, strict=True))]

    return map_arrow(df.select(*keys, F.col(text).cast("string").alias("_text")), run, schema)
