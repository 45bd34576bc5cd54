"""Phrase collocation mining over vertical lists of positions.

1. Texts become blocks of one language (``blocks``): positions are places in a block, boundaries of pieces are gaps.
2. Each block sends its distinct words with the lengths of their lists; the words whose lists have ``least`` places over all
   blocks are frequent, and the blocks keep the lists of these alone: their postings.
3. From length to length, the positions of the frequent phrases are merge-joined with the postings of the words that stand just
   behind them, where the phrase without its first word is frequent, too. Distinct extensions and the lengths of their
   lists go through one shuffle, whose sums are exact frequencies; the blocks hear which of theirs are frequent.
4. Phrases are joined to the parts of their cuts and to the longer ones that hold them, in exact decimals.

A frequent word or phrase is one row of each block that has it, however often it stands there, so none is hot. The state of every
length is a table in the shared folder. Nothing is broadcast.

Null and empty texts have no words; a null language is ``und``. Repeated rows count each for itself. An empty
table has no phrases. Ties in score are broken by frequency and then by the phrase's bytes.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ._store import work_dir, written
from ._text import settle
from .blocks import classes, packed, squeezed, token_blocks, unpacked, words_of

#: A phrase is frequent from so many places on.
LEAST = 100
#: Words of a phrase at most.
LONGEST = 5
#: Words of the tables for each shard of a shuffle of phrases.
SHARD_WORDS = 3_000_000

_TABLE = bytes(
    0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)  # pieces end at a boundary

_STATE = T.StructType([T.StructField("block", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("words", T.BinaryType()), T.StructField("phrases", T.BinaryType())])


def _cut(text: bytes) -> bytes:
    return text.translate(_TABLE).replace(b"\xff", b" \xff ")


# Lists of postings of a block are kept as gaps between all their positions, what stands there as places in a list of ids, and these ids.


def _kept(at: np.ndarray, ids: np.ndarray) -> bytes:
    some, place, _ = classes(ids)
    return packed(np.diff(at, prepend=0), place, ids[some])


def _postings(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, ascending; the place of each one's id; the ids."""
    gaps, place, ids = unpacked(blob)
    return np.cumsum(gaps), place, ids


def merge_join(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values in two ascending lists of distinct numbers."""
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    i = np.flatnonzero(right[at] == left)
    return i, at[i]


class Extensions:
    """Where a frequent phrase of ``length`` words is followed by a frequent word and its rest is frequent, too: positions ``at``; ids ``a`` and ``b`` of
    the distinct pairs of phrase and word, in their order, with the lengths ``n`` of their lists; and the pair at each position."""

    def __init__(self, words: bytes, phrases: bytes | None, length: int):
        w_at, w, w_ids = _postings(words)
        p_at, p, p_ids = _postings(phrases) if phrases is not None else (w_at, w, w_ids)
        i, j = merge_join(p_at + length, w_at)  # the word behind the phrase
        i2, _ = merge_join(p_at[i] + 1, p_at)  # the phrase without its first word, with that word
        i, j = i[i2], j[i2]
        some, self.pair, self.n = classes(p[i] << 32 | w[j])
        self.at, self.a, self.b = p_at[i], p_ids[p[i[some]]], w_ids[w[j[some]]]


_SENT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("blob", T.BinaryType())])
#: What a shard finds: for each block the places of its frequent ones with their ids; in a row without a block, what each is.
_FOUND = T.StructType([T.StructField("block", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("known", T.BinaryType())])


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _dealt(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    mix = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mix ^= mix >> np.uint64(31)
    return (((mix * np.uint64(0x165667B19E3779F9)) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _sent_words(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, lang, blob): a block's distinct words of a shard with the lengths of their lists."""
    arrow = to_arrow_schema(_SENT)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block, lang, vocabulary, tokens = (batch.column(k)[row].as_py() for k in range(4))
                words, (ids,) = words_of(vocabulary), unpacked(tokens)
                n = np.bincount(ids, minlength=len(words) + 1)[: len(words)]
                dealt = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
                order, cut = _by_shard(_dealt(dealt, np.full(len(dealt), zlib.crc32(lang.encode())), shards), shards)
                some, blobs = np.flatnonzero(np.diff(cut)), []
                for s in some.tolist():
                    own = order[cut[s] : cut[s + 1]]
                    text = squeezed([words[k] for k in own.tolist()])
                    blobs.append(len(text).to_bytes(8, "little") + text + packed(np.diff(own, prepend=0), n[own] - 1))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), block)), pa.array([lang] * len(some), pa.string()), pa.array(blobs, pa.binary())], schema=arrow)
        settle()

    return blocks.select("block", F.col("group").alias("lang"), "vocabulary", "tokens").mapInArrow(run, _SENT)


def _sent_phrases(state: DataFrame, length: int, shards: int) -> DataFrame:
    """(shard, block, lang, blob): the distinct extensions of each block's phrases, with the lengths of their lists, sorted and packed by shard."""
    arrow = to_arrow_schema(_SENT)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block, lang, words, phrases = (batch.column(k)[row].as_py() for k in range(4))
                x = Extensions(words, phrases, length)
                order, cut = _by_shard(_dealt(x.a, x.b, shards), shards)  # within a shard as in the block, so by a and b
                some, blobs = np.flatnonzero(np.diff(cut)), []
                for s in some.tolist():
                    own = order[cut[s] : cut[s + 1]]
                    kinds, place = np.unique(x.b[own], return_inverse=True)
                    blobs.append(packed(np.diff(own, prepend=0), np.diff(x.a[own], prepend=0), place, np.diff(kinds, prepend=0), x.n[own] - 1))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), block)), pa.array([lang] * len(some), pa.string()), pa.array(blobs, pa.binary())], schema=arrow)
        settle()

    return state.mapInArrow(run, _SENT)


def _frequent(sent: DataFrame, least: int, words: bool, path: str) -> DataFrame:
    """What has ``least`` places over all blocks. Its id is the shard's number and one within the shard."""
    arrow = to_arrow_schema(_FOUND)

    def run(table: pa.Table) -> pa.Table:
        shard, blocks = table.column("shard")[0].as_py(), table.column("block").to_pylist()
        langs, lang = np.unique(np.array(table.column("lang").to_pylist(), object), return_inverse=True)
        parts, texts = [], []
        for g, blob in zip(lang.tolist(), (x.as_py() for x in table.column("blob")), strict=True):
            if words:
                size = int.from_bytes(blob[:8], "little")
                texts += words_of(blob[8 : 8 + size])
                at, n = unpacked(blob[8 + size :])
                parts.append((np.cumsum(at), np.full(len(at), g), n + 1))
            else:
                at, a, place, kinds, n = unpacked(blob)
                parts.append((np.cumsum(at), np.cumsum(a), np.cumsum(kinds)[place], n + 1))
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        at, a, *b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        if words:
            coded = pa.array(texts, pa.binary()).dictionary_encode()
            b = [coded.indices.to_numpy().astype(np.int64)]
        else:  # ids don't fit beside each other in 64 bits, their places do
            _, a_of, _ = classes(a)
            _, b_of, _ = classes(b[0])
        some, which, _ = classes(a << 32 | b[0] if words else a_of << 32 | b_of)
        f = np.zeros(len(some), np.int64)
        np.add.at(f, which, n)
        good = f >= least
        number = np.cumsum(good) - 1
        own = np.where(good[which], number[which], -1)
        blobs = []
        for at_, id_ in zip(np.split(at, ends), np.split(own, ends), strict=True):
            keep = np.flatnonzero(id_ >= 0)
            blobs.append(packed(np.diff(at_[keep], prepend=0), id_[keep], np.array([shard])))
        some = some[good]
        if words:
            text = squeezed(coded.dictionary.take(pa.array(b[0][some])).to_pylist())
            names = json.dumps(list(langs)).encode()
            known = b"".join(len(x).to_bytes(8, "little") + x for x in (text, names)) + packed(f[good], a[some], np.array([shard]))
        else:
            known = packed(f[good], a[some], b[0][some], np.array([shard]))
        settle()
        return pa.table([pa.array([*blocks, None], pa.int64()), pa.array([*blobs, None], pa.binary()), pa.array([*[None] * len(blocks), known], pa.binary())], schema=arrow)

    return written(sent.groupBy("shard").applyInArrow(run, _FOUND), path)


def _ids(shard: int, n: int) -> np.ndarray:
    return (shard << 40) + np.arange(n)


def _words(found: DataFrame) -> DataFrame:
    """(id, lang, word, f) of the frequent words."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("word", T.BinaryType()), T.StructField("f", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                blob = blob.as_py()
                size = int.from_bytes(blob[:8], "little")
                text, rest = words_of(blob[8 : 8 + size]), blob[8 + size :]
                size = int.from_bytes(rest[:8], "little")
                names, (f, lang, shard) = json.loads(rest[8 : 8 + size]), unpacked(rest[8 + size :])
                yield pa.RecordBatch.from_arrays([pa.array(_ids(int(shard[0]), len(f))), pa.array(names, pa.string()).take(pa.array(lang)), pa.array(text, pa.binary()), pa.array(f)], schema=arrow)

    return found.where("known is not null").select("known").mapInArrow(run, schema)


def _phrases(found: DataFrame) -> DataFrame:
    """(id, a, b, f) of the frequent extensions."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "a", "b", "f")])

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                f, a, b, shard = unpacked(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_ids(int(shard[0]), len(f)), a, b, f)], names=schema.names)

    return found.where("known is not null").select("known").mapInArrow(run, schema)


def _heard(answers: pa.Table, size: int) -> np.ndarray:
    """The id of each of a block's words or pairs, -1 where it isn't frequent."""
    known = np.full(size, -1, np.int64)
    for blob in answers.column("blob"):
        at, number, shard = unpacked(blob.as_py())
        known[np.cumsum(at)] = (int(shard[0]) << 40) + number
    return known


def _state(left: DataFrame, found: DataFrame, fn, path: str) -> DataFrame:
    """The next state of each block: fn(row of its last one, answers) gives its postings of words and of phrases."""
    arrow = to_arrow_schema(_STATE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        words, phrases = fn(left, right)
        settle()
        return pa.table([left.column("block"), left.column("lang"), pa.array([words], pa.binary()), pa.array([phrases], pa.binary())], schema=arrow)

    answers = found.where("block is not null").select("block", "blob")
    return written(left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _STATE), path)


def _first(left: pa.Table, right: pa.Table) -> tuple[bytes, None]:
    """The postings of each block's frequent words, which are its phrases of one word."""
    (ids,) = unpacked(left.column("tokens")[0].as_py())
    here = _heard(right, int(ids.max(initial=0)) + 1)[ids]
    at = np.flatnonzero(here >= 0)
    return _kept(at, here[at]), None


def _longer(length: int):
    """The lists of the frequent phrases that are one word longer, and of the words that stand in them."""

    def fn(left: pa.Table, right: pa.Table) -> tuple[bytes, bytes]:
        words = left.column("words")[0].as_py()
        x = Extensions(words, left.column("phrases")[0].as_py(), length)
        ids = _heard(right, len(x.n))[x.pair]
        some = np.flatnonzero(ids >= 0)
        w_at, w, w_ids = _postings(words)
        i, _ = merge_join(w_at, x.at[some] + length)  # an even longer phrase ends with a word that ends one of these
        return _kept(w_at[i], w_ids[w[i]]), _kept(x.at[some], ids[some])

    return fn


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase as bytes, size, f) of all phrases with ``least`` places, single words included; and (lang, n) the words of each language."""
    path = work_dir(docs.sparkSession, "phrases")
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    blocks = token_blocks(rows, _cut, f"{path}/blocks", group="lang")
    totals = blocks.groupBy(F.col("group").alias("lang")).agg(F.sum("words").alias("n"))
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, (blocks.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS + 1)
    found = _frequent(_sent_words(blocks, shards), least, True, f"{path}/frequent-1")
    words = written(_words(found), f"{path}/phrases-1")
    known = words.select("id", "lang", F.col("word").alias("phrase"), "f")
    every = known.select("lang", "phrase", F.lit(1).alias("size"), "f")
    state = _state(blocks.select("block", F.col("group").alias("lang"), "tokens"), found, _first, f"{path}/state-1")
    for length in range(1, longest):
        found = _frequent(_sent_phrases(state, length, shards), least, False, f"{path}/frequent-{length + 1}")
        front, last = known.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("front")), words.select(F.col("id").alias("b"), "word")
        phrase = F.concat("front", F.lit(b" "), "word").alias("phrase")
        known = written(_phrases(found).join(front, "a").join(last, "b").select("id", "lang", phrase, "f"), f"{path}/phrases-{length + 1}")
        every = every.unionByName(known.select("lang", "phrase", F.lit(length + 1).alias("size"), "f"))
        if length + 1 < longest:
            state = _state(state, found, _longer(length), f"{path}/state-{length + 1}")
    return every, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, percent: int = 100, top: int = 2000) -> DataFrame:
    """The best ``top`` phrases of two to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    The score is that of the phrase's weakest cut into two parts: floor(1000 a n / (l r)). Phrases within a longer one that
    has at least ``percent`` percent of their places are left out."""
    known, totals = frequent_phrases(docs, text, lang, least, longest)
    parts = F.split(F.col("phrase").cast("string"), " ")
    whole = known.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", parts.alias("w"))
    joined = lambda w: F.array_join(w, " ").cast("binary")

    k = F.col("k")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice("w", F.lit(1), k)).alias("left"), joined(F.slice("w", k + 1, F.col("size") - k)).alias("right"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("x", (F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).cast("decimal(38,0)")).withColumn("y", (exact("l") * exact("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("x div y"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")

    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.when(i + n - 1 <= F.col("size"), joined(F.slice("w", i, n))))))
    inside = whole.where("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).where("phrase is not null")
    held = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rest = worst.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = rest.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
