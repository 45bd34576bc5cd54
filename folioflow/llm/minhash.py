"""Near-duplicate classes by b-bit MinHash, links confirmed on full shingle sets.

1. Each document's set of distinct word shingles (64-bit hashes) gives ``BANDS * ROWS`` minima. Bands of
   full minima make bucket keys; the low ``BITS`` bits of each minimum are packed into the signature.
2. Documents with equal sets are one class, known by its smallest id, found by an aggregation of
   digests. Only one id per class goes on, so copies cost nothing further.
3. Classes that share a band's bucket are candidates. A bucket never emits all its pairs: each star round
   links its members to one leader, drops candidates whose similarity, estimated from the signatures by
   bit counts and corrected for chance agreement of b bits, is clearly too low, confirms the rest on the
   full sets, and merges what is confirmed. Buckets whose members are then in one component are done.
4. What star rounds leave open is finished exactly. Open buckets that share members make a cluster; in
   each, the members outside its largest component are a query set that is held, in blocks, against all
   members. A block of full sets is searched through an inverted list, and only links that join two
   components come out, one for each two components of a block pair.

A component is missed only if two linked sets share no band: for a similarity of 0.8 a probability of
1.2e-7. The estimate spares star rounds work and loses nothing, since step 4 takes up what it drops.

Sets are derived again from the text for candidates alone. Defined results: a null or empty text, or
one without words, has an empty set and links to nothing; fewer words than a shingle make one shingle
of the whole sequence; a null id gets a null component and is kept; rows with the same id are one
document with the links of each of its rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import tidy, work_dir, written
from ._text import column_bytes, map_arrow, settle, space_words
from .components import components

BANDS, ROWS, BITS = 40, 5, 4
#: Minima whose low bits are packed: twelve 64-bit words of sixteen.
PACKED = 192
#: Candidates whose estimated similarity is this much below the threshold wait for the last step.
SLACK = 0.12
#: Star rounds before the exact last step, at most.
STARS = 1
#: Slots of the list that is broadcast to leave out texts without candidates.
SLOTS = 1 << 18
#: Keys with more than one in so many rows are joined by broadcast.
SHARE = 1000
#: Shingles of a block at least and at most (8 bytes each), and blocks of a cluster while blocks may still grow.
BLOCK_SHINGLES, MOST_SHINGLES, BLOCKS = 1 << 15, 1 << 20, 12

_R = np.random.default_rng(0x5EED)
_FLIP = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SALT = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose minima are taken at once; the block stays in a core's cache.
HASH_BLOCK = 1 << 14


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hash of each word, kept for the words of a batch."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(words: list[bytes], size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = mixed(out + h[k : n - width + 1 + k] + _SALT)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the minimum under each hash function."""
    out = np.full((len(sets), BANDS * ROWS), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for lo in range(0, len(flat), HASH_BLOCK):
        x, own = flat[lo : lo + HASH_BLOCK], of[lo : lo + HASH_BLOCK]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        who = own[starts]
        low = np.empty((BANDS * ROWS, len(starts)), np.uint64)
        for j in range(BANDS * ROWS):
            low[j] = np.minimum.reduceat((x ^ _FLIP[j]) * _ODD[j], starts)
        out[who] = np.minimum(out[who], low.T)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of mixed minima, sixteen in a word."""
    bits = mixed(low[:, :PACKED]) & np.uint64((1 << BITS) - 1)
    bits = bits.reshape(len(low), PACKED // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(bits, axis=2)


def bands(low: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    rows = low.reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _SALT, rows.shape[:2])
    for k in range(ROWS):
        key = mixed(key + rows[:, :, k] + _SALT)
    return key


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("signature", T.ArrayType(T.LongType())),
    ]
)


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """A list column with the rows of a matrix at some places and nulls elsewhere."""
    sizes = np.zeros(n, np.int32)
    sizes[rows] = values.shape[1]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = np.ones(n, bool)
    mask[rows] = False
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64).ravel()), mask=pa.array(mask))


def signatures(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's digest, bucket keys and packed signature of each row."""

    def run(batch: pa.RecordBatch):
        hashes = _Hashes()
        sets = [shingle_set(space_words(t), size, hashes) for t in column_bytes(batch.column(1))]
        counts = [len(s) for s in sets]
        full = np.flatnonzero(counts)
        low = minima([sets[k] for k in full]) if len(full) else np.empty((0, BANDS * ROWS), np.uint64)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [batch.column(0), counts, digests, _lists(bands(low), full, len(sets)), _lists(packed(low), full, len(sets))]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")), run, SIGNED)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: differing b-bit groups by bit counts, corrected for chance."""
    differ = F.lit(0)
    for k in range(PACKED // 16):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 0.5**BITS
    return ((1 - differ / PACKED) - chance) / (1 - chance)


@contextmanager
def _small_batches(spark, rows: int = 256):
    """Steps that send whole sets to workers do so in batches of a few rows; a set may have megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Shingle sets (sorted hashes as bytes) of the documents whose ids are wanted: node, digest, members."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("members", T.BinaryType())])

    def run(batch: pa.RecordBatch):
        hashes = _Hashes()
        sets = [shingle_set(space_words(t), size, hashes) for t in column_bytes(batch.column(1))]
        return [batch.column(0), [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.tobytes() for s in sets]]

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias(text))
    wanted = wanted.select(F.col("node").alias("doc_id")).distinct()
    # most texts are not wanted: a list of hash slots, at most SLOTS of them, keeps them out of the shuffle
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(wanted.select(slot.alias("_slot")).distinct())
    own = own.withColumn("_slot", slot).join(slots, "_slot", "left_semi").drop("_slot")
    found = own.join(wanted, "doc_id", "left_semi")
    return map_arrow(found, run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batch: pa.RecordBatch):
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                ok.append(False)
                continue
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            ok.append(100 * both >= percent * (len(u) + len(v) - both))
        ok = pa.array(ok, pa.bool_())
        return [batch.column(0).filter(ok), batch.column(1).filter(ok)]

    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), run, schema)


def block_links(asked: list[tuple], members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between sets of a query block and of a member block, one for each two components.

    Both hold (node, component, sorted hashes). Intersections are counted through an inverted list."""
    flat = np.concatenate([m[2] for m in members])
    of = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    sizes = np.array([len(m[2]) for m in members], np.int64)
    comps = np.array([m[1] for m in members], np.int64)
    joined, out = set(), []
    for node, comp, own in asked:
        n = len(own)
        lo = np.searchsorted(flat, own)
        count = np.searchsorted(flat, own, "right") - lo
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        both = np.bincount(of[at], minlength=len(members))
        for k in np.flatnonzero((100 * both >= percent * (n + sizes - both)) & (comps != comp)).tolist():
            key = (min(comp, members[k][1]), max(comp, members[k][1]))
            if key not in joined:
                joined.add(key)
                out.append((node, members[k][0]))
    return out


def cluster_links(live: DataFrame, sets_of, percent: int, path: str, crowded: DataFrame) -> DataFrame:
    """Step 4. live: bucket, node, its shingles n, component c of open buckets; sets_of gives the sets of nodes; crowded are buckets of very many rows.

    Blocks are cut by shingles, so a few long documents make as large a block as many short ones."""
    lead = live.groupBy("bucket").agg(F.min("node").alias("v"))
    clusters = written(components(with_hot(live, lead, "bucket", crowded).select(F.col("node").alias("u"), "v")), f"{path}/clusters")
    nodes = live.groupBy("node", "c").agg(F.max("n").alias("n")).join(clusters.withColumnRenamed("component", "k"), "node")
    per = nodes.groupBy("k", "c").agg(F.sum("n").alias("n"))
    top = per.groupBy("k").agg(F.max(F.struct("n", "c")).alias("t"), F.sum("n").alias("all"))
    size = F.least(F.greatest(F.lit(BLOCK_SHINGLES), F.ceil(F.col("all") / BLOCKS)), F.lit(MOST_SHINGLES))
    top = top.select("k", F.col("t.c").alias("top"), F.ceil(F.col("all") / size).cast("int").alias("mb"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("t.n")) / size)).cast("int").alias("ob"))
    nodes = nodes.drop("n").join(top, "k")
    cut = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    upto = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asked = nodes.where("c != top").select("k", cut("ob").alias("o"), upto("mb").alias("m"), F.lit(0).alias("side"), "node", "c")
    members = nodes.select("k", upto("ob").alias("o"), cut("mb").alias("m"), F.lit(1).alias("side"), "node", "c")
    rows = asked.unionByName(members).join(sets_of(nodes.select("node")), "node").select("k", "o", "m", "side", "node", "c", "members")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches):
        key, held = None, ([], [])

        def out():
            links = block_links(*held, percent) if held[0] and held[1] else []
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["u", "v"])

        for batch in batches:
            *cols, sets = (batch.column(c) for c in range(7))
            for (k, o, m, side, node, c), x in zip(zip(*(col.to_pylist() for col in cols), strict=True), sets, strict=True):
                if (k, o, m) != key:
                    if key is not None:
                        yield out()
                    key, held = (k, o, m), ([], [])
                held[side].append((node, c, np.frombuffer(x.as_buffer(), np.uint64).copy()))  # a view would keep its whole batch
        if key is not None:
            yield out()
        settle()

    return rows.repartition("k", "o", "m").sortWithinPartitions("k", "o", "m", "side").mapInArrow(run, schema)


def hot_keys(rows: DataFrame, key: str, n: str | None = None) -> DataFrame:
    """The keys that a 1 / SHARE of all rows or more have, so SHARE at most; n: a column of numbers of rows, if they are counted already."""
    counts = rows.groupBy(key).agg(F.sum(n if n else F.lit(1)).alias("n"))
    total = rows.agg(F.coalesce(F.sum(n if n else F.lit(1)), F.lit(0))).first()[0]
    return counts.where(F.col("n") * SHARE > total).select(key)


def with_hot(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of rows with a table that has a row for each key. The rows of hot keys, SHARE keys at most, stay where they are and get
    theirs by broadcast; the others are shuffled."""
    hot = F.broadcast(hot)
    warm = rows.join(hot, key, "left_semi").join(F.broadcast(one.join(hot, key, "left_semi")), key)
    return warm.unionByName(rows.join(hot, key, "left_anti").join(one, key))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (columns doc_id, text)."""
    path = work_dir(docs.sparkSession, "minhash")
    rows = written(signatures(docs, size, text), f"{path}/rows")
    linked = rows.where("digest is not null and doc_id is not null")
    # a class of equal sets goes on as its smallest id; an id with several sets stands for each of them
    counted = written(linked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), f"{path}/classes")
    classes, copies = counted.select("digest", "node"), written(hot_keys(counted, "digest", "n"), f"{path}/copies")
    nodes = linked.join(classes.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    members = nodes.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
    members = written(members.join(shared, "bucket"), f"{path}/members")
    crowded = written(hot_keys(members, "bucket"), f"{path}/crowded")
    signed = nodes.withColumnRenamed("doc_id", "node").join(members.select("node").distinct(), "node", "left_semi")
    signed = written(signed.select("node", "digest", "signature").dropDuplicates(["node", "digest"]), f"{path}/signed")
    bits = signed.select("node", "signature")
    # rows of one id with different sets belong together
    same = with_hot(linked.select("digest", "doc_id"), classes, "digest", copies).groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w"), F.collect_set("node").alias("all")).where("u != w")
    links = written(same.select("u", F.explode("all").alias("v")).where("u != v"), f"{path}/same")
    comp, sets = None, None

    def labelled(m: DataFrame) -> DataFrame:
        if comp is None:
            return m.withColumn("c", F.col("node"))
        return m.join(comp.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))

    def sets_of(ids: DataFrame) -> DataFrame:
        nonlocal sets
        ids = ids.distinct()
        new = ids if sets is None else ids.join(sets, "node", "left_anti")
        more = full_sets(docs, new, size, text).join(signed.select("node", "digest"), ["node", "digest"], "left_semi")
        more = written(more.dropDuplicates(["node", "digest"]).select("node", "members"), work_dir(docs.sparkSession, "minhash-sets"))
        sets = more if sets is None else sets.unionByName(more)
        return sets

    def open_buckets(star: int) -> DataFrame:
        live = labelled(members)
        left = live.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
        return written(with_hot(live, left, "bucket", crowded).select("bucket", "node", "n", "c"), f"{path}/live-{star}")

    tidy(docs.sparkSession)
    live = open_buckets(0)
    for star in range(STARS):
        if live.isEmpty():
            break
        # another leader each round: the first by a hash of the round
        lead = live.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(star), "node").alias("h"), "node", "c")).alias("l"))
        pairs = with_hot(live, lead, "bucket", crowded).where("c != l.c").select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
        pairs = pairs.join(bits.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(bits.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        pairs = written(pairs.where(estimate(F.col("sa"), F.col("sb")) >= percent / 100 - SLACK).select("a", "b").distinct(), f"{path}/pairs-{star}")
        have = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        with _small_batches(docs.sparkSession):
            found = written(confirmed(pairs, have, percent), f"{path}/links-{star}")
        links = links.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
        comp = written(components(links), f"{path}/comp-{star}")
        live = open_buckets(star + 1)
    if not live.isEmpty():
        with _small_batches(docs.sparkSession):
            found = written(cluster_links(live, sets_of, percent, path, crowded), f"{path}/links")
        if comp is None:
            links = links.unionByName(found)
        else:  # the new links join components: these are few nodes, and their labels are their smallest ids
            label = comp.withColumnRenamed("component", "c")
            over = found.join(label.withColumnRenamed("node", "u").withColumnRenamed("c", "cu"), "u", "left").join(label.withColumnRenamed("node", "v").withColumnRenamed("c", "cv"), "v", "left")
            joined = components(over.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
            joined = written(joined.withColumnRenamed("node", "c").withColumnRenamed("component", "top"), f"{path}/joined")
            known = label.join(joined, "c", "left").select("node", F.coalesce("top", "c").alias("component"))
            fresh = joined.join(label.select(F.col("node").alias("c")), "c", "left_anti").select(F.col("c").alias("node"), F.col("top").alias("component"))
            comp = written(known.unionByName(fresh), f"{path}/comp")
    if comp is None:
        comp = written(components(links), f"{path}/comp")
    of = classes.join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    rows = rows.select("doc_id", "n_shingles", "digest")
    sure = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    out = with_hot(rows.where(sure), of, "digest", copies).unionByName(rows.where(~sure).withColumn("component_id", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
