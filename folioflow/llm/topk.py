"""Exact top-k by inner product with a stored impact-ordered index, searched score-at-a-time.

Vectors hold integers. The index is cut into blocks of vectors, each a file of the shared folder: the postings of
every dimension in descending order of impact, that is of magnitude, quantised to ``LEVELS`` levels of the
dimension; where each level and sign begins; and the full vectors. The postings of one dimension, level and sign
are a segment. For a query a segment is worth the query's component times its level, and segments are processed
by descending worth: each adds its middle to the accumulators of the vectors in it. What a dimension can still be off is
then half a level where its posting was seen, and the next level to come where it was not; the sum over dimensions
bounds the error of every accumulator. A query stops only on proof: when few vectors are left whose upper bound reaches
the k-th best lower bound or the k-th best score of earlier blocks, or no segment is left. All these
possible members are rescored exactly with the full components.

Queries are a stated set, held against all blocks; they are cut into files, too. A task takes one of these and
``RUN`` blocks one after the other, carries each query's k best scores along, and gives k rows a query.

Defined results: vectors that are null, or hold null or non-finite components, take no part; neither
do null ids; only vectors of a query's own length are candidates; equal rows count once, different
vectors with one id are separate candidates, and a query id with several vectors asks with the first
in their order; ties go to the smaller id; components and scores beyond 64 bits are the nearest 64-bit
numbers; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._store import fetched, put, work_dir
from ._text import settle

#: Vectors of an index block and of a query file at most; small inputs are cut finer, to share the work.
BLOCK, SMALL_BLOCK, SMALL_BLOCKS = 8192, 256, 64
#: Blocks that a task goes through, and levels of a dimension.
RUN, LEVELS = 16, 32
#: The stop is tested after each of so many parts of the postings.
PARTS = 8
LONG = (-(1 << 63), (1 << 63) - 1)


class Block:
    """Impact-ordered postings of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, step: np.ndarray, cuts: np.ndarray, posts: np.ndarray):
        self.ids, self.vectors, self.step, self.cuts, self.posts = ids, vectors, step, cuts, posts
        n, size = vectors.shape
        self.level = np.tile(np.repeat(np.arange(LEVELS - 1, -1, -1), 2), size)  # of each segment: by dimension, level from the top, sign
        self.dim = np.repeat(np.arange(size), 2 * LEVELS)
        self.sign = np.tile(np.array([1.0, -1.0]), LEVELS * size)
        self.first, self.count = cuts[:-1], np.diff(cuts)
        self.most = step.astype(np.float64) * LEVELS  # no magnitude of a dimension is above

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Block:
        """Build the postings of up to BLOCK vectors."""
        n, size = vectors.shape
        wide = vectors.astype(np.float64)
        high = np.abs(wide).max(axis=0, initial=0.0)
        step = np.ceil((high + 1) / LEVELS * (1 + 1e-12))  # a level holds magnitudes from level * step, below the next one
        level = np.minimum((np.abs(wide) / np.maximum(step, 1)).astype(np.int64), LEVELS - 1)
        segment = (np.arange(size) * LEVELS + LEVELS - 1 - level) * 2 + (wide < 0)
        flat = segment.T.ravel()  # dimension by dimension
        order = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[order], np.arange(2 * LEVELS * size + 1))
        return cls(ids, vectors, step, cuts, (order % max(n, 1)).astype(np.uint32))

    def save(self, uri: str) -> None:
        n, size = self.vectors.shape
        put(uri, np.array([n, size], np.int64), self.ids, self.vectors, self.step, self.cuts.astype(np.int64), self.posts)

    @classmethod
    def load(cls, uri: str) -> Block | None:
        data = fetched(uri)
        if not len(data):
            return None
        (n, size), at, out = data[:16].view(np.int64).tolist(), 16, []
        for count, kind in ((n, np.int64), (n * size, np.int64), (size, np.float64), (2 * LEVELS * size + 1, np.int64), (n * size, np.uint32)):
            width = count * np.dtype(kind).itemsize
            out.append(data[at : at + width].view(kind))
            at += width
        out[1] = out[1].reshape(n, size)
        return cls(*out)

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products; through Python's integers where 64 bits could overflow."""
        v = self.vectors[rows]
        high = float(np.abs(v.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(len(query), 1)
        if high < 2.0**62:
            return v @ query
        return np.array([min(max(sum(a * b for a, b in zip(x, query.tolist(), strict=True)), LONG[0]), LONG[1]) for x in v.tolist()], np.int64)

    def possible(self, query: np.ndarray, k: int, skip: int, least: float) -> np.ndarray:
        """Vectors that may be among the k best with a score of ``least`` or more; none that is gets lost."""
        n = len(self.ids)
        weight = np.abs(query.astype(np.float64))
        worth = weight[self.dim] * (self.level + 1) * self.step[self.dim]
        some = np.flatnonzero((self.count > 0) & (worth > 0))
        some = some[np.argsort(-worth[some], kind="stable")]
        middle = self.step[self.dim] * (self.level + 0.5) * self.sign * query.astype(np.float64)[self.dim]
        part = np.cumsum(self.count[some])
        ends = np.searchsorted(part, part[-1] * np.arange(1, PARTS + 1) / PARTS) + 1 if len(some) else np.empty(0, np.int64)
        score, own = np.zeros(n), self.ids != skip
        half = weight * self.step / 2
        # by dimension the segments to come: the best of them bounds what was not seen
        slack = 1e-6 + 1e-9 * float(weight @ self.most)
        at = 0
        found = np.flatnonzero(own)
        for end in np.minimum(ends, len(some)).tolist():
            now = some[at:end]
            at = end
            if len(now):
                size = self.count[now]
                place = np.arange(size.sum()) + np.repeat(self.first[now] - np.cumsum(size) + size, size)
                score += np.bincount(self.posts[place], np.repeat(middle[now], size), n)
            rest = np.zeros(len(weight))
            np.maximum.at(rest, self.dim[some[at:]], worth[some[at:]])
            error = float(np.maximum(half, rest).sum()) + slack
            low = score[own] - error
            bound = max(least, float(np.partition(low, len(low) - k)[len(low) - k])) if len(low) > k else least
            found = np.flatnonzero(own & (score + error >= bound))
            if len(found) <= max(4 * k, n // 32):
                break
        return found

    def top(self, query: np.ndarray, k: int, skip: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best vectors for a query among those that score ``least`` or more; its own id is left out."""
        rows = self.possible(query, k, skip, least)
        score = self.exact(rows, query)
        best = _ranked(self.ids[rows], score)[:k]
        return self.ids[rows][best], score[best]


def _ranked(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places by descending score, then id; a complement turns the order without overflow."""
    return np.lexsort((ids, ~score))


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """vec_id and the vector's components times ``scale``, rounded down; rows that take no part are left out."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return df.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def _matrix(batches: list[pa.RecordBatch]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of (b, vec_id, v) rows by b and length."""
    out: dict[tuple[int, int], list] = {}
    for batch in batches:
        block, ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        cut = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        size = np.diff(cut)
        for b, n in set(zip(block.tolist(), size.tolist(), strict=True)):
            rows = np.flatnonzero((block == b) & (size == n))
            out.setdefault((b, n), []).append((ids[rows], flat[cut[rows][:, None] + np.arange(n)]))
    return {key: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for key, parts in out.items()}


def _filed(rows: DataFrame, cuts: int, save) -> list:
    """Write each block of rows (b, vec_id, v) with ``save``; which blocks of which lengths there are."""

    def run(batches):
        out = []
        for (b, n), (ids, v) in sorted(_matrix(list(batches)).items()):
            save(b, n, ids, v)
            out.append((b, n))
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int32()) for c in (0, 1)], names=["b", "n"])

    return rows.select("b", "vec_id", "v").repartition(cuts, "b").mapInArrow(run, "b int, n int").collect()  # a row for each block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """vectors, queries: vec_id and v (array of longs). Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    uri = work_dir(spark, "topk")
    vectors = vectors.distinct()
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = vectors.count(), queries.count()
    cuts = max(-(-n // block), min(SMALL_BLOCKS, -(-n // SMALL_BLOCK)), 1)
    parts = max(-(-m // block), 1)
    cut = lambda *c, of: F.pmod(F.xxhash64(*c), F.lit(of)).cast("int")
    blocks = _filed(vectors.withColumn("b", cut("vec_id", "v", of=cuts)), cuts, lambda b, n, ids, v: Block.of(ids, v).save(f"{uri}/index-{n}-{b}"))
    asked = _filed(queries.withColumn("b", cut("vec_id", of=parts)), parts, lambda b, n, ids, v: put(f"{uri}/queries-{n}-{b}", ids, v))
    # a stated query set against all rows, in blocks
    by_size: dict[int, list[int]] = {}
    for r in sorted(blocks):
        by_size.setdefault(r["n"], []).append(r["b"])
    run_of = max(1, min(RUN, -(-cuts // SMALL_BLOCKS)))
    work = [(r["n"], r["b"], bs[lo : lo + run_of]) for r in asked for bs in [by_size.get(r["n"], [])] for lo in range(0, len(bs), run_of)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])

    def run(batches):
        for batch in batches:
            for size, p, bs in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = fetched(f"{uri}/queries-{size}-{p}").view(np.int64)
                count = len(data) // (size + 1)
                ids, q = data[:count], data[count:].reshape(count, size)
                best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * count
                for b in bs:
                    held = Block.load(f"{uri}/index-{size}-{b}")
                    for i in range(count):
                        least = float(best[i][1][-1]) if len(best[i][1]) == k else -np.inf
                        found, score = held.top(q[i], k, int(ids[i]), least - 1e-9 * abs(least))
                        found, score = np.concatenate([best[i][0], found]), np.concatenate([best[i][1], score])
                        order = _ranked(found, score)[:k]
                        best[i] = found[order], score[order]
                cols = np.repeat(ids, [len(x[0]) for x in best]), *(np.concatenate([x[c] for x in best]) if count else ids for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=schema.names)
        settle()

    pairs = spark.createDataFrame(work, "n int, p int, bs array<int>").repartition(max(1, min(len(work), 4096)))
    scored = pairs.mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
