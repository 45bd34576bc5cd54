"""The trigram model against one counted with dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ngrams
from folioflow.llm._store import put


def brute(train, texts):
    cut = lambda t: [*(t or "").encode().lower().split(), b""]
    c, tri = Counter(), Counter()
    for t in train:
        w = cut(t)
        c.update(w)
        tri.update(zip([None, None, *w], [None, *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    pair, low = Counter((b, w) for a, b, w in tri), Counter()
    for _, w in pair:
        low[w] += 1

    def by_context(counts):
        total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for (*h, _), k in counts.items():
            total[tuple(h)] += k
            kinds[tuple(h)][min(k, 3) - 1] += 1
        return total, kinds

    of = lambda counts: ngrams.discounts([sum(k == x for k in counts.values()) for x in (1, 2, 3, 4)])
    levels = [(tri, *by_context(tri), of(tri)), (pair, *by_context(pair), of(pair))]
    e = of(low)
    rest = sum(e[min(k, 3) - 1] for k in low.values())

    def p1(w):
        if not pair:
            return 1 / (v + 1)
        k = low[w]
        return (max(k - e[min(k, 3) - 1], 0) if k else 0) / len(pair) + rest / len(pair) / (v + 1)

    def p(h, w):
        if not h:
            return p1(w)
        counts, total, kinds, d = levels[2 - len(h)]
        if not total[h]:
            return p(h[1:], w)
        k = counts[*h, w]
        return (max(k - d[min(k, 3) - 1], 0) if k else 0) / total[h] + sum(a * b for a, b in zip(d, kinds[h], strict=True)) / total[h] * p(h[1:], w)

    out = []
    for t in texts:
        w = cut(t)
        out.append((len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p((a, b), x)) for a, b, x in zip([None, None, *w], [None, *w], w, strict=False))))
    for h in [(None, None), *[x[:2] for x in list(tri)[:5]], (b"never", b"seen"), (b"never", next(iter(c)))]:
        assert sum(p(h, w) for w in c) + p(h, b"unknown word") == pytest.approx(1)
    return out, n


@pytest.mark.parametrize("small", [False, True])
def test_against_dictionaries(spark, small, monkeypatch):
    r = random.Random(5)
    vocab = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["été", "A", "a"]
    rows = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for k in range(300)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, "a b"), (5, rows[5][1]), (400, "w1 " * 2000)]
    if small:  # many messages, many classes of words, buckets of some entries
        for name, value in (("GATHER", 100), ("HOLD", 300), ("CLASSES", (50, 5, 2)), ("LEAST_SHARDS", 4), ("MAPS", 3)):
            monkeypatch.setattr(ngrams, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    fold = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1
    model = ngrams.train(df, fold)
    got = ngrams.score(df, model, ["doc_id"]).collect()
    want, n = brute([t for k, t in rows if (k or 0) % 5 != 1], [t for _, t in rows])
    assert model.tokens == n and len(got) == len(rows)
    key = lambda x: tuple(round(float(v), 6) for v in x)
    assert np.allclose(sorted(key(g[1:]) for g in got), sorted(key(w) for w in want), atol=1e-5)


def test_hash_arrays(tmp_path):
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 500, 5000):
        keys = np.unique(r.integers(0, 1 << 58, n, np.uint64)) | np.uint64(5 << 58)  # six common bits
        ngrams._put_keys(f"file://{tmp_path}/k{n}", keys, 6)
        data = np.fromfile(f"{tmp_path}/k{n}", np.uint8)
        assert ngrams._search(data, keys, 6).tolist() == list(range(len(keys)))
        assert (ngrams._search(data, r.integers(0, 1 << 58, 300, np.uint64) | np.uint64(5 << 58), 6) == -1).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = ngrams.train(df, F.lit(True))
    assert ngrams.score(df, model, ["doc_id"]).count() == 0
    one = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    assert ngrams.score(one, model, ["doc_id"]).first()["score"] == 0


def test_counts_beyond_32_bits(tmp_path):
    """Counts of words stay exact past 2 ** 32, at the last number of 32 bits and around it."""
    uri = f"file://{tmp_path}/model"
    times = np.array([1, 2**32 - 2, 2**32 - 1, 2**32, 7, 5 * 10**12 + 3], np.int64)
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, len(times)).astype(np.uint64))
    put(f"{uri}/hash-0", keys)
    put(f"{uri}/rank-0", np.arange(len(keys), dtype=np.uint32))
    ngrams._put_counts(f"{uri}/count-0", times, np.uint32)
    model = ngrams.Model(uri, 1)
    model.starts = np.zeros((len(ngrams.CLASSES) + 1, 1), np.int64)
    ids, n = model.ids(np.append(keys, np.uint64(2**64 - 5)))
    assert n.tolist() == [*times.tolist(), 0] and ids.tolist() == [*range(len(keys)), -1]


def test_mapped_bytes_are_bounded(tmp_path, monkeypatch):
    """A model of many files keeps some of them mapped, and finds what it finds with all of them."""
    uri, shards = f"file://{tmp_path}/model", 16
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 4000, np.uint64))
    model = ngrams.Model(uri, shards)
    model.starts = np.zeros((len(ngrams.CLASSES) + 1, shards), np.int64)
    for s in range(shards):
        own = keys[model.shard_of(keys) == s]
        put(f"{uri}/hash-{s}", own)
        put(f"{uri}/rank-{s}", np.arange(len(own), dtype=np.uint32))
        ngrams._put_counts(f"{uri}/count-{s}", np.arange(len(own)) + 1, np.uint32)
    monkeypatch.setattr(ngrams, "MAP_BYTES", 10_000)
    for _ in range(2):
        ids, n = model.ids(keys)
        assert (n == ids + 1).all() and (ids >= 0).all()
        assert sum(a.nbytes for a in model._maps.values()) <= 10_000
