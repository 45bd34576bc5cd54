"""Near-duplicate classes against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import minhash
from folioflow.llm.components import components


def brute(rows, size, percent):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or (sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b])):
                parent[top(a)] = top(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k), []).append(rows[k][0])
    return sorted(((i, len(sets[k]), min(groups[top(k)]) if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def corpus():
    r = random.Random(11)
    vocab = [f"w{k}" for k in range(300)]
    rows, at = [], 0
    for _ in range(25):
        text = [r.choice(vocab) for _ in range(r.choice([3, 30, 60, 120]))]
        for _ in range(r.choice([1, 2, 5, 14])):
            copy = list(text)
            for _ in range(r.randint(0, max(1, len(text) // 9))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((at, " ".join(copy).replace("w1", "W1")))
            at += 1
    return rows


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr("folioflow.llm.components.FOREST", at_once)
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {n: top(n) for e in edges for n in e if e[0] != e[1]}


def test_against_all_pairs(spark):
    rows = corpus()
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, rows[0][1]), (3, rows[3][1]), (5, rows[60][1]), (1006, "a b " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, component_id string")
    got = minhash.near_duplicates(df.select("doc_id", "text"), size=2, percent=80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 2, 80)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("stars", [0, 1])
def test_open_buckets_are_finished(spark, monkeypatch, stars):
    """Without star rounds, the block search alone finds the classes; after one that confirms nothing near the threshold, the rest."""
    rows = corpus()
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "SLACK", -0.1)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 40)
    monkeypatch.setattr(minhash, "MOST_SHINGLES", 400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, size=3, percent=80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 80)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate(spark):
    r = np.random.default_rng(1)
    pairs = []
    for share in (0.5, 0.8, 0.95):
        both = r.integers(0, 1 << 63, 2000, np.uint64)
        n = int(len(both) * (1 - share) / (2 * share))
        pairs.append([np.sort(np.concatenate([both, r.integers(0, 1 << 63, n, np.uint64)])) for _ in range(2)])
    rows = []
    for a, b in pairs:
        s = minhash.packed(minhash.minima([a, b])).view(np.int64)
        rows.append((100.0 * len(np.intersect1d(a, b)) / len(np.union1d(a, b)), s[0].tolist(), s[1].tolist()))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>")
    for row in df.select("j", minhash.estimate(F.col("a"), F.col("b")).alias("e")).collect():
        assert abs(row["j"] / 100 - row["e"]) < 0.13
