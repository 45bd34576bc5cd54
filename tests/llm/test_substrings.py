"""Repeated substrings against a search for every string; the suffix sorter against plain sorting."""

import hashlib
import random

import numpy as np

from folioflow.llm import substrings
from folioflow.llm.dc3 import equal_prefixes, suffix_order


def test_suffix_order():
    r = np.random.default_rng(1)
    for _ in range(1500):
        n, k = r.integers(0, 60), r.integers(1, 5)
        s, depth = r.integers(1, k + 1, n), int(r.choice([1000, 4, 10]))
        order = suffix_order(s, int(k), depth)
        assert sorted(order.tolist()) == list(range(n))
        cut = [s[i : i + depth].tolist() for i in order]
        assert cut == sorted(cut)
        wanted = r.random(n) < r.random()
        some = suffix_order(s, int(k), depth, wanted=wanted)
        assert sorted(some.tolist()) == np.flatnonzero(wanted).tolist()
        cut = [s[i : i + depth].tolist() for i in some]
        assert cut == sorted(cut)


def test_equal_prefixes():
    u = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    a = np.arange(0, 100)
    assert equal_prefixes(u, a, a + 10, 100).all() and not equal_prefixes(u, a, a + 3, 100).any()


def corpus(seed):
    r = random.Random(seed)
    bit = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    passages = [bit(r.randint(60, 400)) for _ in range(6)]
    rows = []
    for k in range(120):
        text = "".join(r.choice([bit(r.randint(0, 80)), r.choice(passages), r.choice(passages)[r.randint(0, 50) :]]) for _ in range(r.randint(0, 5)))
        rows.append((k * 3, text))
    rows += [(1000, rows[5][1]), (1001, "the " * 300), (1002, "x" * 500), (1003, "ab" * 40), (1004, passages[0][:120] * 3)]
    return r.sample(rows, len(rows))


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, doc int").repartition(3)
        assert result(substrings.remove_repeats(df)) == sorted(substrings.brute_force(rows), key=str)
        assert result(substrings.remove_repeats(df, most=1)) == sorted(substrings.brute_force(rows), key=str)  # strings dealt one by one


def test_nulls_and_repeated_ids(spark):
    rows = corpus(3)
    rows += [(None, rows[0][1]), (None, None), (7, None), (8, ""), rows[4], (rows[5][0], "the " * 100), (rows[5][0], "the " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substrings.remove_repeats(df)) == sorted(substrings.brute_force(rows), key=str)


def test_pieces_of_long_texts(monkeypatch):
    """Runs of a text are the same whether it is hashed whole or in pieces."""
    r = random.Random(4)
    text = "".join(r.choice("ab") for _ in range(3000)).encode()

    def strings():
        out = set()
        for number, offset, held in substrings.chunks([b"short", text]):
            s, piece, starts = substrings._joined(held)
            for a, _, at, n in zip(*substrings.runs(s, piece, np.empty(0, np.uint64)), strict=True):
                first = int(at - starts[piece[at]] + offset[piece[at]])
                out |= {(int(number[piece[at]]), first + k, int(a)) for k in range(n)}
        return out

    whole = strings()
    assert len(whole) == len(text) - substrings.LENGTH + 1
    monkeypatch.setattr(substrings, "PIECE", 700)
    assert strings() == whole


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
