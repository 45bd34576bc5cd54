"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np

from folioflow.llm import blocks, phrases, queries


def plain(rows, least, longest=5, percent=100, top=2000):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        g = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[g] += len(w)
            for k in range(1, longest + 1):
                f.update((g, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: c for k, c in f.items() if c >= least}
    longer = {}
    for (g, w), c in f.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    longer[g, w[i:j]] = max(longer.get((g, w[i:j]), 0), c)
    out = {}
    for (g, w), a in f.items():
        if len(w) > 1 and not 100 * longer.get((g, w), -1) >= percent * a:
            s, k = min((1000 * a * n[g] // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(g, []).append((-s, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
    return sorted((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, some in out.items() for i, (s, a, p, left, right) in enumerate(sorted(some)[:top]))


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice(["The", "of", "été", "a", "b", "c-d", "Éa", "x" * 9, "\x01y"])
    rows = [(k, "".join(word() + r.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "de", None])) for k in range(120)]
    return rows + [(500, None, "en"), (501, "", None), (502, " .,; ", "fr"), (503, "a a a a a a a a a", "xx"), (None, "b b. b b", "de"), (504, "the of a " * 3000, "en"), *rows[:5]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_equals_plain(spark, monkeypatch):
    rows = corpus()
    for size in (300, 1 << 20):  # many blocks, and few
        monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
        monkeypatch.setattr(blocks.token_blocks, "__defaults__", (*blocks.token_blocks.__defaults__[:-1], size))
        got = phrases.collocations(frame(spark, rows).repartition(3), least=4).collect()
        assert sorted(map(tuple, got)) == plain(rows, 4)
    got = phrases.collocations(frame(spark, rows), least=7, longest=3, percent=60, top=9).collect()
    assert sorted(map(tuple, got)) == plain(rows, 7, 3, 60, 9)


def test_registered_query(spark, tmp_path):
    rows = corpus(8)
    frame(spark, rows).selectExpr("*", "1 as n", "2 as block", "3 as a", "4 as phrase", "5 as rank").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_collocations(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 100)


def test_empty(spark):
    assert phrases.collocations(frame(spark, [(1, None, None)]).where("false")).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "a b", "x")])).count() == 0


def test_scores_beyond_64_bits(spark):
    """The quotient is exact where the products need some 90 bits."""
    big = 4 * 10**11 + 7
    row = spark.sql(f"select cast({big} as decimal(38,0)) as a, cast({7 * 10**12 + 3} as decimal(38,0)) as n, cast({big + 11} as decimal(38,0)) as l")
    got = row.selectExpr("cast(cast(1000 as decimal(4,0)) * a * n as decimal(38,0)) div cast(l * l as decimal(38,0)) as q").first()["q"]
    assert got == 1000 * big * (7 * 10**12 + 3) // (big + 11) ** 2


def test_merge_join():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 40, r.integers(0, 30))) for _ in range(2))
        i, j = phrases.merge_join(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a) & set(b))
