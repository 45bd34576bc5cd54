"""Importance resampling against plain counts, blocks and shards of any size."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.llm import blocks, importance, queries
from folioflow.llm._text import alnum_words
from folioflow.llm.blocks import parted


def features(text):
    w = alnum_words((text or "").encode())
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(zlib.crc32(f) % 10000 for f in features(x)[1])
    for x in target:
        t.update(zlib.crc32(f) % 10000 for f in features(x)[1])
    every, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (every + 10000) / ((s[b] + 1) * (wanted + 10000)))) for b in range(10000)]
    rows = []
    for k, x in docs:
        n, f = features(x)
        weight = sum(gain[zlib.crc32(g) % 10000] for g in f)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus():
    r = random.Random(2)
    word = lambda: r.choice("Alpha beta gamma été the of x1".split()) if r.random() < 0.6 else f"w{r.randrange(400)}"
    text = lambda n: r.choice([" ", ", "]).join(word() for _ in range(n))
    docs = [(k, text(r.randint(0, 60))) for k in range(200)]
    docs += [(300, None), (301, ""), (302, "one"), (303, "one two"), (None, text(30)), (304, docs[7][1]), docs[8], (305, text(9000)), (306, " -- "), (307, f"a {'x' * 94} {'y' * 95} {'z' * 96} b {'q' * 300} c {'q' * 300}")]
    return docs, [text(25) for _ in range(10)] + [None, "", "short"]


def written(spark, tmp_path, docs, target):
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as weight", "'c' as keys", "'c' as block", "'c' as _side", "'c' as rank").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "1 as item_id", "2 as doc_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_registered_query(spark, tmp_path):
    docs, target = corpus()
    got = queries.op13_resample(spark, written(spark, tmp_path, docs, target))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target)


def test_many_pieces_and_shards(spark, monkeypatch):
    docs, target = corpus()
    monkeypatch.setattr(importance, "GATHER", 900)
    monkeypatch.setattr(importance.feature_weights, "__defaults__", (importance.BUCKETS, 3000))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d, t, percent=50, least_words=10).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, 50, 10)


def test_empty_tables(spark):
    d, t = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(d.where("false"), t).count() == 0
    got = importance.resample(d, t.where("false"), least_words=1, percent=100)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == sorted(plain([(1, "a b c"), (2, None)], [], 100, 1))


def test_ranks_are_places_in_a_total_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 50).alias("v"))
    got = importance.ranked(df.repartition(5), [F.col("v").desc(), F.col("id")], f"file://{tmp_path}/r").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [r["id"] for r in sorted(got, key=lambda r: (-r["v"], r["id"]))]
    assert sorted(r["rank"] for r in got) == list(range(1, 501))


def test_packing():
    r = np.random.default_rng(0)
    arrays = [r.integers(0, 1 << int(b), n) for b, n in ((1, 5), (9, 0), (33, 7), (62, 3))] + [np.zeros(4, np.int64)]
    assert [a.tolist() for a in blocks.unpacked(blocks.packed(*arrays))] == [a.tolist() for a in arrays]
    assert blocks.words_of(blocks.squeezed([b"a", b"\xc3\xa9"])) == [b"a", b"\xc3\xa9"]


def test_crc_side_by_side():
    r = random.Random(4)
    some = [r.randbytes(r.choice([0, 1, 2, 5, 30, 95, 96, 97, 400])) for _ in range(300)] + [b""]
    found = importance.crc32_of(pa.array(some, pa.binary()).slice(3))
    assert found.tolist() == [zlib.crc32(x) for x in some[3:]]


def test_hashes_of_n_grams_from_those_of_words():
    r = random.Random(6)
    texts = [b" ".join(bytes(r.choice(b"abcxyz09") for _ in range(r.choice([1, 2, 7, 93, 94, 95, 96, 97, 200]))) for _ in range(r.randrange(8))) for _ in range(40)]
    words, ids = importance._read(texts)
    for n, (starts, crc) in enumerate(importance.gram_hashes(words, ids), 1):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[k] for k in ids[i : i + n])) for i in starts.tolist()]
    assert [b" ".join(words[k] for k in x[:-1]) for x in np.split(ids, np.flatnonzero(ids == len(words)) + 1) if len(x)] == texts


def test_reading_words_makes_no_object_for_each():
    texts = [b"Ab, c\xc3\xa9d\x0be  f-1 " * 20_000, b"", b"...", b"last"]
    plain = sorted(set(alnum_words(b" ".join(texts))))
    tracemalloc.start()
    words, ids = importance._read(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == plain
    assert [words[k] if k < len(words) else None for k in ids.tolist()] == [w for t in texts for w in [*alnum_words(t), None]]
    assert peak < 20 * len(texts[0])  # 32 with a list of the words


def test_words_between_blanks():
    for text in (b"", b" ", b"a", b"  a b  \xff ccc ", b"x " * 9):
        assert parted(text).to_pylist() == text.split()
