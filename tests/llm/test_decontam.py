"""FM-index search against a plain one."""

import random

import numpy as np

from folioflow.llm import decontam
from folioflow.llm._text import alnum_words
from folioflow.llm.fmindex import FMIndex, suffix_array


def test_suffix_array():
    r = random.Random(3)
    for _ in range(200):
        s = np.array([0] + [r.randint(0, 3) for _ in range(r.randint(0, 30))] + [0], np.int32)
        zeros = np.cumsum(s == 0) - 1
        full = [tuple((v, z if v == 0 else 0) for v, z in zip(s[k:], zeros[k:], strict=True)) for k in range(len(s))]
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=full.__getitem__)


def test_search_and_locate():
    r = random.Random(7)
    for _ in range(100):
        s = np.array([0] + [r.randint(0, 4) for _ in range(r.randint(0, 60))] + [0], np.int32)
        index = FMIndex(s, 4)
        m = r.randint(1, 4)
        p = np.zeros((1, 4), np.int32)
        p[0, 4 - m :] = [r.randint(1, 4) for _ in range(m)]
        lo, hi = index.search(p, np.array([m]))
        want = [k for k in range(len(s) - m + 1) if s[k : k + m].tolist() == p[0, 4 - m :].tolist()]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def plain(docs, items, window):
    out = {}
    for key, text in docs:
        words = alnum_words((text or "").encode())
        hit, names = set(), set()
        for item, t in items:
            w = alnum_words((t or "").encode())
            for k in range(max(1, len(w) - window + 1) if w else 0):
                p = w[k : k + window]
                for a in range(len(words) - len(p) + 1):
                    if words[a : a + len(p)] == p:
                        hit |= set(range(a, a + len(p)))
                        names.add(str(item))
        out[key] = (len(words), len(hit), sorted(names))
    return out


def test_table_in_one_part_and_several(spark):
    r = random.Random(9)
    word = lambda: r.choice(["a", "B", "c", "dé", "E1"])
    items = [(k, " ".join(word() for _ in range(r.randint(0, 9)))) for k in range(12)] + [(50, None), (51, "")]
    docs = [(k, r.choice([", ", " "]).join(word() for _ in range(r.randint(0, 50)))) for k in range(60)] + [(100, None), (101, ""), (102, "a b " * 20_000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, spans string")
    want = plain(docs[:-1], items, 4)
    for size in (1 << 20, 40):
        got = {x["doc_id"]: (x["n_words"], sum(s["end"] - s["start"] for s in x["spans"]), x["items"]) for x in decontam.find_hits(d, b, ["doc_id"], window=4, part_bytes=size).collect()}
        assert len(got) == len(docs)
        assert {k: got[k] for k in want} == want
    twice = d.where("doc_id < 5").unionByName(d.where("doc_id < 5"))
    assert decontam.find_hits(twice, b, ["doc_id"], window=4, part_bytes=40).count() == 10
    assert decontam.find_hits(d, b.limit(0), ["doc_id"]).where("size(spans) > 0").count() == 0
    assert decontam.find_hits(d.limit(0), b, ["doc_id"]).count() == 0


def test_removal(spark):
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x. One, two three FOUR! y", 3), (2, None, 3), (3, "one two three", 3)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r["text"] for r in decontam.remove_hits(d, b).collect()}
    assert got == {1: "x. ! y", 2: None, 3: "one two three"}


def test_removal_in_several_parts_is_that_in_one(spark):
    r = random.Random(4)
    word = lambda: r.choice(["a", "B", "c", "dé"])
    w = [f"w{k}" for k in range(1, 21)]
    items = [(k, " ".join(word() for _ in range(r.randint(2, 9)))) for k in range(12)] + [(50 + k, " ".join(w[2 * k : 2 * k + 8])) for k in range(7)] + [(60, None)]
    docs = [(k, r.choice([", ", " "]).join(word() for _ in range(r.randint(0, 50)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, f"x {' '.join(w)} y"), (103, f"{' '.join(w[:2])} a B c dé a B {' '.join(w[2:8])}")]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one, several = ({x["doc_id"]: x["text"] for x in decontam.remove_hits(d, b, window=6, part_bytes=size).collect()} for size in (1 << 20, 60))
    assert one[102] == "x  y" and one[100] is None and len(one) == len(docs)
    assert several == one
