"""Licence scan: phrase places against a plain search, automaton against all substrings."""

import random

from folioflow.llm import licences
from folioflow.llm._text import alnum_words


def test_automaton_holds_exactly_the_substrings():
    r = random.Random(4)
    for _ in range(50):
        texts = [[bytes([r.choice(b"abc")]) for _ in range(r.randint(0, 9))] for _ in range(3)]
        a = licences.Automaton(texts)
        have = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for n in range(1, 5):
            for _ in range(40):
                w = [bytes([r.choice(b"abc")]) for _ in range(n)]
                v = 0
                for c in w:
                    v = a.next[v].get(a.ids.get(c), -1) if v >= 0 else -1
                assert (v >= 0) == (tuple(w) in have)
                if v >= 0:
                    ends = {(k, e) for k, t in enumerate(texts) for e in range(n, len(t) + 1) if t[e - n : e] == w}
                    assert ends == set(a.places[v])


def test_places():
    r = random.Random(1)
    s = licences.Scanner()
    vocab = "mit license apache general public the a version".split()
    for _ in range(200):
        words = [r.choice(vocab).encode() for _ in range(r.randint(0, 60))]
        want = sorted((k, i) for k, (_, p) in enumerate(s.phrases) for i in range(len(words)) if words[i : i + len(p)] == p)
        assert sorted(s.scan(words)[0]) == want


def test_covers():
    s = licences.Scanner()
    text = "Some code. " + licences.TEMPLATES[3][1] + " More code."
    _, (covers, share) = s.scan(alnum_words(text.encode()))
    assert share == 1.0 and "mit" in {s.templates[k][0] for k, *_ in covers}
    changed = text.replace("without restriction", "with no such restriction").replace("merge", "join")
    assert "mit" in {s.templates[k][0] for k, *_ in s.scan(alnum_words(changed.encode()))[1][0]}
    assert s.scan(alnum_words(b"in the software of the person to the use"))[1][0] == []


def test_table(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0. MIT LICENSE"), (2, None), (3, ""), (None, "mit license"), (1, "Licensed under CC BY-NC 4.0. MIT LICENSE"), (4, "mit license " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, places string")
    got = {r["doc_id"]: r for r in licences.licence_scan(df.drop("places"), ["doc_id"]).collect()}
    assert [c["label"] for c in got[1]["covers"]] == ["cc-by-nc"] and [p["start"] for p in got[1]["places"]] == [7]
    assert got[2]["n_words"] == 0 and got[3]["places"] == [] and len(got[4]["places"]) == 20_000
    assert licences.licence_scan(df.limit(0), ["doc_id"]).count() == 0
