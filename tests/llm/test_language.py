"""Language identification: held-out accuracy, the backoff rule against a plain version, odd rows."""

import math
import random
import zlib
from collections import Counter

import pytest

from folioflow.llm import language, queries


def made(r, letters, n):
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    pools = {"xx": made(r, "abcde", 80), "yy": made(r, "cdefg", 80), "zz": made(r, "mnopé", 80)}
    rows = [(k, " ".join(r.choice(pools[g]) for _ in range(r.randint(1, 40))) + r.choice(["", ".", " 12"]), g) for k in range(150) for g in [r.choice(sorted(pools))]]
    rows += [(200, None, "xx"), (201, "", "yy"), (202, "123 -- 4_5", "xx"), (203, "abcab bcd", None), (None, "mno pom", "zz"), (205, "日本 кот", "xx"), (206, "eecc abc " * 9000, None), *rows[:3]]
    return rows


def plain(rows, texts):
    """Dictionaries and loops."""
    counts = {}
    for _, t, g in rows:
        if g is not None:
            counts.setdefault(g, Counter()).update(language.words(t or ""))
    langs = sorted(g for g in counts if counts[g])
    tables = {(g, 0): counts[g] for g in langs}
    for n in language.SIZES:
        for g in langs:
            c = Counter()
            for w, k in counts[g].items():
                for x in language.grams(w, n):
                    c[x] += k
            tables[g, n] = c
    known = {n: set().union(*(tables[g, n] for g in langs)) for n in (0, *language.SIZES)}
    share = lambda g, n, x: math.log((tables[g, n][x] + 0.5) / (sum(tables[g, n].values()) + 0.5 * (len(tables[g, n]) + 1)))

    def adds(w, g):
        if w in known[0]:
            return share(g, 0, w)
        for n in language.SIZES:
            if some := [x for x in language.grams(w, n) if x in known[n]]:
                return sum(share(g, n, x) for x in some) / len(some)
        return 0.0

    out = []
    for t in texts:
        ws = language.words(t or "")
        if not ws:
            out.append(("und", 0.0))
            continue
        sums = {g: sum(adds(w, g) for w in ws) for g in langs}
        best = max(langs, key=lambda g: (sums[g], [-ord(c) for c in g]))
        out.append((best, 1 / sum(math.exp((s - sums[best]) / len(ws)) for s in sums.values())))
    return out


def test_equals_a_plain_version(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learn = [d for d in docs if d[0] is None or d[0] % 3]
    model = language.fit(spark.createDataFrame(learn, df.schema))
    texts = [t for _, t, _ in docs] + ["abcx unseenabc qqq", "ééé", "zzzz"]
    names, scores = model.predict([language.words(t or "") for t in texts])
    for got, score, (want, s) in zip(names, scores, plain(learn, texts), strict=True):
        assert score == pytest.approx(s, abs=1e-9) and (got == want or s < 0.51)


def test_registered_query(spark, docs, tmp_path):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    clash = df.selectExpr("*", "'c' as score", "'c' as lang_pred", "'c' as word", "'c' as k", "'c' as n")
    clash.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_language(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    for k, _, _ in docs:
        assert by[k]["held_out"] == (zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 0) and 0 <= by[k]["score"] <= 1
    assert {by[k]["lang_pred"] for k in (200, 201, 202)} == {"und"} and by[None]["lang_pred"] == "zz"
    held = [(g, by[k]["lang_pred"]) for k, t, g in docs if k is not None and k < 150 and by[k]["held_out"]]
    assert len(held) > 15 and sum(a == b for a, b in held) / len(held) > 0.9
    # held-out rows' languages and texts are not learned from
    turned = [(k, t, "other" if k is not None and zlib.crc32(str(k).encode()) % 5 == 0 else g) for k, t, g in docs]
    spark.createDataFrame(turned, df.schema).write.parquet(f"{tmp_path}/turned/documents.parquet")
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op12_language(spark, f"{tmp_path}/turned").collect()}
    assert all(again[k] == (by[k]["lang_pred"], by[k]["score"]) for k in by)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, "xx")], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.langs == [] and language.predict(df, model, ["doc_id"]).select("lang_pred", "score").distinct().collect() == [("und", 0.0)]
    empty = df.where("false")
    assert language.predict(empty, language.fit(empty), ["doc_id"]).count() == 0


def test_bounds(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    small = language.fit(df, n_words=5, n_grams=4)
    assert len(small.places[0]) <= 15 and all(len(small.places[n]) <= 12 for n in language.SIZES)
    monkeypatch.setattr(language, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language.fit(df)
