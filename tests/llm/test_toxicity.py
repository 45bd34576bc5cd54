"""The classifier's held-out accuracy, its gradient, and edge cases."""

import random

import numpy as np

from folioflow.llm import toxicity


def corpus(n, seed):
    r = random.Random(seed)
    bad = ["vilefoo", "vilebar", "nastyx"]
    out = []
    for k in range(n):
        words = [f"w{int(r.paretovariate(0.8))}" for _ in range(r.randint(1, 80))]
        toxic = k % 6 == 0
        if toxic:
            words.insert(r.randint(0, len(words)), r.choice(bad))
        out.append((k, " ".join(words), r.choice(["en", "de", None]), int(toxic)))
    return out


def codes(text):
    return toxicity.word_codes(text.encode().split(), {})


def test_held_out_accuracy():
    rows = corpus(900, 1)
    model = toxicity.train([codes(t) for _, t, _, _ in rows], np.array([y for *_, y in rows]), [x or "" for _, _, x, _ in rows], steps=500)
    test = corpus(400, 2)
    s = model.scores([codes(t) for _, t, _, _ in test])
    y = np.array([t[3] for t in test])
    assert ((s >= 0.3) == y).mean() > 0.97
    assert model.scores([codes("vilenew word")])[0] > model.scores([codes("other word")])[0]  # a form that was never seen


def test_slabs_do_not_change_scores(monkeypatch):
    model = toxicity.Model(3)
    docs = [codes(t) for _, t, _, _ in corpus(40, 5)] + [codes("")]
    whole = model.scores(docs)
    monkeypatch.setattr(toxicity, "SLAB", 17)
    assert np.allclose(whole, model.scores(docs))
    assert np.allclose(whole, [model.scores([d])[0] for d in docs])


def test_gradient():
    """One small step lowers the loss on its own batch."""
    model = toxicity.Model(3)
    docs, y = [codes(t) for _, t, _, _ in corpus(32, 5)], np.array([c[3] for c in corpus(32, 5)], np.float32)
    loss = lambda: float(np.mean(np.logaddexp(0, model.logits(docs)) - y * model.logits(docs)))
    before, state = loss(), {}
    for t in range(1, 6):
        model.step(docs, y, state, t, 0.003)
    assert loss() < before


def test_table(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(k, t, x, 0.5) for k, t, x, _ in rows] + [(900, None, "en", 0.5), (901, "", None, 0.5), (None, "w1", "en", 0.5), (902, "w1 " * 30_000, "en", 0.5), (0, rows[0][1], "en", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, y, "x") for k, _, _, y in rows] + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit_model(docs, labels)
    out = toxicity.score(docs.drop("score"), model, ["doc_id"], lang="lang").collect()
    assert len(out) == 305 and all(0 <= r["score"] <= 1 for r in out)
    none = toxicity.fit_model(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {toxicity.PRIOR}
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_an_id_with_many_texts_is_learned_from_once(spark, monkeypatch):
    """Labelled rows stay within their bound when ids repeat; which text counts doesn't depend on the order of rows."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda docs, y, langs: seen.append(([d.tolist() for d in docs], y.tolist(), langs)))
    rows = [(k % 5, f"text {k % 20} words", "en") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, toxic int")
    for some in (rows, rows[::-1]):
        toxicity.fit_model(spark.createDataFrame(some, "doc_id long, text string, lang string"), labels)
    assert len(seen[0][0]) == 5 and seen[0] == seen[1]


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Of many rows each one changes the model, and shards give as good a one as one set."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    rows = corpus(1200, 5)
    make = lambda some: (spark.createDataFrame([(k, t, x) for k, t, x, _ in some], "doc_id long, text string, lang string"), spark.createDataFrame([(k, y) for k, _, _, y in some], "doc_id long, toxic int"))
    seen = []
    real = toxicity.train_shards
    monkeypatch.setattr(toxicity, "train_shards", lambda coded, n, toxic: seen.append((coded.count(), n, toxic)) or real(coded, n, toxic))
    docs, labels = make(rows)
    model = toxicity.fit_model(docs, labels, rows=400)
    assert seen == [(1200, 1200, sum(y for *_, y in rows))]
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    good, bad = ([score[k] for k, *_, y in rows if y == kind] for kind in (0, 1))
    assert sum(b > g for b in bad for g in good) > 0.9 * len(bad) * len(good)
    again = toxicity.fit_model(*make(rows[::-1]), rows=400)
    assert all(np.array_equal(model.p[c], again.p[c]) for c in model.p) and model.thresholds == again.thresholds
