"""Every registered query of the subpackage against a plain version, on tables with odd rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ngrams import brute as lm_brute
from test_pii import plain

from folioflow.llm import licences, mixing, queries, toxicity
from folioflow.llm._text import alnum_words

CLASH = ("spans", "places", "score", "kept", "n_tokens", "items", "component_id", "toxic", "mix_slot", "digest", "doc", "file", "anchor", "bucket", "node", "members", "row", "s", "h", "cell", "rank", "hot", "_text", "_digest")
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, and the rows of documents as (doc_id, text, lang, source)."""
    r = random.Random(11)
    word = lambda: r.choice("alpha beta gamma delta mit license apache general public Été x1 the of and".split()) if r.random() < 0.5 else f"w{r.randrange(900)}"
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, text(r.randint(12, 30))) for k in range(12)] + [(100, "short item here"), (101, None), (102, "")]
    passage = text(60)
    docs = []
    for k in range(160):
        t = text(r.randint(0, 90))
        if k % 6 == 0:
            t += " " + r.choice(["vilefoo", "vilebar", "vilebaz"])
        if k % 9 == 0:
            t += " mail a.b@c.example.org or call +1 (555) 123-4567, host 10.0.0.255, card 4111 1111 1111 1111"
        if k % 10 == 0:
            t += f" {passage}"
        if k % 13 == 0:
            t += f" {bench[k % 12][1]}"
        if k % 17 == 0:
            t += " Licensed under CC BY-NC 4.0. short ITEM here"
        docs.append((k, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", "other", None])))
    docs += [(200 + k, docs[20][1], "en", "src0") for k in range(4)] + [(300, None, None, None), (301, "", "en", "src0"), (302, " \t ", "en", "src1"), (None, "null id alpha", "en", "src0"), (400, text(6000), "en", "src0")]
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in CLASH})
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").withColumn("spans", F.lit(1)).write.parquet(f"{path}/benchmark.parquet")
    labels = [(k, 1, int("vile" in (t or ""))) for k, t, *_ in docs if k is not None and k < 160]
    spark.createDataFrame([*labels, (5, 1, 0), (5, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    n = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in n.normal(0, 0.1, 12)]) for k in range(400)] + [(500, None), (600, [None] * 12), (None, [0.0] * 12)]
    spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, label int, score int").write.parquet(f"{path}/embeddings.parquet")
    return str(path), docs, bench


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op2(spark, tables):
    path, docs, _ = tables
    got = rows(queries.op2_pii(spark, path))
    assert len(got) == len(docs)
    for k, t, *_ in docs:
        want = plain(t or "")
        kinds = [x[0] for x in want]
        assert [got[k][f"n_{c}"] for c in ("email", "ip", "card", "phone")] == [kinds.count(c) for c in ("email", "ip", "card", "phone")]
        assert got[k]["base_sha256"] == SHA(",".join(f"{c}:{a}:{b}" for c, a, b in want))
        assert {f"{c}:{a}:{b}" for c, a, b in want} <= set(got[k]["spans"].split(","))


def earliest_deadline(blocks, weights):
    """(source, block, slot) by the rule itself, slot by slot, with exact fractions."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        w = {s: Fraction(str(weights.get(s, 1.0))) for s in left}
        total = sum(w.values())
        k, t = dict.fromkeys(left, 0), 0
        while True:
            ready = [(-(-(k[s] + 1) * total // w[s]), s) for s in left if k[s] * total / w[s] < t + 1 and math.floor(k[s] * total / w[s]) <= t]
            due, s = min(ready)
            assert t < due
            out.append((s, done[s], start + t))
            k[s], done[s], left[s], t = k[s] + 1, done[s] + 1, left[s] - 1, t + 1
            if not left[s]:
                del left[s]
                break
        start += t
    return sorted(out)


def test_op3(spark, tables):
    path, docs, _ = tables
    got = queries.op3_mix(spark, path).collect()
    assert len(got) == len(docs)
    count = {}
    for *_, s in docs:
        count[s or ""] = count.get(s or "", 0) + 1
    want = earliest_deadline({s: -(-n // mixing.BLOCK_ROWS) for s, n in count.items()}, queries.WEIGHTS)
    assert sorted({(r["source"] or "", r["mix_block"], r["mix_slot"]) for r in got}) == want
    sizes = {}
    for r in got:
        sizes[r["source"] or "", r["mix_block"]] = sizes.get((r["source"] or "", r["mix_block"]), 0) + 1
    assert all(n == mixing.BLOCK_ROWS or b == -(-count[s] // mixing.BLOCK_ROWS) - 1 for (s, b), n in sizes.items())


def test_schedule_is_earliest_deadline_first():
    r = random.Random(7)
    for _ in range(60):
        blocks = {f"s{k}": r.randint(0, 60) for k in range(r.randint(1, 7))}
        weights = {s: r.choice([0.3, 1, 2, 7.25, 40]) for s in blocks}
        phases = mixing.plan(blocks, weights)
        got = [(s, int(b), int(t)) for s, n in blocks.items() for b, t in zip(range(n), mixing.place(phases, s, np.arange(n))[0], strict=True)]
        assert sorted(got) == earliest_deadline(blocks, weights)


def test_op5_is_in_test_tokens():
    from test_tokens import test_registered_query

    assert test_registered_query


def test_op6(spark, tables):
    path, docs, _ = tables
    crc = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5
    want, n = lm_brute([t for k, t, *_ in docs if crc(k) != 1], [t for _, t, *_ in docs])
    got = rows(queries.op6_lm_score(spark, path))
    for (k, *_), (tokens, known, base, score) in zip(docs, want, strict=True):
        g = got[k]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (crc(k) == 1, tokens, known, n)
        assert g["base_score"] == pytest.approx(base, abs=1e-6) and g["score"] == pytest.approx(score, abs=1e-5)


def test_op7(spark, tables):
    path, docs, _ = tables
    got = rows(queries.op7_licences(spark, path))
    for k, t, *_ in docs:
        words = alnum_words((t or "").encode())
        found = [(i, label) for p, label in licences.PHRASES for q in [p.encode().split()] for i in range(len(words)) if words[i : i + len(q)] == q]
        g, starts = got[k], [i for i, _ in found]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert g["base_labels"] == ",".join(sorted({label for _, label in found})) and set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(","))
        assert ("cc-by-nc" in g["labels"].split(",")) == ("CC BY-NC" in (t or "")) and 0 <= g["score"] <= 1


def test_every_copy_of_a_template_is_a_span():
    s = licences.Scanner()
    notice = licences.TEMPLATES[6][1]
    gap = " ".join(f"word{k}" for k in range(50))
    words = lambda t: alnum_words(t.encode())
    n, g = len(words(notice)), len(words(gap))
    covers = [c[1:3] for c in s.scan(words(f"{notice} {gap} {notice} {notice}"))[1][0] if c[0] == 6]
    assert covers == [(0, n), (n + g, 2 * n + g), (2 * n + g, 3 * n + g)]
    more = licences.Scanner(templates=[*licences.TEMPLATES, ("own", "one two three four five six seven eight nine ten")])
    assert [more.templates[c[0]][0] for c in more.scan(words("x one two three four five and six seven eight nine ten y"))[1][0]] == ["own"]


def naive_scores(model, docs):
    """The classifier's definition, position by position."""
    out = []
    for codes in docs:
        e = [model.embed(np.array([c], np.uint32))[0] for c in codes] + [np.zeros(toxicity.DIM)] * 2
        pooled = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                r = [sum(float(e[i + j] @ model.p["conv"][toxicity._PARTS.index((w, j))][:, f]) for j in range(w)) for i in range(len(codes))]
                pooled.append(max(r, default=0.0))
        h = np.maximum(np.array(pooled) + model.p["bias"], 0)
        z = float(h @ model.p["out"] + model.p["base"][0]) * model.scale + model.shift
        out.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
    return out


def test_op8(spark, tables):
    path, docs, _ = tables
    crc = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 4
    got = rows(queries.op8_toxicity(spark, path))
    df, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.fit_model(df, labels, fold=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    want = naive_scores(model, [toxicity.word_codes(alnum_words((t or "").encode()), {}) for _, t, *_ in docs])
    for (k, *_), s in zip(docs, want, strict=True):
        g = got[k]
        assert g["score"] == pytest.approx(s, abs=1e-4) and g["held_out"] == (crc(k) == 2) and g["predicted"] == int(g["score"] >= 0.3)
    # the fold that is held out is never learned from
    held = [k for k, *_ in docs if k is not None and k < 160 and crc(k) == 2]
    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit_model(df, turned, fold=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    assert all(np.array_equal(model.p[x], again.p[x]) for x in model.p)


def test_long_texts_are_learned_from(monkeypatch):
    """A step on long texts, slab by slab, moves every parameter as a step on all their words at once does, gaps and ends included."""
    r = np.random.default_rng(4)
    docs = [r.integers(1, 1 << 27, n).astype(np.uint32) for n in (9000, 0, 1, 2, 300)]
    y = np.array([1, 0, 1, 0, 1], np.float32)
    models = []
    for slab in (97, 1 << 20):
        monkeypatch.setattr(toxicity, "SLAB", slab)
        m, state = toxicity.Model(2), {}
        m.p["bias"] += 0.3  # lets filters through
        for t in (1, 2, 3):
            m.step(docs, y, state, t, 0.01)
        models.append(m)
    for x in models[0].p:
        assert np.abs(models[0].p[x] - models[1].p[x]).max() < 1e-6
    # the largest responses are those of every window that begins in the text, by the definition
    m = toxicity.Model(3)
    for d in docs:
        top, at = m.winners(d)
        e = np.vstack([m.embed(d), np.zeros((2, toxicity.DIM), np.float32)])
        for k, w in enumerate(toxicity.WIDTHS):
            every = sum(e[j : j + len(d)] @ m.p["conv"][toxicity._PARTS.index((w, j))] for j in range(w))
            own = slice(k * toxicity.FILTERS, (k + 1) * toxicity.FILTERS)
            assert np.allclose(top[own], every.max(axis=0, initial=-np.inf), atol=1e-5)
            assert not len(d) or np.allclose(every[at[own], np.arange(toxicity.FILTERS)], top[own], atol=1e-5)


def test_op9(spark, tables):
    path, docs, bench = tables
    windows = {}
    for item, t in bench:
        w = alnum_words((t or "").encode())
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    got = rows(queries.op9_decontaminate(spark, path))
    for k, t, *_ in docs:
        words = alnum_words((t or "").encode())
        hit, items = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= found
        g = got[k]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (len(words), len(hit), len(items), SHA(",".join(sorted(items))), bool(hit))


def test_op10(spark, tables):
    path, docs, _ = tables
    cut = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    sets = {k: {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set()) for k, t, *_ in docs for w in [cut(t)] if k is not None}
    top = {k: k for k in sets}
    find = lambda k: k if top[k] == k else find(top[k])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    got = rows(queries.op10_near_duplicates(spark, path))
    for k in ids:
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (len(sets[k]), find(k), find(k) == k)
    assert got[None]["kept"] and got[None]["component_id"] is None


def test_op1_and_op4(spark, tables):
    from test_mixing_topk import brute as top_brute

    from folioflow.llm import substrings

    path, docs, _ = tables
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op1_repeated_substrings(spark, path).collect()), key=str)
    assert got == sorted(substrings.brute_force([d[:2] for d in docs]), key=str)
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = [x for x in top_brute(vectors, 10) if x[0] % 100 == 0]
    assert sorted(map(tuple, queries.op4_top_k(spark, path).collect())) == want
