"""The pipeline's stages on a small corpus whose outcome is known."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def write_corpus(spark, path):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(4000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, text(15)) for k in range(5)]
    docs, labels = [], []
    for k in range(300):
        t = text(r.randint(20, 60))
        toxic = k % 7 == 0
        if toxic:
            t += " " + r.choice(["vilefoo", "vilebar"]) + " " + text(3)
        docs.append((k, t, r.choice(["en", "de"]), f"src{r.randint(0, 3)}", len(t)))
        labels.append((k, 1, int(toxic)))
    base = text(120)
    near = [(400 + k, base.replace(base.split()[k * 3], "changed", 1), "en", "src0", len(base)) for k in range(6)]
    leak = [(500, f"before {bench[0][1]} after", "en", "src1", 1), (501, f"mail me at some.one@mail.example.com {text(20)}", "en", "src1", 1), (502, None, "en", "src2", None), (503, "", "en", "src2", 0)]
    exact = [(600, docs[1][1], "en", "src0", 1)]
    spark.createDataFrame(docs + near + leak + exact, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_run(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = write_corpus(spark, path)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    toxic = {k for k in range(300) if k % 7 == 0}
    clean = {d[0] for d in docs} - toxic
    assert len(toxic & set(out)) <= 2 and clean <= set(out)
    assert {k for k in out if 400 <= k < 410} == {400} and 600 not in out
    assert out[500]["text"] == "before  after" and out[500]["n_chars"] == len("before  after")
    assert out[501]["text"].startswith("mail me at [EMAIL] ")
    assert out[502]["text"] is None and out[503]["text"] == ""
    assert set(out[0 if 0 in out else 1].__fields__) == {"doc_id", "text", "lang", "source", "n_chars", "mix_block", "mix_slot", "mix_release", "mix_due"}


def test_clashing_columns(spark, tmp_path):
    """Columns named like those that operators add or use pass through."""
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}"
    write_corpus(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(60)
    names = ("toxic", "score", "kept", "node", "spans", "row", "s", "component_id", "_text")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert {tuple(r[n] for n in names) for r in out.collect()} == {names}, name


def test_stages_keep_columns_and_pass_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    write_corpus(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0
        if name != "mixing":
            assert out.columns == docs.columns


def test_repeated_and_null_ids_are_judged_by_text(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(1, text("a")), (1, text("b")), (1, text("c")), (2, text("b")), (None, text("c")), (None, text("d")), (None, text("d")), (3, None), (3, None), (4, text("e"))]
    docs = spark.createDataFrame([(*x, "en", "src0", "row") for x in rows], "doc_id long, text string, lang string, source string, row string").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(1, text("a")), (1, text("b")), (1, text("c")), (None, text("d")), (3, None), (3, None), (4, text("e"))]
    assert got == sorted(want, key=str)
