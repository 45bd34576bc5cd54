"""The kept index against full scans, before and after changes and merges."""

import os
import random
import re

from pyspark.sql import functions as F

from folioflow.operators import search, termindex
from folioflow.operators.termindex import TermIndex

WORDS = "the then this that of oak été x1 under_score a".split()


def fields():
    return {"title": F.col("title"), "text": F.col("text")}


def rows(r, keys):
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    return [(k, text(r.randint(0, 3)), r.choice([None, "", text(r.randint(0, 12))])) for k in keys]


def frame(spark, some):
    return spark.createDataFrame(some, "id long, title string, text string")


def has(row, leaf):
    f, w, open_ = leaf
    every = [x for name, t in (("title", row[1]), ("text", row[2])) if f in (None, name) for x in re.split(r"[\W_]+", (t or "").lower())]
    return any(x.startswith(w) if open_ else x == w for x in every if x)


def holds(row, tree):
    if tree[0] == "not":
        return not holds(row, tree[1])
    if tree[1] in ("and", "or") and isinstance(tree[0], tuple):
        a, b = holds(row, tree[0]), holds(row, tree[2])
        return a and b if tree[1] == "and" else a or b
    return has(row, tree)


TREES = [
    (None, "the", False), ("title", "th", True), ("not", ("text", "of", False)), (((None, "oak", False), "or", ("text", "été", False)), "and", ("not", (None, "th", True))),
    (("title", "x1", False), "and", ("text", "nothing", False)), ("not", ("not", ("title", "a", False))),
]


def check(index, live):
    for tree in TREES:
        want = sorted(k for k, row in live.items() if holds(row, tree))
        assert sorted(r["key"] for r in index.keys(index.matches(tree)).collect()) == want
        assert index.count(tree).first()["total"] == len(want)


def test_trees_changes_and_merges(spark, tmp_path):
    r = random.Random(1)
    index, live = TermIndex(spark, str(tmp_path / "i"), range_rows=40), {}
    check(index, live)
    first = rows(r, [*range(-70, 200, 3), 10**12, 10**12 + 1])
    index.apply(frame(spark, first).repartition(3), "id", fields())
    live |= {x[0]: x for x in first}
    check(index, live)
    before = {q: os.stat(q).st_mtime_ns for d, _, names in os.walk(tmp_path) for q in [os.path.join(d, p) for p in names]}
    for step in range(5):
        new = rows(r, r.sample(sorted(live), 6) + [1000 + step])
        gone = r.sample(sorted(live), 5)
        index.apply(frame(spark, new), "id", fields(), deleted=spark.createDataFrame([(k,) for k in gone], "id long"))
        for k in gone:
            live.pop(k, None)
        live |= {x[0]: x for x in new}
        if step in (0, 4):
            check(index, live)
    index.apply(None, "id", fields(), deleted=spark.createDataFrame([(min(live),)], "id long"))
    live.pop(min(live))
    check(index, live)
    after = {q: os.stat(q).st_mtime_ns for q in before}
    assert after == before and len(index.segments()) == 7
    assert index.compact() and len(index.segments()) < 7
    check(index, live)
    n = len(index._folders())
    assert index.vacuum() == n - len(index.segments()) > 0
    check(index, live)
    got = {(x["field"], x["token"]): x["n"] for x in index.terms("th").collect()}
    want = {}
    for row in live.values():
        for f, t in (("title", row[1]), ("text", row[2])):
            for w in {w for w in (t or "").lower().split() if w.startswith("th")}:
                want[f, w] = want.get((f, w), 0) + 1
    assert got == want


def test_keyword_queries_equal_a_scan(spark, tmp_path):
    r = random.Random(2)
    table = frame(spark, rows(r, range(150)))
    index = TermIndex(spark, str(tmp_path / "i"))
    index.apply(table, "id", fields())
    for query in ("", "the", "title:oak the", '"of the"', 'text:"the th*"', "th* été", "under_score", "title:nothing"):
        want = sorted(x["id"] for x in search.search(table, query, fields()).collect())
        assert sorted(x["id"] for x in index.search(table, "id", query, fields()).collect()) == want


def test_only_the_ranges_of_the_terms_are_read(spark, tmp_path):
    table = spark.range(2000).select("id", F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("title"), F.lit("same").alias("text"))
    index = TermIndex(spark, str(tmp_path / "i"), range_rows=100)
    index.apply(table, "id", fields())
    whole = spark.read.parquet(str(tmp_path / "i" / "segment-00000000-00000000" / "postings"))
    assert whole.select("part").distinct().count() > 10
    read = index._postings(index.segments(), [("w00042", False), ("w0012", True)])
    assert len({f.split("/part=")[1].split("/")[0] for f in read.inputFiles()}) > 10  # before pruning
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan)
    parts = read.select(F.input_file_name().alias("f")).distinct().count()
    assert parts <= 3 and read.count() == 11


def test_an_unfinished_segment_does_not_count(spark, tmp_path):
    table = frame(spark, [(1, "the", None)])
    index = TermIndex(spark, str(tmp_path / "i"))
    index.apply(table, "id", fields())
    half = index.apply(frame(spark, [(2, "the", None)]), "id", fields())
    os.remove(os.path.join(half.path.removeprefix("file:"), "ranges", "_SUCCESS"))
    assert [x["key"] for x in index.keys(index.matches((None, "the", False))).collect()] == [1]
    index.apply(frame(spark, [(3, "the", None)]), "id", fields())  # takes its place
    assert sorted(x["key"] for x in index.keys(index.matches((None, "the", False))).collect()) == [1, 3]


def test_size_classes():
    assert [termindex._size_class(n) for n in (0, 3, 4, 15, 16, 64)] == [0, 0, 1, 1, 2, 3]
    assert termindex._last_run([2, 1, 1, 1, 1]) == 4 and termindex._last_run([1, 1, 1, 2]) == 0


def test_ranges_are_bounded_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(termindex, "RANGES", 5)
    df = spark.createDataFrame([(k, f"w{k:05d}", None) for k in range(1000)], "id long, title string, text string")
    index = TermIndex(spark, str(tmp_path / "i"), range_rows=10)
    index.apply(df, "id", fields())
    assert index._ranges(index.segments()).count() <= 6  # 102 of ten rows
    assert [r["key"] for r in index.keys(index.matches(("title", "w00042", False))).collect()] == [42]


def test_words_are_grouped_where_the_texts_are(spark):
    """Only texts are dealt between tasks, not their words."""
    df = spark.createDataFrame([(k, "the title", f"the text {k} the") for k in range(300)], "id long, title string, text string")
    words = termindex._words(df, "id", fields())
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert words.where("token = 'the'").agg(F.sum(F.bit_count("bits"))).first()[0] == 600
