"""Kept lists, counts by deltas and numbers within keys against plain ways."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import matching
from folioflow.operators.counters import Counters, changed_rows
from folioflow.operators.pages import SortedList


def test_pages_equal_offset_and_limit(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, r.randrange(30), "clash", 5) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, v long, part string, place int").repartition(4)
    kept = SortedList.write(df, [F.col("v").desc(), F.col("id")], str(tmp_path / "l"), range_rows=60)
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert kept.total() == 500 and kept.pages(40).first()["pages"] == 13
    for offset, limit in ((0, 10), (55, 20), (470, 40), (0, 500), (500, 10), (900, 1), (3, 0)):
        assert [tuple(x) for x in kept.page(offset, limit).collect()] == want[offset : offset + limit]
    page = kept.page(470, 20)
    assert page.select(F.input_file_name()).distinct().count() <= 2 and "part" in page._jdf.queryExecution().executedPlan().toString()


def test_an_empty_list(spark, tmp_path):
    kept = SortedList.write(spark.range(0), [F.col("id")], str(tmp_path / "l"))
    assert kept.total() == 0 and kept.page(0, 5).count() == 0


def test_counts_by_deltas(spark, tmp_path):
    r = random.Random(2)
    table = {k: (k, r.choice("abc"), r.choice([None, "x", "y"]), r.randrange(50)) for k in range(80)}
    frame = lambda t: spark.createDataFrame(sorted(t.values()), "guid long, a string, b string, v long")
    kept = Counters(spark, str(tmp_path / "c"), {"a": F.col("a"), "ab": F.array("a", "b"), "items": F.lit("all"), "v": F.col("v")})
    assert kept.counts("a").count() == 0
    kept.apply(added=frame(table))
    for step in range(4):
        new = dict(table)
        for k in r.sample(sorted(new), 6):
            new.pop(k)
        for k in r.sample(sorted(new), 5):
            new[k] = (k, r.choice("abd"), None, 99 if step == 1 else r.randrange(50))
        gone, came = changed_rows(frame(table), frame(new))
        written = kept.apply(gone, came)
        assert 0 < written < 60
        table = new
        if step == 2:
            kept.compact()
    counts = {}
    for _, a, b, _ in table.values():
        for g in (a, b):
            if g is not None:
                counts[g] = counts.get(g, 0) + 1
    assert {x["grp"]: x["n"] for x in kept.counts("ab").collect()} == counts
    got = kept.dashboard(n=kept.total("items"), top=kept.largest("v", "long")).first()
    assert (got["n"], got["top"]) == (len(table), max(x[3] for x in table.values()))
    assert kept.apply(frame(table), frame(table)) == 0


def plain_letters(n):
    out = ""
    while n > 0:
        n, d = divmod(n - 1, 26)
        out = chr(97 + d) + out
    return out


def test_letters(spark):
    numbers = [-3, 0, 1, 2, 26, 27, 52, 53, 701, 702, 703, 18278, 18279, 475254, 475255, 10**9, 10**15, 26**12]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", matching.letters(F.col("n")).alias("t")).collect()
    assert {x["n"]: x["t"] for x in got} == {n: plain_letters(n) for n in numbers}


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_numbers_within_a_hot_key(spark, partitions):
    r = random.Random(3)
    rows = [(k, r.choice(["hot"] * 8 + ["b", "c", None]), r.randrange(40)) for k in range(600)]
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", partitions)
    df = own.createDataFrame(rows, "id long, base string, at long")
    got = {x["id"]: x["_n"] for x in matching.numbered_within(df, "base", [F.col("at"), F.col("id")], "_n").collect()}
    want = {}
    for b in ("hot", "b", "c", None):
        want |= {k: n for n, (_, k) in enumerate(sorted((at, k) for k, base, at in rows if base == b))}
    assert got == want
    keys = [x["citekey"] for x in matching.citekeys(df.where("base is not null"), "base", [F.col("at"), F.col("id")]).collect()]
    assert len(set(keys)) == len(keys) and "hot" in keys and "hota" in keys
