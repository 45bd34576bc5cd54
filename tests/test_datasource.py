"""Citation files by Spark's own reader, stream reader and writer."""

import contextlib
import io
import os
import time

import pytest
from pyspark.sql import functions as F

from folioflow.sinks.writers import export_text
from folioflow.sources import datasource, readers
from folioflow.sources.records import FIELDS

ROWS = "pubtype string, citekey string, title string, authors string, journal string, year string, month string, pages string, keywords string, doi string"


@pytest.fixture()
def records(spark):
    readers.register_formats(spark)
    made = [(["ARTICLE", "BOOK", None][k % 3], f"k{k}", f"Title {k} é", f"Roe, J{k} and Doe, A", "J Things" if k % 2 else None, str(1990 + k % 20), "03" if k % 4 else None, f"{k}-{k + 9}", "a; b", f"10.1000/x{k}") for k in range(60)]
    return spark.createDataFrame(made, ROWS).repartition(4)


def visible(path):
    return sorted(n for n in os.listdir(path) if not n.startswith(("_", ".")))


def test_write_and_read_again(spark, records, tmp_path):
    for kind in ("bibtex", "ris"):
        out = str(tmp_path / kind)
        records.write.format(kind).mode("append").save(out)
        assert len(visible(out)) == 4 and "_SUCCESS" in os.listdir(out) and not any(n.startswith("_writing") for n in os.listdir(out))
        text = sorted(x for n in visible(out) for x in open(os.path.join(out, n), encoding="utf-8").read().split("\n\n") if x.strip())
        want = sorted(r["text"].rstrip("\n") for r in export_text(records, kind).collect())
        assert [t.rstrip("\n") for t in text] == want
        got = spark.read.format(kind).load(out)
        assert got.count() == 60 and {r["title"] for r in got.collect()} == {f"Title {k} é" for k in range(60)}
        records.limit(5).write.format(kind).mode("append").save(out)
        assert spark.read.format(kind).load(out).count() == 65
        records.limit(7).write.format(kind).mode("overwrite").save(out)
        assert spark.read.format(kind).load(out).count() == 7


def test_a_failed_task_leaves_nothing(spark, records, tmp_path):
    out = str(tmp_path / "out")
    records.limit(3).write.format("bibtex").mode("append").save(out)
    before = visible(out)
    bad = records.withColumn("title", F.when(F.col("citekey") == "k40", F.raise_error(F.lit("broken"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("bibtex").mode("append").save(out)
    assert visible(out) == before and not any(n.startswith("_writing") for n in os.listdir(out))
    with pytest.raises(Exception, match="no fields"):
        records.withColumn("colour", F.lit("red")).write.format("bibtex").mode("append").save(out)


def test_filters_are_pushed(spark, records, tmp_path):
    out = str(tmp_path / "out")
    records.write.format("bibtex").mode("append").save(out)
    found = spark.read.format("bibtex").load(out).where("citekey = 'k7' and title like 'Title%'")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        found.explain("formatted")
    assert [r["citekey"] for r in found.collect()] == ["k7"]
    assert spark.read.format("bibtex").load(out).where(F.col("citekey").isin("k1", "k2", "none")).count() == 2
    tested = [x for x in text.getvalue().splitlines() if "Condition" in x]
    assert tested and not any("k7" in x for x in tested)  # Spark leaves the test to the source


def test_pushed_filters_are_those_that_the_source_can_test():
    from pyspark.sql.datasource import EqualTo, IsNotNull

    reader = datasource.Reader("x", None)
    rest = list(reader.pushFilters([EqualTo(("citekey",), "k"), IsNotNull(("citekey",)), EqualTo(("position",), 3)]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"] and reader.tests == (("citekey", frozenset(["k"])),)


def test_stream_of_files(spark, records, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.bib").write_text("@misc{one, title={One}}\n@misc{two, title={Two}}", encoding="utf-8")

    def run():
        q = spark.readStream.format("bibtex").load(str(folder)).select("citekey").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        assert q.awaitTermination(120)
        return sorted(r["citekey"] for r in spark.read.parquet(out).collect())

    assert run() == ["one", "two"]
    time.sleep(0.02)
    (folder / "b.bib").write_text("@misc{three, title={Three}}", encoding="utf-8")
    assert run() == ["one", "three", "two"]


def test_texts_equal_the_column_expressions(spark, records):
    rows = [r.asDict() for r in records.collect()]
    assert all(set(r) <= set(FIELDS) for r in rows)
    for kind, text in (("bibtex", datasource.bibtex_text), ("ris", datasource.ris_text)):
        assert sorted(map(text, rows)) == sorted(r["text"] for r in export_text(records, kind).collect())
