"""Sources as plugins, and structured values."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import structured
from folioflow.operators.matching import match_by_priority
from folioflow.sources import lifecycle
from folioflow.sources.records import FileFormatError, FolioError

BIB = "@article{a, title={One}, author={Roe, J}}\n@article{b, title={Two}}\n@article{c, title={One}, author={Roe, J}}\n"


def test_file_source(spark, tmp_path):
    (tmp_path / "x.bib").write_text(BIB)
    s = lifecycle.plugin("source", "FILE")(spark, str(tmp_path / "x.bib"), limit=1)
    assert s.connect() == 2
    assert [r["title"] for r in s.page(0).collect()] == ["One"] and [r["title"] for r in s.page(1, 5).collect()] == ["Two"] and s.page(7).count() == 0
    assert {r["citekey"] for r in s.all().collect()} == {""} and s.find_guid(s.all().first()["guid"]).count() == 1
    assert s.table_name().endswith("x_bib")
    kept = s.kept_page(0, 2)
    assert kept.is_cached and s.kept_page(0, 2) is kept and kept.count() == 2
    s.cleanup()
    (tmp_path / "y.txt").write_text("plain")
    with pytest.raises(FileFormatError):
        lifecycle.FileSource(spark, str(tmp_path / "y.txt")).connect()
    with pytest.raises(FolioError):
        lifecycle.plugin("source", "none")


def test_feed_and_provider(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<rss><channel><title>F</title><item><title>T</title><link>http://x.org/1</link></item><item><title>T</title><link>http://x.org/2</link></item></channel></rss>')
    s = lifecycle.FeedSource(spark, str(tmp_path / "f.xml"))
    assert s.connect() == 1 and s.reload() == 1
    assert s.records.where(s.needs_completing()).count() == 1 and s.complete_details(s.records).where(s.needs_completing()).count() == 0
    answers = spark.createDataFrame([("g1", "10.1/a", None, None, "Alpha"), ("g2", None, None, None, "Strategies for measuring")], "guid string, doi string, pmid string, arxivid string, title string")
    p = lifecycle.ProviderSource(spark, "GoogleScholar", answers, {"title": F.col("title")}, query="alpha")
    assert p.limit == 10 and p.connect() == 1
    records = spark.createDataFrame([("r1", "10.1/A", None, None, "x"), ("r2", None, None, None, "Strategies for measurin"), ("r3", None, None, None, "Other")], answers.schema)
    got = {r["id"]: (r["guid"], r["by"]) for r in match_by_priority(records.withColumnRenamed("guid", "id"), answers, "id").collect()}
    assert got == {"r1": ("g1", "doi"), "r2": ("g2", "title")}


def test_url_match(spark):
    records = spark.createDataFrame([("g", "http://x.org/1", "", "k"), ("h", None, "T", "k")], "guid string, linkout string, title string, citekey string")
    pages = spark.createDataFrame([("http://x.org/1", '<meta name="citation_title" content="Found">')], "url string, html string")
    assert {r["guid"]: (r["title"], r["citekey"]) for r in lifecycle.url_match(records, pages).collect()} == {"g": ("Found", "k"), "h": ("T", "k")}


def test_structured(spark):
    assert lifecycle.typed_enough("") and lifecycle.typed_enough("abc") and not lifecycle.typed_enough("a b")
    row = spark.range(1).select(structured.tex_to_html(F.lit(r"\emph{a} \textbf{b}")).alias("t"), structured.thawed(F.lit("plain")).isNull().alias("n"), structured.filled_map(F.create_map(F.lit("k"), F.lit("__X__/y")), {"X": "z"}).alias("m")).first()
    assert row["t"] == "<i>a</i> <b>b</b>" and row["n"] and row["m"] == {"k": "z/y"}
