"""Readers and writers on small files."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from folioflow.sinks import writers
from folioflow.sources import bibtex, detect, readers, records, ris

BIB = r"""@string{mill = "Paper Mill, Linz"}
@comment{not an entry}
@ARTICLE{one,
  author = {M. K. Huber and L. Gruber},
  title = {Counting pebbles on a beach: a
           field guide},
  journal = {J. Idle Pursuits}, volume = {12}, number = {3}, pages = {40--52},
  month = nov, year = {1993}, PMID = {1234567}, ArXiv = {arXiv:1001.0001},
}
@article{two, doi = {http://dx.doi.org/10.1234/abc.56}, year = "07-JUL-2004", title = "Said {"}the {owl"} Once", comment = {read me}, publisher = mill # " and " # {sons}}
@misc{bad, title = {open
@misc{three, DOI = "DOI:  10.1234/abc.56", title = "Nested {curly {marks} of {all}} \textbf{kinds}", author = {Mayr, KL and {for the Pebble Group}}, editor = "Rose O'Dea"}
"""
RIS = """TY  - JOUR
A1  - Huber, Maria K.
A1  - Gruber, Leo
T1  - Pebbles by
night
Y1  - 2008/06/05/print
JO  - J. Idle Pursuits
VL  - 27
IS  - S2
SP  - 101
EP  - 109
SN  - 1111-2222
KW  - pebble
KW  - dark
M3  - 10.1234/jip.2008.27
N1  - 10.1234/jip.2008.27
ER  - 

TY  - CHAP
T1  - Sand
A1  - Mayr,K.L.
A2  - Leitner,P.Q.
T2  - Shores
SN  - 9781234567897
Y1  - 1998///
ER  -
"""


def test_bibtex():
    got = bibtex.read_bibtex(BIB)
    assert [g["citekey"] for g in got] == ["one", "two", "three"]
    a, b, c = got
    assert a["authors"] == "Huber, M. K. and Gruber, L." and a["title"].endswith("beach: a field guide")
    assert (a["pages"], a["month"], a["year"], a["pmid"], a["arxivid"], a["pubtype"]) == ("40-52", "November", "1993", "1234567", "1001.0001", "ARTICLE")
    assert (b["doi"], b["year"], b["title"], b["annote"]) == ("10.1234/abc.56", "2004", 'Said "the owl" Once', "read me")
    assert b["publisher"] == "Paper Mill, Linz and sons"
    assert c["title"] == "Nested curly marks of all kinds" and c["authors"] == "Mayr, KL and {for the Pebble Group}" and c["editors"] == "O'Dea, Rose"
    assert bibtex.read_bibtex(BIB, strip=False)[2]["title"] == r"Nested curly marks of all \textbfkinds"
    bad = [e for e in bibtex.parse_entries(BIB) if not e["parse_ok"]]
    assert len(bad) == 1 and bad[0]["_key"] == "bad"


@pytest.mark.parametrize(("source", "value"), [("42", "42"), ('"in quotes"', "in quotes"), ('"a { closed } pair"', "a { closed } pair"), ('"left " # "right"', "left right"), ("mac", "one"), ("mac # roe", "onetwo"), (r'"Z{\"{u}}rich"', r'Z{\"{u}}rich')])
def test_bibtex_values(source, value):
    assert bibtex.parse_value(source, 0, {"mac": "one", "roe": "two"})[0] == value


def test_tex_letters():
    assert bibtex.decode_tex(r'M{\"{u}}ller, \"Osten, na{\"\i}ve, \ss, Stra{\ss}e, \c{c}, \v{s}, \~n') == "Müller, Östen, naïve, ß, Straße, ç, š, ñ"
    assert bibtex.decode_tex(r'\uchar"E9') == "é"


def test_balanced_entry():
    assert bibtex.balanced_entry("<p>x @article{k, title={a {b}}} y</p>") == "@article{k, title={a {b}}}"
    assert bibtex.balanced_entry("<p>nothing</p>") is None


def test_ris():
    a, b = ris.read_ris(RIS)
    assert a["title"] == "Pebbles bynight" and a["authors"] == "Huber, Maria K. and Gruber, Leo"
    assert (a["year"], a["month"], a["day"], a["pages"], a["issn"], a["keywords"], a["doi"], a["pubtype"]) == ("2008", "06", "05", "101-109", "1111-2222", "pebble;dark", "10.1234/jip.2008.27", "ARTICLE")
    assert "note" not in a
    assert (b["pubtype"], b["title"], b["booktitle"], b["editors"], b["isbn"], b["year"]) == ("INBOOK", "Sand - Shores", "Shores", "Leitner,P.Q.", "9781234567897", "1998")
    assert "month" not in b
    assert ris.read_ris_bytes("TY  - JOUR\nTI  - é\nER  -".encode("latin-1"))[0]["title"] == ris.read_ris_bytes("TY  - JOUR\nTI  - é\nER  -".encode())[0]["title"] == "é"
    assert ris.read_ris("") == []


def test_files(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    (tmp_path / "b.ris").write_bytes(RIS.replace("night", "nïght").encode("latin-1"))
    (tmp_path / "c.txt").write_text("nothing\n\nhere")
    (tmp_path / "d.xml").write_text('<?xml version="1.0"?>\n<rss version="2.0"><channel><title>Feed</title><item><title>T1</title><link>u1</link></item><item><title>T2</title><link>u2</link></item></channel></rss>')
    kinds = readers.text_files(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("n"), detect.text_format(F.col("content")).alias("f"), detect.legacy_format(F.col("content")).alias("l"))
    assert {r["n"]: (r["f"], r["l"]) for r in kinds.collect()} == {"a.bib": ("BIBTEX", "BIBTEX"), "b.ris": ("RIS", "RIS"), "c.txt": (None, None), "d.xml": ("RSS", None)}
    assert readers.read_bibtex_files(spark, str(tmp_path / "a.bib")).count() == 3
    assert {r["title"] for r in readers.read_ris_files(spark, str(tmp_path / "b.ris")).collect()} >= {"Pebbles bynïght"}
    assert [tuple(r) for r in readers.read_feed(spark, str(tmp_path / "d.xml")).select("feed", "title", "linkout", "needs_details").collect()] == [("Feed", "T1", "u1", True), ("Feed", "T2", "u2", True)]
    readers.register_formats(spark)
    assert spark.read.format("bibtex").load(str(tmp_path / "a.bib")).where("citekey = 'one'").count() == 1
    assert spark.read.format("ris").load(str(tmp_path / "*.ris")).count() == 2


def test_library_files(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.sqlite")
    db.execute("create table zoteroDummyTable (a)")
    db.commit()
    names = [r[0] for r in db.execute("select name from sqlite_master")]
    db.close()
    head = readers.binary_files(spark, str(tmp_path / "x.sqlite")).select(detect.is_sqlite(F.col("content")).alias("y")).first()
    assert head["y"]
    t = spark.createDataFrame([("x", n) for n in names] + [("y", "Fulltext"), ("y", "Publications"), ("y", "zoteroDummyTable")], "path string, name string")
    assert {r["path"]: r["format"] for r in detect.library_format(t).collect()} == {"x": "ZOTERO", "y": None}


def test_other_programs(spark):
    items = spark.createDataFrame([("i1", "T"), ("i2", "U")], "id string, title string")
    folders = spark.createDataFrame([("c1", None, "A"), ("c2", "c1", "B")], "guid string, parent string, name string")
    inside = spark.createDataFrame([("c2", "i1"), ("c1", "i1")], "collection string, item string")
    got = {r["id"]: r["folders_tmp"] for r in readers.zotero_records(items, folders, inside).collect()}
    assert got == {"i1": "A,A/B", "i2": None}
    unknown = spark.createDataFrame([("i1", "k", "v")], "id string, key string, value string")
    tags = spark.createDataFrame([("i1", "y"), ("i1", "x")], "id string, tag string")
    row = readers.mendeley_records(items, unknown, tags).where("id = 'i1'").first()
    assert row["note"] == 'Mendeley field "k": v<br />' and row["labels"] == "x,y"


def test_import(spark):
    r = spark.createDataFrame([("f", 0, "k", "A", "T", None), ("f", 1, "l", "A", "T", None), ("f", 2, "m", "B", "T", "G")], "path string, position int, citekey string, authors string, title string, guid string")
    got = readers.import_records(r).orderBy("position").collect()
    assert [(x["citekey"], x["position"]) for x in got] == [("", 0), ("", 2)] and got[1]["guid"] == "G" and len(got[0]["guid"]) == 32


def test_directories(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for n in ("z.pdf", "A.PDF", ".hidden", "t.txt"):
        (tmp_path / n).write_text("x")
    assert [f["name"] for f in readers.list_directory(spark, str(tmp_path))] == ["b", "A.PDF", "t.txt", "z.pdf"]
    assert [f["name"] for f in readers.list_directory(spark, str(tmp_path), ("pdf",), mode="FILE")] == ["A.PDF", "z.pdf"]
    assert readers.file_stat(spark, str(tmp_path / "b"))["dir"] and not readers.file_stat(spark, str(tmp_path / "no"))["exists"]
    with pytest.raises(records.FileReadError):
        readers.list_directory(spark, str(tmp_path / "no"))


def test_find_pdfs(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for n in ("z.pdf", "s/A.PDF", "t.txt"):
        (tmp_path / n).write_text("x")
    assert readers.find_pdfs(spark, str(tmp_path)).count() == 2


RECORD = [("ARTICLE", "testkey", "Test title", "Smith, D", "Nature", "100", "100")]
FIELDS = "pubtype string, citekey string, title string, authors string, journal string, volume string, issue string"
ENTRY = "@ARTICLE{testkey,\n  title    = {Test title},\n  author   = {Smith, D},\n  journal  = {Nature},\n  volume   = {100},\n  issue    = {100}\n}\n"


def test_writers(spark):
    df = spark.createDataFrame(RECORD, FIELDS)
    assert df.select(writers.bibtex_entry(df).alias("t")).first()["t"] == ENTRY
    assert df.select(writers.bibtex_entry(df, use_quotes=True).alias("t")).first()["t"] == ENTRY.replace(" {", ' "').replace("},", '",').replace("100}\n", '100"\n')
    assert writers.export_text(df, "CITATIONS").first()["text"] == "Test title\nSmith, D\nNature 100(100)"
    assert writers.export_text(df, "Email").first()["text"] == "Test title%0ASmith, D%0ANature 100(100)"
    assert writers.citekey_list(df, cite=True).first()["text"] == "\\cite{testkey}" and writers.citekey_list(df.limit(0)).first()["text"] == ""
    back = ris.read_ris(writers.export_text(df, "ris").first()["text"])[0]
    assert (back["title"], back["authors"], back["volume"], back["pubtype"]) == ("Test title", "Smith, D", "100", "ARTICLE")
    with pytest.raises(records.FileFormatError):
        writers.export_text(df, "doc")
    long = spark.createDataFrame([("word " * 30,)], "t string").select(writers.wrapped("t").alias("t")).first()["t"]
    assert max(map(len, long.split("\n"))) <= 70


def test_export_library(spark, tmp_path):
    df = spark.createDataFrame([("g", "x.pdf")], "guid string, pdf string")
    writers.export_library(df, str(tmp_path / "lib"))
    back = readers.read_library(spark, str(tmp_path / "lib")).first()
    assert back["pdf"] is None and back["citekey"] == ""
    assert writers.write_string([{"citekey": "k", "pubtype": "MISC", "title": "T"}], "citekey string, pubtype string, title string", "bibtex", spark).startswith("@MISC{k,")
    assert set(records.with_fields(df).columns) >= set(records.FIELDS)


def test_files_are_made_by_tasks_and_listed_by_name(spark, tmp_path):
    from folioflow.plans.source_queries import _touched

    names = ["a, b.pdf", "a)", "Array(x.pdf", ".hid.pdf", "deep/er/c.PDF", "deep/d.txt", "z, file:.pdf"]
    _touched(spark.createDataFrame([(n,) for n in names], "f string").repartition(3), f"file://{tmp_path}/in")
    assert {str(p.relative_to(tmp_path / "in")) for p in (tmp_path / "in").rglob("*") if p.is_file()} == set(names)
    found = readers.list_directory(spark, f"{tmp_path}/in", ("pdf",))
    assert [(f["name"], f["type"]) for f in found] == [("deep", "DIR"), ("Array(x.pdf", "FILE"), ("a, b.pdf", "FILE"), ("z, file:.pdf", "FILE")]
    assert found[0]["path"] == f"file:{tmp_path}/in/deep"
    (tmp_path / "none").mkdir()
    assert readers.list_directory(spark, str(tmp_path / "none")) == []
