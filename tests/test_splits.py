"""Citation files in byte ranges against the whole-file readers."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.sources import bibtex, ris, splits
from folioflow.sources.records import FIELDS

HARD = r"""junk before, with a { bracket
@string{jone = "Journal One"}
@STRING( jtwo = jone # " and Two" )
@article{a1, title = {A {nested} one}, journal = jone, year = 1999}
@article{open, title = {never closed, journal = jtwo
@article{a2, title = "quoted {br}ace", journal = jtwo # {, B}, month = nov}
text between @book{mid, title = {in mid line}, publisher = jthree} more @misc{mid2, title={x}}
@comment{ @article{hidden, title = {no}} }
  @ article (round, title = {Round (brackets) here}, year = {2001})
@string{jone = {New One}}
@string{jthree = jtwo # jone}
@article{a3, title = {escaped \{ and \} here}, journal = jone, note = jthree # undefinedname}
@preamble{"some {text}"}
@article{late_open, title = {unclosed again
with more lines

that go on
"""


def keyed(rows):
    return [{f: r.get(f) for f in FIELDS} for r in rows]


def in_order(df):
    got = sorted(df.collect(), key=lambda r: (r["path"], r["start"], r["n"], r["k"]))
    return [{f: r[f] for f in FIELDS} for r in got]


def bib(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind = r.randrange(12)
        if kind == 0:
            out.append(f"@article{{open{k}, title = {{never {'{' * r.randrange(3)} closed {k},\n  year = 19{r.randrange(10)}{r.randrange(10)}")
        elif kind == 1:
            out.append(f"@string{{m{r.randrange(4)} = " + r.choice([f'"value {k}"', f"m{r.randrange(4)} # {{ x{k}}}"]) + "}")
        elif kind == 2:
            out.append("words " * r.randrange(200) + "\n}}}{" * r.randrange(3))
        elif kind == 3:
            out.append(HARD)
        else:
            out.append(f"@{r.choice(['article', 'Book', 'MISC'])}{{k{k},\n title = {{T {{{k}}} é" + " and more\n words" * r.randrange(40) + f"}},\n journal = m{r.randrange(5)} # \" j\",\n year = {1950 + r.randrange(60)}\n}}")
    return "\n".join(out) + r.choice(["", "\n"])


@pytest.mark.parametrize("size", [150, 4_000, None])
def test_bibtex_ranges_equal_the_whole_file(spark, tmp_path, size):
    texts = {"a": HARD, "b": bib(1, 50), "c": bib(2, 25), "d": "", "e": "no mark at all\n{{\n", "f": "@article{x, title={one line}}"}
    for name, t in texts.items():
        (tmp_path / f"{name}.bib").write_text(t, encoding="utf-8")
    lines = splits.line_ranges(spark, str(tmp_path), size)
    if size == 150:
        assert lines.select("path", "start").distinct().count() > 40 and lines.rdd.getNumPartitions() > 4
    want = [r for name in sorted(texts) for r in keyed(bibtex.read_bibtex(texts[name]))]
    assert in_order(splits.read_bibtex_ranges(spark, str(tmp_path), range_bytes=size)) == want


def test_macros_count_from_their_definition_on(spark, tmp_path):
    (tmp_path / "x.bib").write_text("@misc{a, note = m}\n@string{m = {1}}\n@misc{b, note = m}\n@string{m = m # {2}}\n@misc{c, note = m # mar}\n", encoding="utf-8")
    got = in_order(splits.read_bibtex_ranges(spark, str(tmp_path), range_bytes=20))
    assert [r["note"] or "" for r in got] == ["", "1", "12March"]


@pytest.mark.parametrize("size", [120, None])
def test_ris_ranges_equal_the_whole_file(spark, tmp_path, size):
    r = random.Random(3)
    rows = []
    for k in range(80):
        rows.append(f"TY  - {r.choice(['JOUR', 'CHAP', 'BOOK'])}\nTI  - Title {k} é\n" + "".join(f"AU  - Name{j}, A\n" for j in range(r.randrange(4))) + f"N2  - text\ngoes on{k}\n" * r.randrange(2) + ("ER  - \n" if r.random() < 0.8 else "") + "junk\n" * r.randrange(2))
    text = "before\n" + "\n".join(rows)
    (tmp_path / "x.ris").write_text(text, encoding="utf-8")
    assert in_order(splits.read_ris_ranges(spark, str(tmp_path), range_bytes=size)) == keyed(ris.read_ris(text))


def test_unclosed_entries_take_linear_time():
    text = "".join(f"@article{{k{k}, title = {{never closed\n" for k in range(60_000))
    found = bibtex.parse_entries(text)
    assert len(found) == 60_000 and not any(e["parse_ok"] for e in found)


def test_an_entry_over_many_ranges(spark, tmp_path):
    text = "@misc{a, note = {" + "\n".join(f"line {k}" for k in range(3000)) + "}}\n@misc{b, note = {x}}"
    (tmp_path / "x.bib").write_text(text, encoding="utf-8")
    assert in_order(splits.read_bibtex_ranges(spark, str(tmp_path), range_bytes=500)) == keyed(bibtex.read_bibtex(text))
    assert splits.chunks(spark, splits.line_ranges(spark, str(tmp_path), 500), "BIBTEX").select(F.countDistinct("start", "n")).first()[0] == 2


def test_short_ranges_share_tasks(spark, tmp_path):
    text = bib(5, 400)
    (tmp_path / "x.bib").write_text(text, encoding="utf-8")
    lines = splits.line_ranges(spark, str(tmp_path), 200)
    assert lines.select("start").distinct().count() > 100 and lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert in_order(splits.read_bibtex_ranges(spark, str(tmp_path), range_bytes=200)) == keyed(bibtex.read_bibtex(text))
