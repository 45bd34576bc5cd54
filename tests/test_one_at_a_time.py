"""Files of many records are parsed one record at a time."""

import tracemalloc

import pytest

from folioflow.sources import bibtex, readers, ris

BIB = "".join(f"@article{{k{k},\n  title = {{Title {k}}},\n  year = {{1999}}\n}}\n" for k in range(4500))
RIS = "".join(f"TY  - JOUR\nTI  - Title {k}\nPY  - 1999///\nER  - \n\n" for k in range(4500))


@pytest.mark.parametrize(("records", "text"), [(bibtex.bibtex_records, BIB), (ris.ris_records, RIS)])
def test_records_are_not_held(records, text):
    tracemalloc.start()
    try:
        assert sum(1 for _ in records(text)) == 4500
        assert tracemalloc.get_traced_memory()[1] < 2 * len(text)
    finally:
        tracemalloc.stop()


def test_all_records_of_one_file_in_order(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    (tmp_path / "b.ris").write_text(RIS)
    for got in (readers.read_bibtex_files(spark, str(tmp_path / "a.bib")), readers.read_ris_files(spark, str(tmp_path / "b.ris"))):
        assert sorted((r["position"], r["title"]) for r in got.collect()) == [(k, f"Title {k}") for k in range(4500)]


def test_ris_without_ends():
    text = "ER  - \nTI  - lost\nTY  - JOUR\nTI  - a\n  more\nTY  - BOOK\nTI  - b\nER  - \nTI  - lost\r\nTY  - CHAP\rTI  - c"
    assert [(t["TY"], t["TI"]) for t in ris.parse_tags(text)] == [(["JOUR"], ["amore"]), (["BOOK"], ["b"]), (["CHAP"], ["c"])]
