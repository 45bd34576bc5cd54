"""The tasks that write a stored index, and the parts of its buckets, grow in number with the texts."""

from pyspark.sql import functions as F

from folioflow.operators import search


def test_parts_grow_with_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SALT_CHARS", 500)
    monkeypatch.setattr(search, "TASK_CHARS", 200)
    df = spark.createDataFrame([(k, None if k % 50 == 7 else f"the words of row {k % 10}") for k in range(1000)], "id long, text string")
    index = search.StoredIndex.write(df, "id", {"text": F.col("text")}, str(tmp_path / "index"), 1)
    assert len(index.table.inputFiles()) > 2 * search.SALTS
    got = {r["id"] for r in search.index_search(index, "id", '"row 3" the').collect()}
    assert got == {k for k in range(1000) if k % 10 == 3}


def test_no_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "a word")], "id long, text string")
    index = search.StoredIndex.write(df, "id", {"text": F.col("text"), "more": F.lit(None).cast("string")}, str(tmp_path / "index"), 4)
    assert [r["id"] for r in search.index_search(index, "id", "word").collect()] == [2]
