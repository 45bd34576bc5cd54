"""Words are dealt by documents to as many tasks as their number asks for."""

from folioflow.operators import layouts


def test_words_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(layouts, "TASK_WORDS", 100)
    rows = [(f"d{d}", p, f"w{k}", 10.0 + 40 * k, 30.0 + 40 * k, 100.0 * p + d % 3, 9.0) for d in range(200) for p in range(2) for k in range(3)]
    words = spark.createDataFrame(rows, "doc string, page int, word string, xmin double, xmax double, ymin double, size double")
    read = layouts.reading_order(words)
    assert read.rdd.getNumPartitions() == 12
    lines = layouts.words_to_lines(read, by=("block",))
    assert lines.rdd.getNumPartitions() == 12  # not dealt again
    plain = layouts.words_to_lines(words)
    assert plain.rdd.getNumPartitions() == 12
    assert sorted((r["doc"], r["page"], r["content"]) for r in plain.collect()) == sorted((f"d{d}", p, "w0 w1 w2") for d in range(200) for p in range(2))
