"""Queries that make much of each row of a small file deal these rows over all cores."""

import pytest

import __spark_entry__
from folioflow.plans.tables import spread, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bibtex_whole_records", "ris_whole_records", "format_of_marked_texts", "legacy_format", "site_records", "citations_wrapped"])
def test_rows_of_a_small_file_are_many_tasks(spark, name):
    assert table(spark, SF, "part").rdd.getNumPartitions() == 1
    assert __spark_entry__.queries()[name](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_spread_keeps_all_rows(spark):
    rows = spark.range(1000).coalesce(1)
    dealt = spread(rows)
    assert dealt.rdd.glom().map(len).filter(lambda n: n > 0).count() >= spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in dealt.collect()) == list(range(1000))
