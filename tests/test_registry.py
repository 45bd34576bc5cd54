"""Every registered query of the record part: it runs, its SQL agrees, and its plan has no all-pairs join."""

import contextlib
import io
import os

import pytest

from folioflow.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(table):
    row = lambda r: [round(v, 6) if isinstance(v, float) else v for _, v in sorted(r.items())]
    return sorted(repr(row(r)) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    assert "CartesianProduct" not in text.getvalue() and "BroadcastNestedLoopJoin" not in text.getvalue()
    got = df.toArrow()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
        assert set(got.schema.names) == set(want.schema.names)
        assert plain(got) == plain(want)
