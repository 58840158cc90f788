"""Every query against its SQL, and every other query for a non-empty result."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert compare(df, db, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    totals = [r for r in rows if r["stage"] is None]
    assert len(totals) == 1 and totals[0]["total"] == sum(r["total"] for r in rows if r["stage"] is not None)
