"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillmesh.plans.oracles import ORACLE_SQL
from quillmesh.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(names, records):
    def cell(v):
        return "null" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[n]) for n in names) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == names
    expected = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, expected)


@pytest.mark.parametrize("name", ["q_sessions_of_documents", "q_textpack_roundtrip"])
def test_others_run(spark, name):
    got = QUERIES[name](spark, FOLDER).collect()
    assert got
    if name == "q_textpack_roundtrip":
        assert got[0]["failures"] == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
