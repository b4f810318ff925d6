"""The queries that SQL can express, against it."""

import duckdb
import pytest
from conftest import SMALL

from tallyframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found, expected = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    shown = lambda v: repr(round(v, 7)) if isinstance(v, float) else str(v)
    assert sorted(tuple(map(shown, r)) for r in found.select(columns).collect()) == sorted(tuple(shown(r[i]) for i in at) for r in expected.fetchall())
