"""Every registered query against its SQL in another engine."""

import math

import duckdb
import pytest
from conftest import SMALL

from tallyframe import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    found = plans.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    a = sorted(tuple(map(shown, row)) for row in found.select(*[f"`{c}`" for c in columns]).collect())
    assert a == sorted(tuple(shown(row[i]) for i in at) for row in expected.fetchall())


def test_every_query_has_an_oracle():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)
