"""Each query with an oracle has the oracle's rows on the smallest data; the others give rows."""

import os

import duckdb
import pytest

from larkspur.plans.queries import ORACLES, QUERIES

SF = os.environ.get("LARKSPUR_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data on this machine")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.6f}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.columns and got.count() > 0
        return
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in (x.asDict() for x in got.collect()))
    expected = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in want.fetchall())
    assert rows == expected
