"""Oracles must have rows to compare: an empty answer on both sides shows nothing."""

import os

import duckdb
import pytest

from larkspur.plans.queries import ORACLES

SF = os.environ.get("LARKSPUR_TEST_DATA", "/root/testdata/sf0.01")
TABLES = "customer supplier part orders documents conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data on this machine")
def test_oracles_have_rows():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    empty = [name for name, sql in ORACLES.items() if not con.execute(f"select count(*) from ({sql})").fetchone()[0]]
    assert empty == []
