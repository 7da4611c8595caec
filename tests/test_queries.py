"""The registered queries: same rows as their SQL, and plans without cross joins."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, _rows

SF = "/root/testdata/sf0.001"
# One query over all rules stands for the queries of single rules.
NAMES = [name for name in contract.queries() if not name.startswith("rule_")] + ["rule_sec001"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    frame = contract.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = _rows(frame.columns, frame.collect())
    if name not in contract.oracle_sql():
        assert rows
        return
    expected = con.sql(contract.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    assert rows == _rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
