"""The registered queries that SQL can express, against DuckDB, and the others' shape."""

import os

import duckdb
import pytest

from timedtext.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(want)


def test_each_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))
