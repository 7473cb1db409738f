"""Every query against its DuckDB counterpart on the smallest tables."""

import os

import duckdb
import pytest

from timedtext.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(x):
    if isinstance(x, float):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    want = sorted(tuple(map(plain, r)) for r in duck.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    compare(spark, duck, registry.queries()[name], registry.oracle_sql()[name])


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
