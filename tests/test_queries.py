"""Every registered query against its SQL twin at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, plain
from workloads import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    result = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(columns) == order
    assert rows == expected
