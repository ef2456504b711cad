"""Registered queries on the smallest tables, next to their SQL texts."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import TABLES, canonical_rows

SF = "/root/testdata/sf0.001"
ORACLES = entry_module.oracle_sql()
QUERIES = entry_module.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    want = canonical_rows([d[0] for d in cur.description], cur.fetchall())
    assert canonical_rows(df.columns, df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "label" in df.columns
