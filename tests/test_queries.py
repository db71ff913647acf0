import math

import duckdb
import pytest

import __spark_entry__ as contract
from gridwell.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "part", "supplier", "customer", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(found):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got.select(columns).collect()) == rows(want.select(*columns).fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() == 500
    assert set(contract.oracle_sql()) <= set(contract.queries())
