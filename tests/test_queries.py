"""Every query with SQL against another engine, at the smallest size."""

import glob
import os

import duckdb
import pytest

from lexmill.plans import registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf).toArrow().to_pandas()
    want = db.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    order = lambda d: d[names].astype(str).sort_values(names).reset_index(drop=True)
    assert order(got).equals(order(want))


def test_entry_has_rows_and_registry_agrees(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
