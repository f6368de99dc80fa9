"""Every registered query that SQL can express, against DuckDB on the smallest data.

The stream queries have their own tests and are compared on larger data by the driver.
"""

import duckdb
import pytest

from certloom.plans import catalog, derived

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLES if not n.startswith("h")))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    expected = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted_rows(got.columns, got.collect())
    assert rows == sorted_rows(columns, expected.fetchall())
    assert rows


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == derived.certs(spark, SF).selectExpr("seen_at div 3600").distinct().count()
    assert set(contract.queries()) >= set(contract.oracle_sql()) >= set(catalog.ORACLES)
