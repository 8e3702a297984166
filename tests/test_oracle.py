"""Every registered query against its SQL on DuckDB, over whole tables."""

import duckdb
import pytest

from larkspur.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return c


def plain(rows):
    return sorted(([float(x) if type(x).__name__ in ("Decimal", "int") else x for x in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got.select(*columns).collect()) == plain([[r[want.columns.index(c)] for c in columns] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
