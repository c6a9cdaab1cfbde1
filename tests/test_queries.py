"""Every registered query with SQL agrees with DuckDB over the smallest tables."""

import decimal
import math

import duckdb
import pytest

from strandtable.plans import ORACLE, QUERIES
from strandtable.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLE[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
