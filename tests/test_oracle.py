"""Every query that has SQL gives what DuckDB gives on the same tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in got.dtypes} == types
    cols = sorted(got.columns)
    a = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    b = sorted(str([plain(dict(zip(want.columns, r, strict=True))[c]) for c in cols]) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
