"""Every registered query against its SQL, over the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from wiretally.queries import ORACLE_SQL, QUERIES

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE_SQL))


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else round(v, 6)
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    res = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["slot", "quantile"]
