"""Every query with an SQL twin against DuckDB, on the smallest tables."""

import datetime as dt
import decimal

import duckdb
import pytest

from assaykit.plans import core, probes, state

QUERIES = core.QUERIES | probes.QUERIES | state.QUERIES
ORACLE = core.ORACLE | probes.ORACLE | state.ORACLE
TABLES = "region nation customer supplier part orders lineitem events documents conversations benchmark pages".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, dt.datetime):
        return str(value.replace(tzinfo=None)).removesuffix(" 00:00:00")
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, duck, name):
    made = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made.columns, made.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
