"""Every registered query runs at the smallest scale and equals its SQL where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cinderleaf.queries.views import TABLES

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    expected = sorted([plain(r[i]) for i in at] for r in result.fetchall())
    assert sorted([plain(r[c]) for c in order] for r in rows) == expected
