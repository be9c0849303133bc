"""Every registered query of the core against its DuckDB oracle, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tesserine import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, small, key):
    df = registry.queries()[key](spark, small)
    rows, columns = df.collect(), df.columns
    if key not in registry.oracle_sql():
        assert columns
        return
    expected = duck.sql(registry.oracle_sql()[key])
    assert sorted(columns) == sorted(expected.columns)
    order = [(columns.index(c), expected.columns.index(c)) for c in sorted(columns)]
    got = sorted([plain(r[i]) for i, _ in order] for r in rows)
    assert got == sorted([plain(r[j]) for _, j in order] for r in expected.fetchall())
