"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
KNOWN = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return c


def plain(rows, columns):
    def one(x):
        if x is None or x != x:
            return ""
        if isinstance(x, float) and x == int(x):
            return str(int(x))
        return str(x)

    return sorted(tuple(one(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_equals_duckdb(spark, db, name):
    got = entry.queries()[name](spark, D)
    want = db.execute(KNOWN[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([r.asDict() for r in got.collect()], columns) == plain([dict(zip(columns, r)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
