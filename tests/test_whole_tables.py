"""Queries that take every row of their tables, on tables larger than the smallest."""

import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as entry

from .test_queries import plain

D = "/root/testdata/sf0.01"
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


@pytest.mark.parametrize("name", ["inventory_match", "known_semi", "inventory_insert", "format_bytes"])
def test_equals_duckdb_without_bounds(spark, name):
    sql = entry.oracle_sql()[name]
    assert "<= 600" not in sql and "< 4000" not in sql
    db = duckdb.connect()
    for t in ("supplier", "customer", "lineitem"):
        db.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    got = plain([r.asDict() for r in entry.queries()[name](spark, D).collect()], columns)
    assert got == plain([dict(zip(columns, r)) for r in want.fetchall()], columns)
    assert name != "inventory_match" or len(got) == 1500
    assert name != "format_bytes" or len(got) == 60000


def test_components_of_all_customers(spark):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    keys = [r.c_custkey for r in spark.read.parquet(f"{D}/customer.parquet").select("c_custkey").collect()]
    assert max(keys) > 300
    for k in keys:
        for b in [k % 37] + ([100 + k // 4] if k % 4 < 2 and k % 37 > 30 else []):
            x, y = root(f"r{k}"), root(f"k{b}")
            parent[max(x, y)] = min(x, y)
    assert {r.node: r.comp for r in entry.queries()["connected_records"](spark, D).collect()} == {x: root(x) for x in parent}


def test_all_conversations_are_normalised(spark):
    rows = spark.read.parquet(f"{D}/conversations.parquet").collect()
    assert any(not r.text.isascii() for r in rows if r.text)
    one = lambda t: None if t is None else hashlib.md5(re.sub(SPACE, " ", re.sub(f"^{SPACE}|{SPACE}$", "", t)).lower().encode()).hexdigest()
    got = entry.queries()["text_normalize"](spark, D).collect()
    assert sorted((r.conv_id, r.turn, r.text_md5 or "") for r in got) == sorted((r.conv_id, r.turn, one(r.text) or "") for r in rows)
