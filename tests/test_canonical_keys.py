import json
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postura.functions import canonical as K
from postura.operators import device_keys as D


def plain(value):
    """Canonical form by the standard library."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def shuffled(rng, value):
    """Another spelling of a value."""
    if isinstance(value, dict):
        names = list(value)
        rng.shuffle(names)
        return "{ " + ", ".join(json.dumps(n, ensure_ascii=rng.random() < 0.5) + " : " + shuffled(rng, value[n]) for n in names) + "}"
    if isinstance(value, list):
        return "[" + " ,".join(shuffled(rng, v) for v in value) + " ]"
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value) + rng.choice(["", ".0", ".000"])
    if isinstance(value, float):
        return str(value) + rng.choice(["", "0", "00"])
    return json.dumps(value, ensure_ascii=rng.random() < 0.5)


def made(rng, depth):
    kind = rng.randint(0, 6 if depth else 4)
    if kind < 5:
        return [None, True, rng.randint(-1000, 10**12), rng.choice([0.5, -3.25, 1234.125]), "".join(rng.choice('aB"\\\né€😀/ 1.0E') for _ in range(rng.randint(0, 12)))][kind]
    if kind == 5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {"".join(rng.choice("abAé_1") for _ in range(rng.randint(0, 3))): made(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_canonical_form_of_any_depth(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        value = made(rng, 6)
        rows.append((i, shuffled(rng, value), plain(value)))
    got = spark.createDataFrame(rows, "i int, j string, want string").select("i", K.canonical("j").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), [(r.got, r.want) for r in got if r.got != r.want][:3]


def test_what_is_no_json(spark):
    rows = [("{",), ("",), (None,), ('{"a":1,"a":2}',), ("[1e2, 20.0, \"20.0\", 1.50]",)]
    assert [r[0] for r in spark.createDataFrame(rows, "j string").select(K.canonical("j")).collect()] == [None, None, None, None, '[100,20,"20.0",1.5]']


def test_ids(spark):
    row = spark.range(1).select(
        K.run_uid(F.lit("Home Net!"), F.lit("2026-01-02 03:04:05").cast("timestamp"), F.lit(None).cast("string"), F.lit("abcdef0123456789")).alias("run"), K.combined_hash(F.array().cast("array<string>")).alias("none"),
        K.run_uid(F.lit(""), F.lit(None).cast("timestamp"), F.lit("x"), F.lit("")).alias("bare"), K.registry_id(F.lit(None).cast("string"), F.lit(""), F.lit("--Ä--"), F.lit("h")).alias("obs"),
    ).first()
    assert row.run == "home-net_2026-01-02T03-04-05_unknown_abcdef012345" and row.none == "" and re.fullmatch("unknown_notime_x_[0-9a-f]{12}", row.bare) and row.obs == "obs_undated_site_h"


@pytest.mark.parametrize("text, v4, v6", [
    ("10.0.0.1", True, False), ("dev-10-0-0-1x", True, False), ("1.2.3.4.5", True, False), ("999.1.2.3.4", False, False), ("1.2.3", False, False), ("a12.1.1.1", True, False), ("1.2.3.4567", False, False), ("300.1.1.1", False, False),
    ("fe80::1", False, True), ("x fe80::", False, True), ("::", False, False), ("a:b:c", False, True), ("a:b", False, False), ("abcde:b:c", False, False), ("tv:1:2:3", False, False), ("tv 1:2:3", False, True), ("router", False, False), ("2001:db8:0:0:0:0:0:1", False, True),
])
def test_ids_made_of_addresses(spark, text, v4, v6):
    row = spark.createDataFrame([(text,)], "t string").select(D.holds_ipv4("t").alias("a"), D.holds_ipv6("t").alias("b"), D.explicit_id("t").alias("c")).first()
    assert (row.a, row.b, row.c) == (v4, v6, None if v4 or v6 else text)


def test_keys_of_null_and_empty(spark):
    shape = "device_id string, macs array<string>, hostnames array<string>, vendors array<string>, ips array<string>, evidence array<struct<kind:string,value:string>>"
    rows = [(None, None, None, None, None, None), ("Dev-0123456789AB", ["x", None, "AA-BB-CC-DD-EE-FF"], ["H", "h ", None], ["V", "w"], ["", "1.1.1.1"], [("mac-address", None), ("mac-address", "ab" * 20), ("vendor", "aabbccddeeff"), ("mac-address", "0011.2233.4455")])]
    a, b = D.with_keys(spark.createDataFrame(rows, shape)).collect()
    assert (a.ids, a.macs, a.hashed, a.names, a.ips) == ([], [], [], [], [])
    assert (b.ids, b.macs, b.hashed, b.names, b.ips) == ([], ["00:11:22:33:44:55", "aa:bb:cc:dd:ee:ff"], ["hash:" + "ab" * 20], ["h|v", "h|w"], ["1.1.1.1"])


def test_all_tiers_are_filled(spark):
    rules = {r.rule for r in entry.queries()["device_key_outcomes"](spark, "/root/testdata/sf0.01").select("rule").distinct().collect()}
    assert rules == {"persisted-device-id", "mac", "hashed-mac", "hostname-vendor", "ip-continuity"}
