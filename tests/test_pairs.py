"""Pairs of rows with a key in common against brute force, and how the tiers make them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postura.operators import comparison as C
from postura.operators import identity as I
from postura.operators import pairs as R


@pytest.mark.parametrize("block", [3, R.BLOCK])
def test_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(5)
    side = lambda n: {i: sorted({"hot"} if rng.random() < 0.4 else {f"k{rng.randrange(12)}" for _ in range(rng.randrange(4))}) for i in range(n)}
    left, right = side(40), side(31)
    frame = lambda rows, p: spark.createDataFrame(list(rows.items()), f"{p} int, {p}_keys array<string>")
    got = R.sharing(frame(left, "a"), frame(right, "b"), "a_keys", "b_keys").collect()
    want = {(a, b): sorted(set(x) & set(y)) for a, x in left.items() for b, y in right.items() if set(x) & set(y)}
    assert Counter((r.a, r.b) for r in got) == Counter(list(want)) and {(r.a, r.b): r.shared for r in got} == want


def test_repeated_devices_and_null_keys_make_a_pair_once(spark):
    shape = "device_id string, macs array<string>"
    b = spark.createDataFrame([("b1", ["x", None, "x"]), ("b1", ["y"]), ("b2", None)], shape)
    c = spark.createDataFrame([("c1", ["y", "x"]), ("c2", [None])], shape)
    assert [tuple(r) for r in I.candidates(b, c, "macs").collect()] == [("b1", "c1", ["x", "y"])]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiers_neither_send_devices_to_all_nor_shuffle_pairs(spark):
    """One broadcast a tier, that of the keys of more than one block; ids and pairs go to nobody else."""
    n = 3000
    side = lambda p: spark.range(n).select(F.concat(F.lit(p), "id").alias("device_id"), F.array(F.when(F.col("id") % 2 == 0, F.concat(F.lit("i"), "id"))).alias("ids"), F.array(F.concat(F.lit("h"), F.col("id") % 3)).alias("names"))
    found = I.tiered(side("b"), side("c"), {"persisted-device-id": "ids", "hostname-vendor": "names"})
    assert "Window" not in _plan(found) and "BroadcastHashJoin" in _plan(found) and _plan(found).count("LeftAnti, BuildRight") == 0
    counts = {(r.rule, r.outcome): r["count"] for r in found.groupBy("rule", "outcome").count().collect()}
    assert counts == {("persisted-device-id", "confirmed"): n // 2, ("hostname-vendor", "uncertain"): 3 * (n // 6) ** 2}


def test_each_uncertain_pair_is_an_event(spark):
    """Three devices that share a name with three others are nine events, not six."""
    shape = "pair_id long, device_id string, ids array<string>, macs array<string>, hashed array<string>, names array<string>, ips array<string>"
    side = lambda p: spark.createDataFrame([(1, f"{p}{k}", [], [], [], ["h"], []) for k in range(3)], shape)
    ports = spark.createDataFrame([], "pair_id long, device_id string, pos int, protocol string, port int, service string")
    snap = spark.createDataFrame([("x", None, False, "complete", ["ports"], [])], "obs_id string, observed_at timestamp, partial boolean, status string, present array<string>, missing array<string>")
    covered = C.pair_coverage(spark.createDataFrame([(1, "x", "x")], "pair_id long, base_obs string, current_obs string"), C.coverage_snapshots(snap))
    events = C.change_events(side("b"), side("c"), ports, ports, covered)
    assert sorted((r.base_id, r.current_id) for r in events.collect()) == [(f"b{i}", f"c{j}") for i in range(3) for j in range(3)]
    subjects = C.response_targets(side("c")).withColumn("observation_id", F.lit("o"))
    responses = spark.createDataFrame([], "target_kind string, target string, state string, observation_id string")
    told = C.activity_events(events, subjects, responses).collect()
    assert len(told) == len({r.event_id for r in told}) == 9 and {(r.state, r.carried, r.priority) for r in told} == {(None, False, "normal")}
    assert "group by all union all select pair_id, null" not in entry.oracle_sql()["comparison_events"]


def test_ordered_events_are_sorted_before_they_are_pairs(spark, monkeypatch):
    """The order of event_order, devices of several, repeated and shared keys; small chunks and batches."""
    monkeypatch.setattr(R, "CHUNK", 2)
    monkeypatch.setattr(R, "BATCH", 3)
    rng = random.Random(7)
    shape = "pair_id long, device_id string, ids array<string>, macs array<string>, hashed array<string>, names array<string>, ips array<string>"
    some = lambda p, n: [rng.choice([None, *(f"{p}{k}" for k in range(n))]) for _ in range(rng.randrange(4))]
    side = lambda p: spark.createDataFrame([(k % 3, f"{p}{k % 60}\u00e9" if k % 7 else f"{p}{k % 60}", some("i", 90), some("m", 60), [], some("h", 4), some("a", 9)) for k in range(66)], shape)
    base, current = side("b"), side("c")
    ports = lambda d: d.select("pair_id", "device_id", F.lit(0).alias("pos"), F.lit("tcp").alias("protocol"), F.size("macs").alias("port"), F.lit("s").alias("service"))
    snap = spark.createDataFrame([("x", None, False, "complete", ["ports"], [])], "obs_id string, observed_at timestamp, partial boolean, status string, present array<string>, missing array<string>")
    covered = C.pair_coverage(spark.createDataFrame([(k, "x", "x") for k in range(3)], "pair_id long, base_obs string, current_obs string"), C.coverage_snapshots(snap))
    args = (base, current, ports(base), ports(current), covered)
    events = C.change_events(*args)
    want = [tuple(r) for r in C.event_order(events).select(*sorted(events.columns)).collect()]
    found = C.ordered_events(*args)
    got = [tuple(r) for r in found.select(*sorted(events.columns)).collect()]
    assert len(want) > 100 and got == want and found.columns == events.columns
    assert {r.event_type for r in found.select("event_type").distinct().collect()} >= {C.UNCERTAIN, "new-device-observed", "important-device-metadata-changed"}


def test_comparison_events_sorts_no_pairs(spark):
    """Range-dealing the events for their order would shuffle the pairs."""
    assert "rangepartitioning" not in _plan(entry.queries()["comparison_events"](spark, "/root/testdata/sf0.001"))
