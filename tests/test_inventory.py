import random

import pytest
from pyspark.sql import functions as F

from postura.operators import inventory as V

NOW, THEN = "2026-02-01 00:00:00", "2026-01-01 00:00:00"


def brute(held, new):
    """One row after the other, as an import is stated."""
    out, by = [dict(r) for r in held], {}
    for r in out:
        by |= {(r["network"], k, v): r for k, v in (("mac", r["mac"].upper()), ("ip", r["ip"])) if v}
    for r in new:
        keys = [(r["network"], k, v) for k, v in (("mac", r["mac"].upper()), ("ip", r["ip"])) if v]
        hit = next((by[k] for k in keys if k in by), None)
        if hit is not None:
            hit |= {k: v for k, v in r.items() if k not in ("id", "added", "ord")} | {"updated": True}
        else:
            out.append(dict(r))
            by |= dict.fromkeys(keys, out[-1])
    return sorted((r["network"], r["id"], r["device"], r["mac"], r["ip"], r["updated"]) for r in out)


def frame(spark, rows):
    shaped = [(r["network"], r["id"], r["ord"], r["device"], r["mac"], "v", r["ip"], "h", "unknown", "", "") for r in rows]
    schema = "network string, id string, ord long, device string, mac string, vendor string, ip string, hostnames string, status string, notes string, security string"
    return spark.createDataFrame(shaped, schema).withColumn("added_at", F.lit(THEN).cast("timestamp")).withColumn("updated_at", F.lit(THEN).cast("timestamp")).select(*[c.split()[0] for c in V.SCHEMA.split(", ")])


def result(df):
    return sorted((r.network, r.id, r.device, r.mac, r.ip, r.updated_at > r.added_at) for r in df.collect())


def made(rng, n, spread, start=0, prefix="n"):
    pick = lambda p: rng.choice(["", *[f"{p}{x}" for x in range(spread)]])
    return [{"network": rng.choice("AB"), "id": f"{prefix}{i}", "ord": start + i, "device": f"d{prefix}{i}", "mac": rng.choice([str.upper, str.lower])(pick("m")), "ip": pick("i"), "updated": False} for i in range(n)]


@pytest.mark.parametrize("seed, spread, rounds", [(1, 5, 12), (3, 200, 12), (5, 60, 0)])
def test_import_equals_brute_force(spark, seed, spread, rounds, monkeypatch):
    monkeypatch.setattr(V.entering, "__defaults__", (rounds,))
    rng = random.Random(seed)
    held, new = made(rng, 60, spread, prefix="h"), made(rng, 200, spread)
    assert result(V.imported(frame(spark, held), frame(spark, new), F.lit(NOW).cast("timestamp"))) == brute(held, new)


def test_a_row_matches_one_entered_just_before_and_long_chains(spark):
    row = lambda i, mac, ip: {"network": "A", "id": f"n{i}", "ord": i, "device": f"d{i}", "mac": mac, "ip": ip, "updated": False}
    chain = [row(i, f"m{i // 2}", f"i{(i + 1) // 2}") for i in range(80)]  # each shares a key with the one before
    new = [row(100, "x", "y"), row(101, "X", "z"), row(102, "w", "z"), row(103, "w", "y"), row(104, "", ""), row(105, "", "")]
    for part in (chain, new, chain[::-1]):
        part = [r | {"ord": k} for k, r in enumerate(part)]
        assert result(V.imported(frame(spark, []), frame(spark, part), F.lit(NOW).cast("timestamp"))) == brute([], part)


def test_empty_null_and_places(spark):
    assert V.imported(frame(spark, []), frame(spark, []), F.lit(NOW).cast("timestamp")).count() == 0
    held = [{"network": "A", "id": "h", "ord": 7, "device": "h", "mac": "m", "ip": None, "updated": False}]
    new = [{"network": "A", "id": f"n{i}", "ord": 100 + i, "device": f"d{i}", "mac": m, "ip": None, "updated": False} for i, m in enumerate(["M", None, "k"])]
    got = {r.id: (r.ord, r.device) for r in V.imported(frame(spark, held), frame(spark, new), F.lit(NOW).cast("timestamp")).collect()}
    assert got == {"h": (7, "d0"), "n1": (9, "d1"), "n2": (10, "d2")}


def test_inventory_table(spark, tmp_path):
    held = V.Inventory(spark, str(tmp_path / "inv"))
    one = spark.createDataFrame([("A", 0, "router", "aa", "10.0.0.1"), ("A", 1, "tv", "bb", "10.0.0.2"), ("B", 0, "pc", "aa", "10.0.0.1")], "network string, ord long, device string, mac string, ip string")
    held.import_rows(one, F.lit(THEN).cast("timestamp"))
    held.import_rows(one.filter("ord = 1").withColumn("device", F.lit("television")), F.lit(NOW).cast("timestamp"))
    assert sorted((r.device, str(r.added_at), str(r.updated_at)) for r in held.devices("A").collect()) == [("router", THEN, THEN), ("television", THEN, NOW)]
    assert [(r.network, r.devices) for r in held.networks().collect()] == [("A", 2), ("B", 1)]
    assert held.by_address("B", "10.0.0.1").first().device == "pc" and held.by_address("B", "10.0.0.2").isEmpty()
    assert held.table.read().select("id").distinct().count() == 3
