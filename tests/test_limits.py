import random

from pyspark.sql import functions as F

from postura.operators import limits as M
from postura.operators import places

SHAPE = "capture string, ord long, protocol string, src_mac string, dst_mac string, src_ip string, dst_ip string, src_port int, dst_port int, src_local boolean, dst_local boolean, dst_broadcast boolean, dst_mac_broadcast boolean, dns_name string, dns_kind string"


def brute(rows, most, limits):
    """Packet by packet, as a parser would."""
    out = []
    for capture in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == capture), key=lambda r: r[1])
        held, dropped = {k: {} for k in limits}, {k: set() for k in limits}
        lost = dict.fromkeys(limits, 0)

        def use(kind, key):
            if key is None:
                return
            if key in held[kind] or len(held[kind]) < limits[kind]:
                held[kind][key] = held[kind].get(key, 0) + 1
            else:
                lost[kind] += 1
                dropped[kind].add(key)

        for _, _, protocol, sm, dm, si, di, sp, dp, sl, dl, db, dmb, name, kind in own[:most]:
            port = lambda p: "" if p is None else p
            a, b = f"{si or sm}#{port(sp)}", f"broadcast#{port(dp)}" if db else f"{di or dm}#{port(dp)}"
            use("flow", f"{protocol}|{a}|{b}" if db or a <= b else f"{protocol}|{b}|{a}")
            use("host", sm)
            use("host", None if dmb else dm)
            use("endpoint", None if sl else si)
            use("endpoint", None if dl or db else di)
            use("name", None if name is None else f"{kind}|{name}")
        for k in limits:
            if held[k]:
                out.append((capture, k, len(held[k]), len(dropped[k]), sum(held[k].values()), lost[k], k != "host" and bool(dropped[k])))
        n = len(own)
        out.append((capture, "packet", min(n, most), max(0, n - most), min(n, most), max(0, n - most), n >= most))
    return sorted(out)


def test_limits_equal_a_parser(spark):
    rng = random.Random(4)
    rows = []
    for capture, n in (("a", 900), ("b", 200), ("c", 3), ("d", 300)):
        for i in range(n):
            sl, dl = rng.random() < 0.6, rng.random() < 0.5
            name = f"n{rng.randint(0, 40)}" if rng.random() < 0.3 else None
            rows.append((capture, i * 3, rng.choice(["tcp", "udp"]), f"m{rng.randint(0, 30)}", f"m{rng.randint(0, 60)}", rng.choice([None, f"1.{rng.randint(0, 50)}"]), rng.choice([None, f"2.{rng.randint(0, 50)}"]), rng.choice([None, 80]), rng.choice([None, 443]), sl, dl, rng.random() < 0.1, rng.random() < 0.1, name, "dns" if name else None))
    limits = {"flow": 60, "host": 40, "endpoint": 25, "name": 10}
    got = M.limit_counts(spark.createDataFrame(rows, SHAPE).repartition(6), 300, limits)
    assert sorted(tuple(r) for r in got.select("capture", "kind", "tracked", "dropped", "uses", "dropped_uses", "truncated").collect()) == brute(rows, 300, limits)


def test_no_packets_and_given_limits(spark):
    assert M.limit_counts(spark.createDataFrame([], SHAPE)).count() == 0
    one = spark.createDataFrame([("a", 0, "arp", "m", "ff", None, None, None, None, True, True, True, True, None, None)], SHAPE)
    assert {(r.kind, r.tracked, r.truncated) for r in M.limit_counts(one).collect()} == {("flow", 1, False), ("host", 1, False), ("packet", 1, False)}
    assert M.first_packets(one.crossJoin(spark.range(50).select("id")).drop("ord").withColumnRenamed("id", "ord"), 7).count() == 7


def test_places_over_parts(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 800, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 1000).alias("x"))
    got = sorted(map(tuple, places.placed(rows, "g", ["x"]).collect()))
    seen = {}
    for g, _, place in got:
        seen[g] = seen.get(g, 0) + 1
        assert place == seen[g]


def test_rows_without_a_group_are_one(spark):
    rows = spark.range(600).select(F.when(F.col("id") >= 500, "g").alias("g"), "id")
    got = places.placed(rows, "g", ["id"]).collect()
    assert all(r.place == (r.id + 1 if r.g is None else r.id - 499) for r in got) and len(got) == 600
