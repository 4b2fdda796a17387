import random

import pytest
from pyspark.sql import functions as F

from postura.operators import traffic as N
from postura.operators.tables import ConcurrentChange, KeyedTable
from postura.streaming import packets as S
from postura.streaming import registries as R

SHAPE = "ord long, ts timestamp, orig_len long, src_mac string, dst_mac string, protocol string, src_ip string, dst_ip string, src_port int, dst_port int, src_local boolean, dst_local boolean, dst_broadcast boolean, dst_mac_broadcast boolean, dns_name string, dns_kind string"


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    """Packets of ten minutes in files by time, and a last one that lets all windows close."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        name = f"n{rng.randint(0, 9)}" if rng.random() < 0.2 else None
        rows.append((i, 1_000_000 + i * 0.4, rng.randint(60, 1500), f"m{rng.randint(0, 5)}", f"m{rng.randint(0, 5)}", rng.choice(["tcp", "udp", "arp", "icmp"]), rng.choice([None, f"1.0.0.{rng.randint(0, 30)}", "fe80::1"]), rng.choice([None, f"2.0.0.{rng.randint(0, 30)}"]),
                     rng.choice([None, 5]), rng.choice([None, 7]), rng.random() < 0.6, rng.random() < 0.4, rng.random() < 0.1, rng.random() < 0.1, name, "dns" if name else None))
    path = str(tmp_path_factory.mktemp("packets"))
    df = spark.createDataFrame(rows, SHAPE.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    for k in range(5):
        df.filter(F.floor(F.col("ord") / 300) == k).coalesce(1).write.mode("append").parquet(path)
    end = df.filter("ord = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 day")).withColumns({"ord": F.lit(9999).cast("long"), "dns_name": F.lit("z"), "dns_kind": F.lit("dns"), "src_ip": F.lit("9.9.9.9"), "src_local": F.lit(False), "dst_broadcast": F.lit(False)})
    end.coalesce(1).write.mode("append").parquet(path)
    return path, df


def streamed(spark, path, make, tmp_path, name):
    rows = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    out = str(tmp_path / "out")
    make(rows).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("name", ["total_windows", "host_windows", "gateway_windows", "initiator_windows", "endpoint_windows", "name_windows"])
def test_windows_of_a_stream_equal_the_batch(spark, packets, tmp_path, name):
    path, df = packets
    make = getattr(S, name)
    got = streamed(spark, path, make, tmp_path, name)
    want = make(df)
    assert rows_of(got, want.columns) == rows_of(want, want.columns) and got.count() > 5


def test_windows_equal_the_plain_operators(spark, packets):
    _, df = packets
    one = df.filter((F.col("ts") >= F.timestamp_seconds(F.lit(1_000_020))) & (F.col("ts") < F.timestamp_seconds(F.lit(1_000_080))))
    of = lambda windows: windows.filter(F.col("start") == F.timestamp_seconds(F.lit(1_000_020)))
    hosts = ["mac", "packets_sent", "packets_received", "bytes_sent", "bytes_received", "arp_packets", "dns_queries", "local_ips", "external_peers"]
    assert rows_of(of(S.host_windows(df)), hosts) == rows_of(N.host_traffic(one), hosts)
    flows = ["flow_key", "packets", "bytes", "bytes_from_initiator", "first_ord"]
    assert rows_of(of(S.initiator_windows(df)), flows) == rows_of(N.flows(one), flows)
    assert rows_of(of(S.endpoint_windows(df)), ["ip", "packets", "bytes"]) == rows_of(N.endpoints(one), ["ip", "packets", "bytes"])
    assert rows_of(of(S.name_windows(df)), ["dns_kind", "dns_name", "n"]) == rows_of(N.dns_names(one), ["dns_kind", "dns_name", "n"])
    totals = ["packets", "bytes", "first_seen", "last_seen", "arp_packets", "icmp_packets", "ipv6_packets"]
    assert rows_of(of(S.total_windows(df)), totals) == rows_of(N.totals(one), totals)
    best = of(S.gateway_windows(df)).orderBy(F.desc("votes")).first().votes
    assert best == N.gateway(one).first().votes


OBSERVED = "content_hash string, source_run_uid string, observation_id string"


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), OBSERVED, ["content_hash"])
    batch = spark.createDataFrame([(0, "a", "r1", "o1"), (1, "a", "r2", "o2"), (2, "b", "r1", "o3"), (3, "c", None, "o4"), (4, "d", None, "o4")], "ord long, " + OBSERVED)
    apply = R.once(table, "s", R.observations)
    apply(batch, 0)
    first = rows_of(table.read(), ["content_hash", "source_run_uid", "observation_id"])
    assert first == [("a", "r1", "o1"), ("c", None, "o4")]
    n = table._newest()[0]
    apply(batch, 0)
    apply(batch.withColumn("content_hash", F.lit("z")), 0)  # a repeat, whatever it holds
    assert table._newest()[0] == n and table.batches() == {"s": 0}
    R.once(table, "other", R.observations)(spark.createDataFrame([(0, "x", "r9", "o9")], "ord long, " + OBSERVED), 0)
    assert table.read().count() == 3 and table.batches() == {"s": 0, "other": 0}
    table.delete(spark.createDataFrame([("x",)], "content_hash string"))
    assert table.batches() == {"s": 0, "other": 0} and table.read().count() == 2


def test_observations_of_a_stream_equal_the_ladder_one_by_one(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"h{rng.randint(0, 40)}", rng.choice([None, f"r{rng.randint(0, 30)}"]), f"o{rng.randint(0, 30)}") for i in range(120)]
    for k in range(4):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], "ord long, " + OBSERVED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = KeyedTable(spark, str(tmp_path / "t"), OBSERVED, ["content_hash"])
    stream = spark.readStream.schema("ord long, " + OBSERVED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it goes on where it was
        R.start(stream, table, "s", R.observations, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert table.batches() == {"s": 3}
    got = rows_of(table.read(), ["content_hash", "source_run_uid", "observation_id"])
    hashes, runs, alone = [x[0] for x in got], [x[1] for x in got if x[1]], [x[2] for x in got if not x[1]]
    assert len(set(hashes)) == len(hashes) and len(set(runs)) == len(runs) and len(set(alone)) == len(alone)
    # nothing is left out without a reason: each row shares its hash, its run or (without a run) its id with a kept one, or with one that was
    seen_h = {r[1] for r in rows}
    assert all(h in seen_h for h in hashes) and len(got) > 20


def test_another_writer_in_between(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"])
    rows = lambda *x: spark.createDataFrame(x, "k string, v long")
    change, seen = R.last_writer(["k"], "v", ()), []

    def slow(held, batch):
        if not seen:
            table.write(rows(("other", 1)))
        seen.append(1)
        return change(held, batch)

    R.once(table, "s", slow)(rows(("a", 1), ("a", 2)), 0)
    assert rows_of(table.read(), ["k", "v"]) == [("a", 2), ("other", 1)] and len(seen) == 2
    monkeypatch.setattr(R, "TRIES", 1)
    seen.clear()
    with pytest.raises(ConcurrentChange):
        R.once(table, "s", slow)(rows(("b", 1)), 1)


def test_runs_and_inventories(spark, tmp_path):
    runs = KeyedTable(spark, str(tmp_path / "runs"), "content_hash string, run_uid string", ["content_hash"])
    apply = R.once(runs, "s", R.first_writer(["content_hash"], "ord"))
    made = lambda *x: spark.createDataFrame(x, "ord long, content_hash string, run_uid string")
    apply(made((1, "a", "second"), (0, "a", "first")), 0)
    apply(made((0, "a", "third"), (1, "b", "fourth")), 1)
    assert rows_of(runs.read(), ["content_hash", "run_uid"]) == [("a", "first"), ("b", "fourth")]
    from postura.operators import inventory as V

    held = KeyedTable(spark, str(tmp_path / "inv"), V.SCHEMA, ["network", "id"])
    take = R.once(held, "s", R.inventory(F.timestamp_seconds(F.lit(9))))
    item = lambda i, ord, mac, ip: spark.sql(f"select 'A' as network, '{i}' as id, {ord}L as ord, '{i}' as device, '{mac}' as mac, '' as vendor, '{ip}' as ip, '' as hostnames, 'x' as status, '' as notes, '' as security, timestamp_seconds(1) as added_at, timestamp_seconds(1) as updated_at")
    take(item("a", 0, "m", "1"), 0)
    take(item("b", 0, "M", "2").unionByName(item("c", 1, "k", "2")), 1)
    take(item("b", 0, "M", "2"), 1)
    assert rows_of(held.read(), ["id", "device", "ip"]) == [("a", "b", "2"), ("c", "c", "2")]
