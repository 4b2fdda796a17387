"""What larger tables ask for: results on keys beyond the small ones, and plans that do not gather or repeat their input."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postura.operators import evidence as E
from postura.operators import graph, limits
from postura.operators import traffic as N
from postura.plans import documents

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _packets(spark, n=40):
    k = F.col("id")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return spark.range(n).select(
        k.alias("ord"), F.timestamp_seconds(k).alias("ts"), (k + 1).alias("orig_len"), text("m", k % 3).alias("src_mac"), text("m", k % 4).alias("dst_mac"), F.lit("tcp").alias("protocol"),
        F.when(k % 5 > 0, text("a", k % 3)).alias("src_ip"), F.when(k % 7 > 0, text("a", k % 4)).alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(1).alias("dst_port"), (k % 3 > 0).alias("src_local"), F.lit(True).alias("dst_local"),
        (k % 9 == 0).alias("dst_broadcast"), F.lit(False).alias("dst_mac_broadcast"), F.lit(None).cast("string").alias("dns_name"), F.lit(None).cast("string").alias("dns_kind"), F.lit("c").alias("capture"))


def test_masks_of_large_keys(spark, tmp_path):
    """hex letters of the vendor half first appear at key 2119 and later."""
    spark.createDataFrame([(k,) for k in (0, 3, 2119, 21983, 89998, 5_400_000)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(db.execute(entry.oracle_sql()["mask_identifiers"]).fetchall())
    assert any(c in "ABCDEF" for r in want for c in r[1])
    assert sorted(map(tuple, entry.queries()["mask_identifiers"](spark, str(tmp_path)).collect())) == want


def test_supplements_do_not_shuffle_pairs(spark):
    """nothing is exchanged or aggregated once the pairs are made."""
    entries = spark.range(60).selectExpr("id as registry_id", "concat('s', id % 2) as site_id", "'net' as network", "timestamp_seconds(id) as observed_at", "true as supplemental")
    primaries = spark.range(30).selectExpr("id as primary_id", "concat('S', id % 3) as site_id", "concat(' NET', '') as network")
    got = E.supplements(entries, primaries)
    above = plan(got).split("SortMergeJoin")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    assert len(got.collect()) == 1800 == got.select("primary_id", "registry_id").distinct().count()


def test_packets_of_a_capture_do_not_meet_in_a_task(spark, no_automatic_broadcast):
    """what is joined by capture alone is sent to all."""
    packets = _packets(spark)
    for df in (limits.first_packets(packets, 7), limits.tracked_keys(packets, {"flow": 2, "host": 2, "endpoint": 2, "name": 2})):
        assert "SortMergeJoin" not in plan(df)
    assert limits.first_packets(packets, 7).count() == 7


def test_documents_are_dealt_to_all_cores(spark):
    """F8, F11: one small file of keys is no longer one task's documents."""
    assert "Exchange RoundRobin" in plan(documents._bundles(spark, D))


def test_alerts_read_the_flows_twice_and_reasons_shuffle_none(spark, no_automatic_broadcast):
    """the port rules share one pass for their counts and one for their first ten."""
    flows = spark.range(50).selectExpr("concat('f', id) as flow_key", "if(id % 2 = 0, 'external', 'internal') as scope", "id as bytes", "id as first_ord", "if(id % 3 = 0, 'd', 'e') as src_mac", "'g' as dst_mac", "id % 5 > 0 as src_local", "id % 2 = 1 as dst_local", "false as dst_broadcast", "if(id % 2 = 0, 'http', 'ssh') as category", "if(id % 2 = 0, 8080, 22) as service_port")
    devices = spark.createDataFrame([], "device string, role string, is_known boolean, dns_queries long, external_peers long, outbound_bytes long")
    alerts = N.watch_rules(devices, flows, spark.createDataFrame([(0,)], "n long"))
    assert plan(alerts).count("Range (0, 50") == 2
    got = {r.rule: (r.level, r.n_devices, r.n_flows, r.flows.split(",")) for r in alerts.collect()}
    assert got["admin-remote-ports"] == ("watch", 3, 50, [f"f{k}" for k in range(49, 39, -1)])
    assert got["unencrypted-http"] == ("review", 2, 25, [f"f{k}" for k in range(48, 28, -2)])
    assert "SortMergeJoin" not in plan(N.flow_attention_reasons(flows, spark.createDataFrame([("r", "watch", "f1,f2")], "rule string, level string, flows string")))


def test_flows_shuffle_packets_once(spark):
    """one exchange, and the initiator's bytes as counted packet by packet."""
    packets = _packets(spark)
    flows = N.flows(packets)
    assert plan(flows).count("Exchange hashpartitioning") == 1
    want = {}
    for r in sorted(N.flow_keys(packets).collect(), key=lambda r: r.ord):
        first, own = want.setdefault((r.flow_key, r.protocol), (r._from, []))
        own.append(r.orig_len if r._from == first else 0)
    assert {(r.flow_key, r.protocol): (r.packets, r.bytes_from_initiator) for r in flows.collect()} == {k: (len(v), sum(v)) for k, (_, v) in want.items()}
    assert any(0 in v for _, v in want.values())


def test_components_send_no_nodes_to_the_driver(spark):
    """the table of least neighbours is merged even where it looks small."""
    assert "BroadcastHashJoin" not in plan(graph._star(spark.range(100).selectExpr("id as a", "id % 7 as b")))
