import json

from pyspark.sql import functions as F

from postura.functions import safety as Y
from postura.operators import evidence as E
from postura.sources import documents as D

BUNDLE = {
    "schemaVersion": "x.observation-bundle.v1", "observationId": "o 1", "site": {"siteId": "s/1", "networkName": 5}, "collector": {}, "batch": {"startedAt": "2024-01-02T03:04:05Z", "notes": ["password: x", " two  words ", 3]},
    "vantage": {}, "coverage": {"score": 0.9, "expectedSources": ["ports"], "presentSources": ["ports"]}, "sources": [{"sourceId": "a1", "fileName": "/x/y z.xml", "recordCount": 2.7}, 7],
    "devices": [{"deviceId": "d1", "ips": ["10.0.0.1", "x", 3], "macs": ["aabbccddeeff"], "openPorts": [{"port": 80, "sourceId": "a1"}, {"port": 0, "sourceId": "a1"}, {"port": 81, "sourceId": "zz"}, {"port": 1.5, "sourceId": "a1"}],
                 "identityEvidence": [{"kind": "hostname", "value": "nas", "sourceId": "a1"}, {"kind": "bad", "value": "nas", "sourceId": "a1"}]}, {"ips": "10.0.0.2"}],
}


def texts(spark, values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")


def test_bundles(spark):
    without = lambda **kw: json.dumps({**BUNDLE, **kw})
    many = without(devices=[{"deviceId": f"d{k}"} for k in range(1200)])
    rows = texts(spark, [json.dumps(BUNDLE), "nope", None, "[]", without(schemaVersion="y"), without(site=[]), without(devices={}), without(sources=[1]), " " * (D.MAX_BUNDLE_BYTES + 1), many])
    got = D.bundles(rows.withColumnRenamed("c", "json")).orderBy("k").collect()
    assert [r.error for r in got] == [None, "not JSON", "not JSON", "not a bundle", "not a bundle", "part missing", "list missing", "no sources", "too large", None]
    one = got[0]
    assert one.observation_id == "o-1" and one.site.site_id == "s-1" and one.site.network == "unknown" and one.coverage.status == "complete" and not one.batch.partial and one.batch.notes == ["two words"]
    assert [(s.source_id, s.kind, s.file_name, s.n_records) for s in one.sources] == [("a1", "run-manifest", "y z.xml", 2)]
    first, second = one.devices
    assert first.ips == ["10.0.0.1"] and first.macs == ["AA:BB:CC:DD:EE:FF"] and [p.port for p in first.ports] == [80] and [(e.value, e.confidence) for e in first.evidence] == [("nas", "weak")]
    assert second.device_id == "dev-unknown" and second.ips == [] and second.ports == []
    assert len(got[-1].devices) == D.MAX_DEVICES
    devices = D.bundle_devices(D.bundles(rows.withColumnRenamed("c", "json")), "k")
    assert {r.k: r.n for r in devices.groupBy("k").agg(F.count("*").alias("n")).collect()} == {0: 2, 9: 1000}


def test_files_and_analyses(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "meta": {"fileName": "a/b?.pcap", "packetCount": -3}, "devices": [{"id": "d", "ips": ["1.2.3.4", 5], "categories": ["dns", "zz"], "role": "x"}], "flows": [{"port": 70000, "bytes": 5.0}, 3]}))
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "meta": {}, "devices": [7]}))
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.json").write_text(" " * 2000)
    a, b, c, d = D.analyses(D.json_files(spark, str(tmp_path), 1000)).orderBy("file").collect()
    assert (a.error, b.error, c.error) == (None, "empty analysis", "not JSON") and d.json is None and d.error == "too large"
    assert a.meta.file_name == "b_.pcap" and a.meta.packets == 0 and a.devices[0].ips == ["1.2.3.4"] and a.devices[0].categories == ["dns", "other"] and a.devices[0].role == "device"
    assert len(a.flows) == 1 and a.flows[0].port is None and a.flows[0].bytes == 5 and a.flows[0].id == "flow-unknown" and a.flows[0].scope == "external"
    assert D.analyses(texts(spark, []).withColumnRenamed("c", "json")).count() == 0


def test_safe_texts(spark):
    unsafe = ["/etc/passwd", "see C:\\x", "\\\\host\\share", "sk-" + "a" * 20, "ghp_" + "b" * 20, "AKIA" + "A" * 16, "BEGIN RSA PRIVATE KEY", "Api-Key : 1", "<nmaprun x", "pcap  global header", "TCP 1.2.3.4 >"]
    safe = ["a/b", "x:y", "sk-short", " plain\t text ", "token of thanks"]
    got = [r.t for r in texts(spark, [*unsafe, *safe, None, ""]).orderBy("k").select(Y.safe_text("c", 12).alias("t"), "k").collect()]
    whole = [r.t for r in texts(spark, [*unsafe, *safe, None, ""]).orderBy("k").select(Y.safe_text("c", 300).alias("t"), "k").collect()]
    assert whole == [""] * len(unsafe) + ["a/b", "x:y", "sk-short", "plain text", "token of thanks", "", ""]
    assert got[len(unsafe) + 4] == "token of tha"
    ids = [r.t for r in texts(spark, ["a  b", "", None, "port state-service x", "host address addr", "x" * 200]).orderBy("k").select(Y.safe_id("c", "no").alias("t"), "k").collect()]
    assert ids == ["a-b", "no", "no", "no", "no", "x" * 120]


def test_evidence(spark):
    rows = spark.createDataFrame([([("e2", "mac-address", "AA-BB-CC-DD-EE-FF"), ("e1", "hostname", "NAS  1"), ("e3", "vendor", "nas 1")], ["mac-address", "hostname"], ["aa:bb:cc:dd:ee:ff", "nas 1|acme"]), ([], [], []), (None, ["hostname"], ["x"])],
                                 "e array<struct<evidence_id:string,kind:string,value:string>>, k array<string>, v array<string>")
    assert [r.ids for r in rows.select(E.evidence_ids("e", "k", "v").alias("ids")).collect()] == [["e1", "e2"], [], None]
    hashed = texts(spark, ["sha256:" + "A" * 32, "hash:" + "b" * 64, "c" * 31, None]).orderBy("k").select(E.hashed_mac("c").alias("h"), "k").collect()
    assert [r.h for r in hashed] == ["hash:" + "a" * 32, "hash:" + "b" * 64, None, None]


def test_device_records_are_cut_before_they_are_collected(spark):
    e = spark.range(100).select(F.lit("d").alias("device_id"), F.col("id").alias("seq"), F.lit("hostname").alias("kind"), (F.col("id") % 60).cast("string").alias("value"), F.lit("s").alias("source_id"))
    p = spark.range(600).select(F.lit("d").alias("device_id"), F.col("id").alias("seq"), F.lit("tcp").alias("protocol"), (600 - F.col("id")).cast("int").alias("port"), F.lit("x").alias("service"), F.lit("s").alias("source_id"))
    (one,) = E.device_records(e, p).collect()
    assert [x.value for x in one.evidence] == [str(k) for k in range(40)] and [x.port for x in one.ports] == list(range(1, 257))


def test_activity_and_supplements(spark):
    rows = spark.createDataFrame([(1, "A", "2024-01-01", False), (2, "a", "2024-01-02", False), (3, "B", "2024-01-01", False), (4, "C", "2024-01-01", False), (5, "C", "2024-01-01", False), (6, "D", "2024-01-01", True)], "registry_id long, site string, t string, supplemental boolean")
    rows = rows.withColumn("observed_at", F.to_timestamp("t")).withColumn("partial", F.lit(False))
    assert {r.site: (r.status, r.current_id, r.baseline_id) for r in E.activity_status(rows).collect()} == {"A": ("ready", 2, 1), "B": ("one-observation", None, None), "C": ("no-comparison", None, None), "D": ("empty", None, None)}
    extra = rows.select("registry_id", F.col("site").alias("site_id"), F.lit(" Net ").alias("network"), "observed_at", "supplemental")
    primaries = spark.createDataFrame([(1, "d", "net"), (2, "x", "NET"), (3, "x", "")], "primary_id long, site_id string, network string")
    assert sorted((r.primary_id, r.registry_id) for r in E.supplements(extra, primaries).collect()) == [(1, 6), (2, 6)]


# kind of what must not be in a text -> texts that hold it, and texts that only come near
UNSAFE = {
    "path": (["/etc/passwd", "see /a", "(/x", "a=/b", "C:\\x", "'d:/y", "\\\\host\\share", "in /a b"], ["a/b", "and / or", "http://x", "C: x", "\\\\host", "1/2"]),
    "secret": (["sk-" + "a1" * 10, "x ghp_" + "A" * 20, "ghr_" + "z" * 25, "AKIA" + "0" * 16, "BEGIN PRIVATE KEY", "-BEGIN OPENSSH PRIVATE KEY", "Password: x", "my api-key =", "APIKEY:", "TOKEN=1"], ["sk-short", "ghx_" + "A" * 20, "AKIA" + "0" * 17, "akia" + "0" * 16, "BEGIN PUBLIC KEY", "passwords: x", "api.key=", "token x"]),
    "raw evidence": (["<?xml version", "<XML>", "<nmaprun x", "<host>", "PCAP  global header", "xpcapng global header", "Starting Nmap 7", "nmap scan report for x", "port state service", "raw packets sent", "IP a > b", "x tcp 1.2 > 3", "UDP a  >"], ["<xmlx>", "<hosts>", "restarting nmap", "pcap header", "IP >", "ip-a > b", "IPX a > b", "TCP " + "a" * 161 + " >", "port state services"]),
}


def test_unsafe_texts_by_kind(spark):
    rows = [(kind, t, bad) for kind, (yes, no) in UNSAFE.items() for texts, bad in ((yes, True), (no, False)) for t in texts]
    df = spark.createDataFrame(rows, "kind string, t string, bad boolean")
    for r in df.select("*", Y.is_unsafe("t").alias("got"), *[F.col("t").rlike(p).alias(f"is_{k.split()[0]}") for k, p in Y.UNSAFE.items()]).collect():
        assert r.got == r.bad and r[f"is_{r.kind.split()[0]}"] == r.bad, r


def test_unsafe_ids(spark):
    ids = {"nmaprun": "x", "a.pcap global header": "x", "pcapng-global_header": "x", "host:address.addr-1": "x", "port  state??service": "x", "nmapruns": "nmapruns", "my host address": "my-host-address", "/srv/a": "x", "": "x", "a" * 130: "a" * 120}
    got = spark.createDataFrame(list(ids.items()), "i string, want string").select("want", Y.safe_id("i", "x").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_supplement_counts_equal_the_pairs(spark):
    shape = "id int, site_id string, network string"
    sites, names = ["A", "a", "b", None], ["Net", " net ", "other", "", None]
    rows = spark.createDataFrame([(i, sites[i % 4], names[i % 5]) for i in range(60)], shape)
    entries = rows.selectExpr("id as registry_id", "site_id", "network", "timestamp_seconds(id) as observed_at", "id % 3 = 0 as supplemental")
    primaries = rows.filter("id % 3 <> 0").withColumnRenamed("id", "primary_id")
    pairs = {r.primary_id: (r.n, r.t) for r in E.supplements(entries, primaries).groupBy("primary_id").agg(F.count("*").alias("n"), F.max("observed_at").alias("t")).collect()}
    for r in E.supplement_counts(entries, primaries).collect():
        assert (r.n_supplements, r.newest) == pairs.get(r.primary_id, (0, None))
