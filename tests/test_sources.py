import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from postura.operators import findings as P
from postura.operators import identity as I
from postura.operators import observations as T
from postura.operators import traffic as N
from postura.operators.tables import ConcurrentChange, KeyedTable
from postura.sources import captures, scans, sinks

SCAN = """<?xml version="1.0"?><nmaprun><host><status state="up"/><address addr="192.0.2.5" addrtype="ipv4"/><address addr="02:00:00:aa:bb:cc" addrtype="mac" vendor="Acme &amp; Co"/>
<hostnames><hostname name="nas"/></hostnames><ports><port protocol="tcp" portid="80"><state state="open"/><service name="http" product="x" version="1"/></port>
<port protocol="tcp" portid="23"><state state="closed"/></port><port protocol="tcp" portid="zz"><state state="open"/></port></ports></host>
<host><status state="down"/><address addr="192.0.2.6" addrtype="ipv4"/><ports><port protocol="tcp" portid="22"><state state="open"/></port></ports></host>
<host><address addr="192.0.2.7" addrtype="ipv4"/><ports><port protocol="udp" portid="53"><state state="open"/></port></ports></host></nmaprun>"""


def write(tmp_path, name, content):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def test_scan_reports(spark, tmp_path):
    write(tmp_path, "a.xml", SCAN)
    write(tmp_path, "b.xml", "<other/>")
    write(tmp_path, "c.xml", " ")
    docs = scans.xml_documents(spark, str(tmp_path))
    rows = scans.findings(docs).orderBy("ord").collect()
    assert [(r.ip, r.hostname, r.protocol, r.port, r.state, r.service) for r in rows] == [
        ("192.0.2.5", "nas", "tcp", 80, "open", "http"), ("192.0.2.5", "nas", "tcp", 23, "closed", ""), ("192.0.2.5", "nas", "tcp", 0, "open", ""), ("192.0.2.7", "", "udp", 53, "open", "")]
    assert scans.scan_hosts(docs).filter("error is not null").count() == 2
    assert [r.error for r in scans.scan_hosts(docs, 100).filter("file like '%a.xml'").collect()] == ["too large"]
    (one, two) = scans.host_records(docs).orderBy("host_ord").collect()
    assert one.macs == ["02:00:00:AA:BB:CC"] and one.vendors == ["Acme & Co"] and [p.port for p in one.open_ports] == [80] and two.ips == ["192.0.2.7"]
    assert [r.port for r in P.top_ports(P.open_ports(scans.findings(docs)), 2).collect()] == [0, 53]


def test_text_artifacts(spark, tmp_path):
    lines = scans.lines(spark, write(tmp_path, "hosts_up.txt", "﻿192.0.2.1 up\r\n# c\n\n192.0.2.1\n300.1.1.1\nname\n"))
    assert scans.hosts_up(lines, "count").count() == 4 and scans.hosts_up(lines, "loose").count() == 3
    assert [r.ip for r in scans.hosts_up(lines).collect()] == ["192.0.2.1"]
    arp = scans.lines(spark, write(tmp_path, "arp.txt", "  192.0.2.9   02-00-00-aa-bb-cc  dynamic\n? (192.0.2.8) at 2:0:0:a:b:c [ether]\nInternet 192.0.2.7 5 0200.00aa.bbcc ARPA\n192.0.2.3 none\n"))
    assert {(r.ip, r.mac) for r in scans.arp_pairs(arp).collect()} == {("192.0.2.9", "02:00:00:AA:BB:CC"), ("192.0.2.8", "02:00:00:0A:0B:0C"), ("192.0.2.7", "02:00:00:AA:BB:CC")}
    meta = scans.scan_metadata(spark.createDataFrame([('{"targets":["a","b"],"host":"h","started_at":"x"}',), ("{bad",)], "json string")).collect()
    assert (meta[0].target, meta[0].collector_host, meta[0].started_at, meta[0].ended_at) == ("a,b", "h", "x", None) and meta[1].target is None


def test_folders_and_archives(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("home/rawscans/2026-04-01_1200_baseline/ports_top200_open.xml", SCAN)
        f.writestr("home/rawscans/2026-04-01_1200_baseline/hosts_up.txt", "192.0.2.1")
        f.writestr("home/rawscans/notarun/hosts_up.txt", "x")
    write(tmp_path, "good.zip", z.getvalue())
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as f:
        f.writestr("../evil", "x")
    write(tmp_path, "bad.zip", bad.getvalue())
    write(tmp_path, "broken.zip", "no zip")
    members = scans.archive_members(spark, str(tmp_path)).cache()
    assert sorted(r.error for r in members.filter("error is not null").collect()) == ["File is not a zip file", "unsafe path"]
    files = members.filter("error is null").select(F.col("name").alias("path"))
    (run,) = scans.run_folders(files).collect()
    assert (run.run_type, run.network, str(run.timestamp)) == ("baseline", "home", "2026-04-01 12:00:00")
    assert {(r.label, tuple(r.names)) for r in scans.key_files(files).filter("folder like '2026%'").collect()} == {("ports", ("ports_top200_open.xml",)), ("hosts_up", ("hosts_up.txt",))}


def test_inventory(spark, tmp_path):
    path = write(tmp_path, "i.csv", '\n,,,\nDevice,MAC Address,Vendor,IP Address,Hostnames,Status,Notes\nNas,02-00-00-aa-bb-cc,"Acme, Inc",192.0.2.5,nas,,"say ""hi"""\n,,,,,,\nX,,,,,,\nY,odd,,192.0.2.6,,active,\n')
    rows = scans.inventory_csv(spark, path).orderBy("ord").collect()
    assert [(r.device, r.mac, r.vendor, r.ip, r.status, r.notes) for r in rows] == [("Nas", "02:00:00:AA:BB:CC", "Acme, Inc", "192.0.2.5", "unknown", 'say "hi"'), ("Y", "odd", "", "192.0.2.6", "active", "")]
    write(tmp_path, "inv/a.csv", "IP,Device\n192.0.2.1,A\n")
    write(tmp_path, "inv/b.csv", "Device,IP\nB,192.0.2.2\nIP,Device\n")
    write(tmp_path, "inv/c.csv", "IP\n" + "192.0.2.3\n" * 5001)
    write(tmp_path, "inv/d.csv", "IP\n192.0.2.4," + "x" * (1 << 20))
    rows = scans.inventory_rows(spark, str(tmp_path / "inv")).collect()
    assert {(r.file.rsplit("/")[-1], r.device, r.ip, r.error) for r in rows} == {("a.csv", "A", "192.0.2.1", None), ("b.csv", "B", "192.0.2.2", None), ("b.csv", "IP", "Device", None), ("c.csv", None, None, "too many rows"), ("d.csv", None, None, "too large")}


A, B, R = bytes.fromhex("020000000001"), bytes.fromhex("020000000002"), bytes.fromhex("0200000000ff")


def ipv4(src, dst, proto, body):
    addr = lambda x: bytes(map(int, x.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + addr(src) + addr(dst) + body


def frames():
    ask = b"\0\1\0\0\0\1\0\0\0\0\0\0\7Example\3com\0\0\1\0\1"
    return [
        R + A + b"\x08\0" + ipv4("192.168.1.10", "203.0.113.34", 6, struct.pack(">HH", 51000, 443) + bytes(16)),
        A + R + b"\x08\0" + ipv4("203.0.113.34", "192.168.1.10", 6, struct.pack(">HH", 443, 51000) + bytes(16)),
        R + A + b"\x81\0\0\x05\x08\0" + ipv4("192.168.1.10", "192.168.1.1", 17, struct.pack(">HHHH", 40000, 53, 8 + len(ask), 0) + ask),
        b"\xff" * 6 + B + b"\x08\x06" + bytes.fromhex("0001080006040001") + B + bytes([192, 168, 1, 20]) + bytes(10),
    ]


def pcap(order="<", magic=0xA1B2C3D4):
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1)
    for k, f in enumerate(frames()):
        out += struct.pack(order + "IIII", 1000 + k, 500_000, len(f), len(f)) + f
    return out


def pcapng():
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for k, f in enumerate(frames()):
        t = (1000 + k) * 10**6 + 500_000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f + bytes(-len(f) % 4))
    return out


@pytest.mark.parametrize("data", [pcap(), pcap(">"), pcapng()])
def test_captures(spark, tmp_path, data):
    rows = captures.read_captures(spark, write(tmp_path, "c.pcap", data)).orderBy("ord").collect()
    assert [(r.protocol, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.dst_local, r.dst_broadcast, r.dns_name) for r in rows] == [
        ("tcp", "192.168.1.10", "203.0.113.34", 51000, 443, False, False, None), ("tcp", "203.0.113.34", "192.168.1.10", 443, 51000, True, False, None),
        ("udp", "192.168.1.10", "192.168.1.1", 40000, 53, True, False, "example.com"), ("arp", "192.168.1.20", None, None, None, True, True, None)]
    assert rows[0].ts_ms == 1000500.0 and not any(r.truncated for r in rows)
    cut = list(captures.packets("x", data[:-7]))
    assert len(cut) == 3 and cut[-1][-1] is True
    with pytest.raises(ValueError):
        list(captures.packets("x", b"garbage garbage garbage"))


def test_files_that_are_no_captures(spark, tmp_path):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    radio = pcapng() + block(1, struct.pack("<HHI", 105, 0, 0)) + block(6, struct.pack("<IIIII", 1, 0, 5, 20, 20) + bytes(20))
    for name, data in (("good.pcap", pcap()), ("cut.pcap", pcap()[:-7]), ("none.pcap", b"garbage garbage garbage"), ("radio.pcapng", radio), ("empty.pcap", pcap()[:24])):
        write(tmp_path, name, data)
    rows = captures.capture_rows(spark, str(tmp_path)).cache()
    got = {r.capture.rsplit("/")[-1]: (r.packets, r.ignored, r.truncated, r.error) for r in captures.capture_report(rows).collect()}
    assert got == {"good.pcap": (4, 0, False, None), "cut.pcap": (3, 0, True, None), "none.pcap": (0, 0, False, "not a capture"), "radio.pcapng": (4, 1, False, None), "empty.pcap": (0, 0, False, None)}
    assert rows.filter("ord is not null").count() == 11 == captures.read_captures(spark, str(tmp_path)).count()


def test_flows_of_a_capture(spark, tmp_path):
    packets = captures.read_captures(spark, write(tmp_path, "c.pcap", pcap())).withColumn("ts", F.timestamp_millis(F.col("ts_ms").cast("long")))
    flows = {r.protocol: r for r in N.flows(packets).collect()}
    assert flows["tcp"].packets == 2 and flows["tcp"].bytes_from_initiator == len(frames()[0]) and flows["tcp"].src_ip == "192.168.1.10"
    assert flows["arp"].flow_key.endswith("broadcast#")
    hosts = {r.mac: r for r in N.host_traffic(packets).collect()}
    assert hosts["02:00:00:00:00:01"].packets_sent == 2 and hosts["02:00:00:00:00:01"].external_peers == 1 and "FF:FF:FF:FF:FF:FF" not in hosts
    assert N.gateway(packets).first().mac == "02:00:00:00:00:FF"


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v long, seq long", ["k"])
    t.append_absent(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, v long, seq long"), "seq")
    t.append_absent(spark.createDataFrame([("a", 9, 1), ("c", 4, 1)], "k string, v long, seq long"), "seq")
    t.upsert(spark.createDataFrame([("b", 7, 1)], "k string, v long, seq long"), "seq")
    t.delete(spark.createDataFrame([("c",)], "k string"))
    assert {r.k: r.v for r in t.read().collect()} == {"a": 1, "b": 7}
    late = KeyedTable(spark, str(tmp_path / "t"), "k string, v long, seq long", ["k"])
    seen, rows = late._newest()[0], late.read()
    t.upsert(spark.createDataFrame([("z", 5, 1)], "k string, v long, seq long"), "seq")
    with pytest.raises(ConcurrentChange):
        late.write(rows.limit(0), seen)
    assert {r.k: r.v for r in t.read().collect()} == {"a": 1, "b": 7, "z": 5}


def test_outcomes_equal_pairs(spark):
    import random

    rng = random.Random(3)
    side = lambda p, n: [(f"{p}{i}", [f"m{rng.randrange(14)}" for _ in range(rng.randrange(3))] if i % 4 else [f"u{i}"], [f"n{rng.randrange(40)}"] if i % 3 else None) for i in range(n)]
    shape = "device_id string, macs array<string>, names array<string>"
    b, c = spark.createDataFrame(side("b", 30), shape), spark.createDataFrame(side("c", 25), shape)
    tiers = {"mac": "macs", "hostname-vendor": "names"}
    pairs = I.tiered(b, c, tiers).collect()
    got = {(r.side, r.device_id): r for r in I.outcomes(b, c, tiers).collect()}
    assert {("base", r.base_id) for r in pairs} | {("current", r.current_id) for r in pairs} == set(got)
    assert {r.base_id: r.current_id for r in pairs if r.outcome == "confirmed"} == {d: r.partner_id for (s, d), r in got.items() if s == "base" and r.outcome == "confirmed"}
    for s, key in (("base", "base_id"), ("current", "current_id")):
        for d in {r[key] for r in pairs}:
            assert got[s, d].n_links == sum(len(r.shared) for r in pairs if r[key] == d)
    assert any(r.outcome == "confirmed" for r in pairs) and any(r.outcome == "uncertain" for r in pairs)


def test_known_devices_and_inventory(spark):
    hosts = spark.createDataFrame([("m1", "i1"), ("m1", "i1"), (None, "i2"), (None, None), ("m9", "i9")], "mac string, ip string")
    inv = spark.createDataFrame([(1, "M1", None, "one"), (2, None, "i2", "two")], "ord long, mac string, ip string, item string")
    assert sorted(r.ip for r in I.known(hosts, inv).collect()) == ["i1", "i1", "i2"]
    listed = hosts.select("mac", F.array("ip").alias("ips"))
    assert sorted(str(r.item) for r in I.inventory_match(listed, inv).collect()) == ["None", "None", "one", "one", "two"]


def test_merging_records(spark):
    rows = [(1, ["02:00:00:00:00:01"], ["192.0.2.1"]), (2, None, ["192.0.2.1"]), (3, ["02:00:00:00:00:02"], []), (4, ["02:00:00:00:00:02"], ["192.0.2.9"]), (5, None, None)]
    got = {r.record_id: r.device_id for r in I.merged(spark.createDataFrame(rows, "record_id long, macs array<string>, ips array<string>")).collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(set(got.values())) == 3


def test_capture_coverage_and_week(spark):
    rows = spark.createDataFrame([("mirror-tap", True, 1, False), ("unknown", True, 3, False), (None, False, 0, True)], "vantage string, truncated boolean, ignored_packets long, has_times boolean")
    assert [str(r.score) for r in T.capture_coverage(rows).collect()] == ["0.40", "0.00", "0.25"]
    ob = spark.sql("select timestamp'2026-01-01 12:00:00' as observed_at union all select timestamp'2026-01-07 20:00:00'")
    assert T.weekly_support(ob, *T.day_range("2026-01-01", "2026-01-07"), F.lit(1)).first().weekly


def test_report(spark):
    rows = spark.createDataFrame([(1, "192.0.2.1", "tcp", 23, "P0", "a*b"), (2, "192.0.2.2", "tcp", 80, "P2", "x,\"y\"")], "ord long, ip string, protocol string, port int, risk string, reason string")
    text = sinks.document([("# Watch", sinks.watch_list(rows)), ("# CSV", sinks.csv_lines(rows, ["ip", "reason"]).withColumn("ord", F.monotonically_increasing_id()))]).first().text
    assert text == '# Watch\n- **P0** 192.0.2.1 tcp/23: a\\*b\n- **P2** 192.0.2.2 tcp/80: x,"y"\n# CSV\n192.0.2.1,a*b\n192.0.2.2,"x,""y"""'
