import io
import struct
import zipfile

from pyspark.sql import functions as F

from postura.operators import orders as O
from postura.sources import ingest as G
from tests.test_sources import SCAN, write

RUN = "2026-04-01_1200_baseline"


def archive(files, damage=None):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for name, content in files.items():
            f.writestr(name, content)
    data = bytearray(z.getvalue())
    if damage:
        at = data.index(damage.encode()) + len(damage) + 5
        data[at] ^= 0xFF
    return bytes(data)


def test_archives_to_findings(spark, tmp_path):
    write(tmp_path, "a.zip", archive({f"home/rawscans/{RUN}/ports_top.xml": SCAN, f"home/rawscans/{RUN}/a.xml": "<nmaprun/>", f"home/rawscans/{RUN}/hosts_up.txt": "192.0.2.9\r\nx\n", "home/rawscans/notes/x.xml": SCAN, f"elsewhere/{RUN}/x.xml": SCAN}))
    write(tmp_path, "b.zip", archive({f"deep/down/{RUN}/b.xml": SCAN, f"deep/down/{RUN}/a.txt": "x", "2026-05-01_0000_empty/readme": "x", "no/run.xml": SCAN}))
    write(tmp_path, "c.zip", archive({f"rawscans/{RUN}/ports_1.txt": "x", f"rawscans/{RUN}/sub/y.xml": SCAN}))
    found, ports, errors = G.ingest(spark, str(tmp_path))
    short = lambda rows: {(r.archive.rsplit("/")[-1], r.run_path, r.network) for r in rows.collect()}
    assert short(found) == {("a.zip", f"home/rawscans/{RUN}", "home"), ("b.zip", f"deep/down/{RUN}", None), ("c.zip", f"rawscans/{RUN}", None)}
    reports = {r.report for r in ports.collect()}
    assert reports == {"ports_top.xml", "b.xml"} and errors.isEmpty()
    members = G.extracted(spark, str(tmp_path))
    hosts = {(r.archive.rsplit("/")[-1], r.ip) for r in G.run_hosts(members, found, ports).collect()}
    assert ("a.zip", "192.0.2.9") in hosts and ("a.zip", "x") not in hosts and {a for a, _ in hosts} == {"a.zip", "b.zip"} and len(hosts) >= 2
    files = {(r.archive.rsplit("/")[-1], r.label): r.files for r in G.run_files(members, found).collect()}
    assert files[("a.zip", "ports")] == ["ports_top.xml"] and files[("c.zip", "ports")] == ["ports_1.txt"]


def test_damaged_and_locked_members_are_error_rows(spark, tmp_path):
    good = f"home/rawscans/{RUN}/ports_top.xml"
    write(tmp_path, "a.zip", archive({good: SCAN, "home/bad.txt": "some text " * 50}, damage="home/bad.txt"))
    locked = bytearray(archive({"secret.txt": "x"}))
    for sign, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the flag that says a password is needed
        k = locked.index(sign) + at
        struct.pack_into("<H", locked, k, struct.unpack_from("<H", locked, k)[0] | 1)
    write(tmp_path, "b.zip", bytes(locked))
    write(tmp_path, "c.zip", "no zip")
    found, ports, errors = G.ingest(spark, str(tmp_path))
    assert {(r.archive.rsplit("/")[-1], r.name) for r in errors.collect()} == {("a.zip", "home/bad.txt"), ("b.zip", "secret.txt"), ("c.zip", None)}
    assert found.count() == 1 and ports.count() > 0


def test_nothing_to_ingest(spark):
    members = spark.createDataFrame([], "archive string, name string, content binary, error string")
    found = G.runs(members)
    assert found.count() == G.run_findings(members, found).count() == G.run_files(members, found).count() == 0


def test_orders_by_language(spark):
    words = ["b", "A", "a", "é", "E", "e", "_", "Z", "ä", "", "a"]
    rows = spark.createDataFrame([("g", w) for w in words] + [("h", "x")], "g string, w string")
    got = O.in_order(rows, "g", F.col("w")).orderBy("g", "place").collect()
    assert [r.w for r in got if r.g == "g"] == ["", "_", "a", "a", "A", "ä", "b", "e", "E", "é", "Z"] and [r.place for r in got if r.g == "h"] == [1]
    ranked = O.activity_order(spark.createDataFrame([("g", 1, "normal"), ("g", 2, "user-investigate"), ("g", 3, "normal")], "g string, place int, priority string"), "g")
    assert [r.place for r in ranked.orderBy("activity_place").collect()] == [2, 1, 3]
    assert O.in_order(rows.limit(0), "g", F.col("w")).count() == 0
