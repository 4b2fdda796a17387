import random
import shutil
import struct

import pytest
from pyspark.sql import functions as F

from postura.sources import capture_source as C
from postura.sources import captures
from tests.test_sources import frames, pcap, pcapng


def payloads(n, seed=1):
    """Frames of many lengths; some hold what looks like records of a capture."""
    rng = random.Random(seed)
    inner = b"".join(struct.pack("<IIII", 1005, 7, 20, 20) + bytes(20) for _ in range(20))
    for k in range(n):
        f = rng.choice(frames())
        yield f + (inner if k % 17 == 0 else rng.randbytes(rng.randint(0, 700)) if k % 5 else bytes(rng.randint(0, 300)))


def classic(n, order="<", magic=0xA1B2C3D4, step=1):
    out = [struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1)]
    for k, f in enumerate(payloads(n)):
        out.append(struct.pack(order + "IIII", 1000 + k * step, k % 1000, len(f), len(f)) + f)
    return b"".join(out)


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def blocks(n, late=False, orders="<"):
    """late: another interface, and with two orders another section, in the middle."""
    out = []
    each = list(payloads(n))
    for s, order in enumerate(orders):
        out += [block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order), block(1, struct.pack(order + "HHI", 1, 0, 0), order)]
        own = each[s * n // len(orders) : (s + 1) * n // len(orders)]
        for k, f in enumerate(own):
            if late and k == len(own) // 3:
                out.append(block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 9), order))
            link = 1 if late and k > len(own) // 2 else 0
            t = (1000 + k) * 10**6
            out.append(block(3, struct.pack(order + "I", len(f)) + f, order) if k % 50 == 7 else block(6, struct.pack(order + "IIIII", link, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f, order))
    return b"".join(out)


def rows(df):
    return sorted(tuple(r) for r in df.drop("capture").collect())


KINDS = {
    "classic": classic(1500), "other order": classic(1200, ">"), "nanoseconds": classic(900, "<", 0xA1B23C4D), "cut": classic(1500)[:-11], "blocks": blocks(1500), "blocks cut": blocks(1500)[:-9],
    "late interface": blocks(1500, late=True), "two sections": blocks(1500, late=True, orders="<>"), "long gaps": classic(400, step=3_000_000),
}


@pytest.mark.parametrize("kind", KINDS)
def test_split_read_equals_the_whole(spark, tmp_path, kind):
    data = KINDS[kind]
    (tmp_path / "c.bin").write_bytes(data)
    whole = C.read_captures(spark, str(tmp_path), split_bytes=0)
    split = C.read_captures(spark, str(tmp_path), split_bytes=30_000, cover_bytes=4000)
    assert split.rdd.getNumPartitions() > 5 or kind == "two sections"
    assert rows(split) == rows(whole)
    plain = [r[2:] for r in captures.packets("x", data)]
    assert [r[1:] for r in rows(whole)] == plain and len(plain) > 300
    reports = [C.capture_report(C.capture_rows(spark, str(tmp_path), s, 4000)).drop("capture").first() for s in (0, 30_000)]
    assert reports[0] == reports[1] and reports[0].truncated == kind.endswith("cut")


def test_damage_in_the_middle_is_read_as_a_whole(spark, tmp_path):
    data = bytearray(classic(1500))
    at = 24
    for _ in range(700):
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    struct.pack_into("<I", data, at + 8, 0x7FFFFF00)
    (tmp_path / "c.pcap").write_bytes(data)
    whole, split = (C.read_captures(spark, str(tmp_path), s, 4000) for s in (0, 30_000))
    assert rows(split) == rows(whole) and whole.count() == 700
    with pytest.raises(Exception, match="no record starts at"):
        spark.read.format("capture").options(path=str(tmp_path), splitBytes=30_000, coverBytes=4000).load().count()


def test_late_interfaces_need_the_walk(spark, tmp_path):
    (tmp_path / "c.pcapng").write_bytes(KINDS["late interface"])
    spark.dataSource.register(C.CaptureSource)
    with pytest.raises(Exception, match="interfaces are named after its head"):
        spark.read.format("capture").options(path=str(tmp_path), splitBytes=30_000, coverBytes=4000).load().count()
    assert spark.read.format("capture").options(path=str(tmp_path), splitBytes=0).load().filter("ord is not null").count() == 1500


def test_folders_patterns_and_files_that_are_none(spark, tmp_path):
    for name, data in (("a.pcap", pcap()), ("b.pcapng", pcapng()), ("none.pcap", b"garbage garbage garbage garbage"), ("empty.pcap", b""), ("head.pcap", pcap()[:24]), ("_hidden.pcap", pcap())):
        (tmp_path / name).write_bytes(data)
    got = {r.capture.rsplit("/")[-1]: (r.packets, r.ignored, r.truncated, r.error) for r in C.capture_report(C.capture_rows(spark, str(tmp_path))).collect()}
    assert got == {"a.pcap": (4, 0, False, None), "b.pcapng": (4, 0, False, None), "none.pcap": (0, 0, False, "not a capture"), "empty.pcap": (0, 0, False, "not a capture"), "head.pcap": (0, 0, False, None)}
    assert C.read_captures(spark, f"{tmp_path}/*.pcapng").count() == 4 == C.read_captures(spark, f"file://{tmp_path}/a.pcap").count()
    with pytest.raises(Exception, match="nowhere"):
        C.read_captures(spark, f"{tmp_path}/nowhere").count()


@pytest.mark.parametrize("kind", ["classic", "late interface"])
def test_stream_reads_each_packet_once_as_files_grow(spark, tmp_path, kind):
    data, held = KINDS[kind], tmp_path / "in"
    held.mkdir()
    for step, cut in enumerate((5, 1000, len(data) // 2 + 3, len(data) // 2 + 9, len(data))):
        (held / "c.bin").write_bytes(data[:cut])
        if step == 2:
            (held / "d.bin").write_bytes(pcap())
        q = C.capture_stream(spark, str(held)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("truncated").isEmpty()
    (tmp_path / "whole").mkdir()
    shutil.copy(held / "c.bin", tmp_path / "whole")
    assert rows(got.filter(F.col("capture").endswith("c.bin"))) == rows(C.read_captures(spark, str(tmp_path / "whole"), 0))
    assert got.filter(F.col("capture").endswith("d.bin")).count() == 4
