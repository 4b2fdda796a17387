"""Packet captures as rows: metadata of packets only.

Files come through Spark's binaryFile reader, so any path Spark reads will do,
and each is decoded in the task that reads it.  A damaged tail keeps the
packets before it and marks the last one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from ipaddress import IPv4Address, IPv6Address

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .capture_records import Held, Walk, layout, walk

SCHEMA = (
    "capture string, ord long, ts_ms double, orig_len long, src_mac string, dst_mac string, protocol string, src_ip string, dst_ip string, "
    "src_port int, dst_port int, src_local boolean, dst_local boolean, dst_broadcast boolean, dst_mac_broadcast boolean, dns_name string, dns_kind string, truncated boolean"
)
# Kind of a name question by port.
DNS_KINDS = {53: "dns", 5353: "mdns", 5355: "llmnr"}


def frames(data: bytes) -> Iterator[tuple[float | None, int, bytes] | None]:
    """(milliseconds, original length, bytes) of frames, without bytes if they are not Ethernet; None marks a damaged end."""
    held, told = Held(data), Walk(0)
    shape = layout(held)
    for _, at, whole, place, kept in walk(held, shape, shape.first, held.size, told):
        yield at, whole, data[place : place + kept]
    if told.damaged:
        yield None


def _mac(b: bytes) -> str:
    return ":".join(f"{x:02X}" for x in b)


def _local(ip) -> bool:
    if ip.version == 4:
        v = int(ip)
        return any(v >> 32 - n == int(IPv4Address(net)) >> 32 - n for net, n in (("10.0.0.0", 8), ("127.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16)))
    first = int(ip) >> 112
    return ip == IPv6Address("::1") or 0xFE80 <= first <= 0xFEBF or first >> 9 == 0x7E


def _group(ip) -> bool:
    return (224 <= int(ip) >> 24 <= 239 or int(ip) == 0xFFFFFFFF) if ip.version == 4 else int(ip) >> 120 == 0xFF


def decode(frame: bytes) -> dict | None:
    """What a frame tells; None if it is too short."""
    if len(frame) < 14:
        return None
    out = dict.fromkeys(("src_ip", "dst_ip", "src_port", "dst_port", "dns_name", "dns_kind"))
    out |= {"dst_mac": _mac(frame[:6]), "src_mac": _mac(frame[6:12]), "dst_mac_broadcast": bool(frame[0] & 1), "protocol": "other", "src_local": True, "dst_local": True}
    out["dst_broadcast"] = out["dst_mac_broadcast"]
    at, kind = 14, int.from_bytes(frame[12:14], "big")
    while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
        kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
    rest = frame[at:]
    if kind == 0x0806:
        out |= {"protocol": "arp", "dst_broadcast": True}
        if len(rest) >= 18 and rest[4:6] == b"\x06\x04" and _local(ip := IPv4Address(rest[14:18])):
            out["src_ip"] = str(ip)
        return out
    if kind == 0x0800 and len(rest) >= 20 and rest[0] >> 4 == 4:
        src, dst, proto, body, later = IPv4Address(rest[12:16]), IPv4Address(rest[16:20]), rest[9], rest[(rest[0] & 15) * 4 :], int.from_bytes(rest[6:8], "big") & 0x1FFF > 0
        names = {6: "tcp", 17: "udp", 1: "icmp"}
    elif kind == 0x86DD and len(rest) >= 40:
        src, dst, proto, body, later = IPv6Address(rest[8:24]), IPv6Address(rest[24:40]), rest[6], rest[40:], False
        while proto in (0, 43, 44, 60) and len(body) >= 8:
            if proto == 44:
                later = later or int.from_bytes(body[2:4], "big") >> 3 > 0
                proto, body = body[0], body[8:]
            else:
                proto, body = body[0], body[8 + 8 * body[1] :]
        names = {6: "tcp", 17: "udp", 58: "icmpv6"} if not later else {}
    else:
        return out
    text = (lambda ip: ip.exploded if ip.version == 4 else ":".join(f"{int(x, 16):x}" for x in ip.exploded.split(":")))
    out |= {"src_ip": text(src), "dst_ip": text(dst), "protocol": names.get(proto, "other"), "src_local": _local(src), "dst_local": _local(dst) or _group(dst), "dst_broadcast": out["dst_mac_broadcast"] or _group(dst)}
    if proto in (6, 17) and not later and len(body) >= 4:
        out["src_port"], out["dst_port"] = struct.unpack_from(">HH", body)
        if proto == 17 and out["dst_port"] in DNS_KINDS and (name := question(body[8:])):
            out |= {"dns_name": name, "dns_kind": DNS_KINDS[out["dst_port"]]}
    return out


def question(message: bytes) -> str | None:
    """First name asked for, lower-cased; a compressed one gives none."""
    if len(message) < 13 or message[2] & 0x80 or not int.from_bytes(message[4:6], "big"):
        return None
    at, labels = 12, []
    while at < len(message) and (n := message[at]):
        if n & 0xC0 or at + 1 + n > len(message):
            return None
        labels.append("".join(chr(b) if 32 < b < 127 else "?" for b in message[at + 1 : at + 1 + n]))
        at += 1 + n
    return ".".join(labels).lower() or None


def packets(name: str, data: bytes, report: dict | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA; of a damaged file the last one is marked truncated.

    report, if given, receives packets, ignored (frames too short or not
    Ethernet) and truncated.
    """
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    report = {} if report is None else report
    report |= {"packets": 0, "ignored": 0, "truncated": False}
    held = None
    for f in frames(data):
        if f is None:
            report["truncated"] = True
            if held:
                held["truncated"] = True
            break
        if (row := decode(f[2])) is None:
            report["ignored"] += 1
            continue
        if held:
            yield tuple(held[c] for c in columns)
        held = {"capture": name, "ord": report["packets"], "ts_ms": f[0], "orig_len": f[1], "truncated": False} | row
        report["packets"] += 1
    if held:
        yield tuple(held[c] for c in columns)


def capture_rows(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA with packets, ignored and error: the packets of all captures at a path, and a last row a file without ord that reports on it.

    Each file is decoded in the task that reads it.  One that is no Ethernet
    capture gives its report with an error and no packet.
    """
    import itertools

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = SCHEMA + ", packets long, ignored long, error string"
    arrow = to_arrow_schema(StructType.fromDDL(shape))
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def decoded(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content")):
                name, report, error = name.as_py(), {}, None
                rows = packets(name, data.as_py(), report)
                try:
                    while part := list(itertools.islice(rows, 50_000)):
                        yield pa.RecordBatch.from_pylist([dict(zip(columns, x)) for x in part], schema=arrow)
                except ValueError as e:
                    error = str(e)
                yield pa.RecordBatch.from_pylist([{"capture": name, "error": error} | report], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decoded, shape)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all captures at a path; files that are none are told by capture_report."""
    return capture_rows(spark, path).filter(F.col("ord").isNotNull()).drop("packets", "ignored", "error")


def capture_report(rows: DataFrame) -> DataFrame:
    """(capture, packets, ignored, truncated, error): one row a file, from capture_rows."""
    return rows.filter(F.col("ord").isNull()).select("capture", "packets", "ignored", "truncated", "error")
