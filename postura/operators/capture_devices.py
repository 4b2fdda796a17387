"""Devices of a capture as devices of an observation: evidence of who they are, never an open port."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_of

#: Texts are ours; ids start so that they can't meet those of scans.
DEVICE_PREFIX, EVIDENCE_PREFIX = "dev-ph-", "ev-ph-"


def is_supplement(kinds: Column, vantage: Column, kind: str, prefix: str) -> Column:
    """Whether an observation only supplements others: one of its sources is of a kind, or its vantage starts so; nulls say no."""
    return F.coalesce(F.array_contains(kinds, kind), F.lit(False)) | F.coalesce(vantage.startswith(prefix), F.lit(False))


def _evidence(kind: str, value: Column, source: str, confidence: str) -> Column:
    name = F.concat(F.lit(EVIDENCE_PREFIX), F.substring(F.sha2(F.concat(F.lit(f"{kind}|"), value), 256), 1, 12))
    return F.struct(name.alias("evidence_id"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(source).alias("source_id"), F.lit(confidence).alias("confidence"))


def observed_devices(devices: DataFrame, source: str = "capture", keep: tuple[str, ...] = ()) -> DataFrame:
    """devices as (columns to keep, device_id, first_seen, last_seen, ips, macs, vendors, hostnames, evidence, open_ports, note).

    devices: (id, mac, vendor, role, ips, packets_sent, packets_received,
    first_seen, last_seen, observed_start, observed_end).  The id comes from
    the canonical JSON of id, addresses and MAC, so the same device of the same
    capture has one id wherever it is worked out.  Null or empty MAC and vendor
    are none; null addresses are left out.
    """
    mac, vendor = F.nullif("mac", F.lit("")), F.nullif("vendor", F.lit(""))
    ips = F.filter(F.coalesce("ips", F.array().cast("array<string>")), lambda x: x.isNotNull())
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    seed = F.struct(F.col("id"), ips.alias("ips"), mac.alias("mac"))
    told = F.concat(F.transform(ips, lambda x: _evidence("ip-address", x, source, "observed")), F.transform(one(mac), lambda x: _evidence("mac-address", x, source, "observed")), F.transform(one(vendor), lambda x: _evidence("vendor", x, source, "reported")))
    packets = F.coalesce("packets_sent", F.lit(0)) + F.coalesce("packets_received", F.lit(0))
    ports = F.array().cast("array<struct<protocol:string,port:int,service:string>>")
    return devices.select(
        *keep, F.concat(F.lit(DEVICE_PREFIX), F.substring(F.sha2(canonical_of(seed), 256), 1, 12)).alias("device_id"), F.coalesce("first_seen", "observed_start").alias("first_seen"), F.coalesce("last_seen", "observed_end").alias("last_seen"),
        ips.alias("ips"), one(mac).alias("macs"), one(vendor).alias("vendors"), F.array().cast("array<string>").alias("hostnames"), told.alias("evidence"), ports.alias("open_ports"),
        F.concat(F.coalesce("role", F.lit("device")), F.lit(" seen in traffic only, "), packets.cast("string"), F.lit(" packets")).alias("note"),
    )
