"""Keys that devices of two observations are matched by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col, identity_text, mac
from .evidence import hashed_mac

_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|0?\\d\\d?|00\\d)"
_FOUR = r"(?:^|[^0-9])\d{1,3}[._-]\d{1,3}[._-]\d{1,3}[._-]\d{1,3}(?=$|[^0-9])"


def holds_ipv4(text: Column | str) -> Column:
    """Whether a text holds four numbers up to 255 with points, underscores or hyphens between, and no digit beside."""
    found = F.regexp_extract_all(col(text), F.lit(_FOUR), F.lit(0))
    return F.exists(found, lambda x: x.rlike(rf"^[^0-9]?{_OCTET}(?:[._-]{_OCTET}){{3}}$"))


def holds_ipv6(text: Column | str) -> Column:
    """Whether a run of hex digits and colons in a text looks like an address: shortened by ::, or three parts or more of up to four digits."""
    runs = F.split(F.lower(col(text)), "[^0-9a-f:]+")
    return F.exists(runs, lambda x: F.when(x.contains("::"), x.rlike("[0-9a-f]")).otherwise(x.rlike("^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){2,}$")))


def explicit_id(device_id: Column | str) -> Column:
    """The id that somebody gave a device: not empty, not generated, not made of an address; else null."""
    text = identity_text(device_id)
    return F.when((text != "") & ~text.rlike("^dev-(?:[a-f0-9]{12}|unknown)$") & ~holds_ipv4(text) & ~holds_ipv6(text), text)


def _sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def with_keys(devices: DataFrame) -> DataFrame:
    """devices with the arrays ids, macs, hashed, names and ips of keys, each sorted and without repeats.

    devices: (device_id, macs, hostnames, vendors, ips, evidence); evidence is
    an array of (kind, value).  MACs come from the field and from evidence;
    names are each host name with each vendor.  A null array is empty.
    """
    held = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    told = F.transform(F.filter(F.coalesce("evidence", F.array().cast(devices.schema["evidence"].dataType)), lambda e: e["kind"] == "mac-address"), lambda e: e["value"])
    text = lambda c: _sorted(F.transform(held(c), lambda x: identity_text(x)))
    product = F.flatten(F.transform(text("hostnames"), lambda h: F.transform(text("vendors"), lambda v: F.concat(h, F.lit("|"), v))))
    found = F.filter(F.array(explicit_id("device_id")), lambda x: x.isNotNull())
    return devices.select(
        *[c for c in devices.columns if c not in ("macs", "ips", "ids", "hashed", "names")], found.alias("ids"),
        _sorted(F.transform(F.concat(held("macs"), told), lambda x: mac(x, upper=False))).alias("macs"), _sorted(F.transform(told, lambda x: hashed_mac(x))).alias("hashed"),
        _sorted(product).alias("names"), text("ips").alias("ips"),
    )
