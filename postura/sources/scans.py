"""Scan artifacts: XML reports, host lists, neighbour tables, metadata, inventories, archives."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import folder_name, is_ipv4, js_int, mac

_SCAN = """host array<struct<
  status: struct<_state: string>,
  address: array<struct<_addr: string, _addrtype: string, _vendor: string>>,
  hostnames: struct<hostname: array<struct<_name: string>>>,
  ports: struct<port: array<struct<_protocol: string, _portid: string, state: struct<_state: string>, service: struct<_name: string, _product: string, _version: string>>>>>>"""
#: Artifacts of a run folder by label and name pattern (* at the end: any ending).
KEY_FILES = (
    ("ports", "ports_*"), ("http_titles", "http_titles_*"), ("infra", "infra_services_*"), ("gateway", "gateway_*"),
    ("discovery", "discovery_*"), ("hosts_up", "hosts_up.txt"), ("arp_snapshot", "arp_*"),
)
MAX_XML_BYTES = 5 << 20


def xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml): whole files; Spark skips files without a byte."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("xml"))


def scan_hosts(documents: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(file, error, host_ord, host): hosts that are not down; a file that is no scan, or longer than max_bytes, gives one row with an error."""
    shaped = F.coalesce(F.col("xml").rlike(r"^\s*(<\?xml[^>]*\?>\s*)?(<!DOCTYPE[^>]*>\s*)?(<!--.*?-->\s*|<\?[^>]*\?>\s*)*<nmaprun[\s/>]"), F.lit(False)) & F.col("xml").rlike(r"(</nmaprun>|<nmaprun[^>]*/>)\s*$")
    long = F.octet_length("xml") > F.lit(max_bytes) if max_bytes else F.lit(False)
    error = F.when(long, "too large").when(~shaped, "not a scan report")
    parsed = documents.withColumn("error", error).withColumn("_x", F.when(F.col("error").isNull(), F.from_xml("xml", _SCAN, {"attributePrefix": "_"})))
    rows = parsed.select("file", "error", F.posexplode_outer("_x.host").alias("host_ord", "host"))
    return rows.filter(F.col("error").isNotNull() | F.coalesce(F.col("host.status._state") == "up", F.col("host").isNotNull()))


def findings(documents: DataFrame) -> DataFrame:
    """(file, ord, ip, hostname, protocol, port, state, service, product, version): a row a port of any state."""
    hosts = scan_hosts(documents).filter(F.col("error").isNull())
    four = F.filter("host.address", lambda a: a["_addrtype"] == "ipv4")
    rows = hosts.select("file", "host_ord", F.get(four, F.lit(0))["_addr"].alias("ip"), F.get("host.hostnames.hostname", F.lit(0))["_name"].alias("hostname"), F.posexplode("host.ports.port").alias("port_ord", "p"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "file", (F.col("host_ord").cast("long") * 65536 + F.col("port_ord")).alias("ord"), text(F.col("ip")).alias("ip"), text(F.col("hostname")).alias("hostname"),
        text(F.col("p._protocol")).alias("protocol"), F.coalesce(js_int("p._portid"), F.lit(0)).alias("port"), text(F.col("p.state._state")).alias("state"),
        text(F.col("p.service._name")).alias("service"), text(F.col("p.service._product")).alias("product"), text(F.col("p.service._version")).alias("version"),
    )


def host_records(documents: DataFrame) -> DataFrame:
    """(file, host_ord, ips, macs, vendors, hostnames, open_ports): hosts with something to tell, for merging.

    Files above MAX_XML_BYTES are told by scan_hosts(documents, MAX_XML_BYTES).
    """
    hosts = scan_hosts(documents, MAX_XML_BYTES).filter(F.col("error").isNull())
    kind = lambda k: F.filter(F.coalesce("host.address", F.array().cast("array<struct<_addr:string,_addrtype:string,_vendor:string>>")), lambda a: a["_addrtype"] == k)
    ports = F.filter("host.ports.port", lambda p: (p["state"]["_state"] == "open") & p["_portid"].try_cast("int").between(0, 65535))
    rows = hosts.select(
        "file", "host_ord", F.array_distinct(F.transform(kind("ipv4"), lambda a: a["_addr"])).alias("ips"), F.array_distinct(F.transform(kind("mac"), lambda a: mac(a["_addr"]))).alias("macs"),
        F.array_distinct(F.filter(F.transform(kind("mac"), lambda a: a["_vendor"]), lambda v: v.isNotNull())).alias("vendors"),
        F.array_distinct(F.filter(F.transform("host.hostnames.hostname", lambda h: h["_name"]), lambda n: n != "")).alias("hostnames"),
        F.transform(ports, lambda p: F.struct(p["_protocol"].alias("protocol"), p["_portid"].cast("int").alias("port"), p["service"]["_name"].alias("service"))).alias("open_ports"),
    )
    return rows.filter((F.size("ips") > 0) | (F.size("macs") > 0) | (F.coalesce(F.size("hostnames"), F.lit(0)) > 0))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿|\r$", "").alias("line"))


def hosts_up(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """Host lists: "count" keeps every line that is no comment, "loose" distinct address-like ones, "strict" distinct addresses at a line's start."""
    live = rows.filter(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    if mode == "count":
        return live.select("file", F.trim("line").alias("ip"))
    if mode == "loose":
        return live.filter(F.col("line").rlike(r"\d+\.\d+\.\d+\.\d+")).select("file", F.trim("line").alias("ip")).distinct()
    return live.select("file", F.split(F.trim("line"), r"\s+")[0].alias("ip")).filter(is_ipv4("ip")).distinct()


def arp_pairs(rows: DataFrame) -> DataFrame:
    """(file, ip, mac): neighbour tables of any layout."""
    hit = rows.select("file", F.regexp_extract("line", r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])", 1).alias("ip"), F.regexp_extract("line", r"(?i)\b((?:[0-9a-f]{1,2}[:-]){5}[0-9a-f]{1,2}|(?:[0-9a-f]{4}\.){2}[0-9a-f]{4})\b", 1).alias("m"))
    padded = F.when(F.col("m").contains("."), F.col("m")).otherwise(F.array_join(F.transform(F.split("m", "[:-]"), lambda x: F.lpad(x, 2, "0")), ":"))
    return hit.filter((F.col("m") != "") & is_ipv4("ip")).select("file", "ip", mac(padded).alias("mac")).distinct()


#: Names of one metadata field, the first that is there wins.
METADATA = {
    "target": ("target", "targets", "subnet", "range"), "collector_host": ("collectorHost", "collector_host", "hostname", "host"),
    "started_at": ("startedAt", "started_at", "start"), "ended_at": ("endedAt", "ended_at", "end"), "script_version": ("scriptVersion", "script_version", "version"),
}


def scan_metadata(documents: DataFrame, column: str = "json") -> DataFrame:
    """documents with the metadata fields of a JSON object; arrays are joined by commas."""
    v = F.try_parse_json(column)
    one = lambda k: F.coalesce(F.array_join(F.try_variant_get(v, f"$.{k}", "array<string>"), ","), F.try_variant_get(v, f"$.{k}", "string"))
    return documents.select("*", *[F.coalesce(*[F.when(one(k) != "", one(k)) for k in names]).alias(field) for field, names in METADATA.items()])


def key_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, label, names) of run folders' artifacts by pattern."""
    name = F.element_at(F.split(path, "/"), -1)
    hit = lambda p: name.startswith(p[:-1]) if p.endswith("*") else name == p
    label = F.coalesce(*[F.when(hit(p), F.lit(k)) for k, p in KEY_FILES])
    rows = files.select(F.element_at(F.split(path, "/"), -2).alias("folder"), label.alias("label"), name.alias("name")).filter(F.col("label").isNotNull())
    return rows.groupBy("folder", "label").agg(F.sort_array(F.collect_set("name")).alias("names"))


def run_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, timestamp, run_type, network) of folders under a rawscans folder, newest first."""
    parts = F.split(path, "/")
    rows = files.select(F.element_at(parts, -2).alias("folder"), F.coalesce(F.try_element_at(parts, F.lit(-3)), F.lit("")).alias("above"), F.try_element_at(parts, F.lit(-4)).alias("network"))
    rows = rows.withColumn("n", folder_name("folder")).filter(F.col("n").isNotNull() & (F.col("above") == "rawscans")).select("folder", "n.*", "network").distinct()
    return rows.orderBy(F.desc_nulls_last("timestamp"), "folder")


#: Names of an inventory's columns, looked for in this order.
INVENTORY = {
    "device": ("device", "name"), "mac": ("macaddress", "mac"), "vendor": ("vendor", "manufacturer"), "ip": ("ipaddress", "ip"),
    "hostnames": ("hostnames", "hostname", "host"), "status": ("status",), "notes": ("notes", "comment"), "security": ("securityrecs", "security"),
}
MAX_ROWS = 5000
MAX_CSV_BYTES = 1 << 20


def inventory_columns(header: list[str]) -> dict[str, int]:
    """Field -> place: an alias equals a header or is part of it; alias by alias, the first header wins."""
    plain = [re.sub("[^a-z0-9]", "", h.lower()) for h in header]
    found = {}
    for field, names in INVENTORY.items():
        for alias in names:
            at = next((i for i, h in enumerate(plain) if h == alias or alias in h), None)
            if at is not None:
                found[field] = at
                break
    return found


def inventory_rows(spark: SparkSession, path: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_CSV_BYTES) -> DataFrame:
    """(file, line, device, mac, vendor, ip, hostnames, status, notes, security, error): rows with an address or MAC.

    The first line of a file with any value is its header, so files of one
    path may order their columns differently.  A file above a limit gives one
    row with an error and no other; the limits make it small, so each is read
    whole in one task.
    """
    import pandas as pd

    columns = ["file", "line", *INVENTORY, "error"]

    def parsed(batches):
        import csv
        import io

        for pdf in batches:
            for where, size, content in zip(pdf["path"], pdf["length"], pdf["content"]):
                error, rows = None, []
                if size > max_bytes:
                    error = "too large"
                else:
                    lines = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig", "replace"), newline=""), skipinitialspace=True)
                    live = [[v.strip() for v in x] for x in lines if any(v.strip() for v in x)]
                    if len(live) - 1 > max_rows:
                        error = "too many rows"
                    elif live:
                        at = inventory_columns(live[0])
                        for n, x in enumerate(live[1:]):
                            row = {k: x[at[k]] if k in at and at[k] < len(x) else "" for k in INVENTORY}
                            if row["ip"] or row["mac"]:
                                rows.append({"file": where, "line": n} | row)
                if error:
                    rows = [{"file": where, "error": error}]
                yield pd.DataFrame(rows, columns=columns).astype({"line": "Int64"} | dict.fromkeys([c for c in columns if c != "line"], object))

    files = spark.read.format("binaryFile").load(path)
    # content of a file above the limit isn't sent to Python
    files = files.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    rows = files.mapInPandas(parsed, "file string, line long, " + ", ".join(f"{k} string" for k in INVENTORY) + ", error string")
    status = F.when(F.col("status") == "", "unknown").otherwise(F.col("status"))
    return rows.withColumn("mac", mac("mac", invalid="keep")).withColumn("status", status)


def inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, device, mac, vendor, ip, hostnames, status, notes, security) of inventory_rows without errors; ord follows the file's name and line."""
    rows = inventory_rows(spark, path).filter(F.col("error").isNull())
    return rows.select(F.struct("file", "line").alias("ord"), *INVENTORY)


def archive_members(spark: SparkSession, path: str, max_entries: int = 2000, max_bytes: int = 250 << 20) -> DataFrame:
    """(archive, name, content, error): members of ZIP files; an archive that breaks a limit or leaves its folder gives one row with an error, a member that can't be read one of its own.

    An archive can't be split, so each is opened in the task that reads it;
    members stream out one by one.
    """
    import pandas as pd

    def opened(batches):
        import io
        import zipfile
        import zlib

        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    members = [m for m in z.infolist() if not m.is_dir()]
                    names = [m.filename.replace("\\", "/") for m in members]
                    if len(members) > max_entries:
                        raise ValueError("too many entries")
                    if sum(m.file_size for m in members) > max_bytes:
                        raise ValueError("too large")
                    if any(n.startswith("/") or re.match("^[A-Za-z]:", n) or ".." in n.split("/") for n in names):
                        raise ValueError("unsafe path")
                except (ValueError, zipfile.BadZipFile) as e:
                    yield pd.DataFrame([{"archive": where, "name": None, "content": None, "error": str(e)}])
                    continue
                for n, m in zip(names, members):
                    content = error = None
                    try:
                        content = z.read(m)
                    except (RuntimeError, NotImplementedError, OSError, EOFError, zlib.error, zipfile.BadZipFile) as e:  # a password, an unknown method, damage
                        error = str(e) or type(e).__name__
                    yield pd.DataFrame([{"archive": where, "name": n, "content": content, "error": error}])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(opened, "archive string, name string, content binary, error string")
