"""JSON documents from outside: observation bundles and saved analyses.

Documents are VARIANT columns, so a value of another JSON type than the field's
counts as absent and is not cast.  Everything is taken field by field; what has
no field here goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safety as Y
from ..functions.scalar import is_ipv4, mac

# Limits of a bundle, and names that its fields may hold.
MAX_BUNDLE_BYTES, MAX_SOURCES, MAX_DEVICES, MAX_EVIDENCE, MAX_PORTS = 1 << 20, 50, 1000, 40, 256
BUNDLE_VERSION = r"observation-bundle\.v1$"
SOURCE_KINDS = ("run-manifest", "nmap-xml", "hosts-up", "arp-snapshot", "scan-metadata")
ANALYSIS_KIND = r"^[a-z]+(-[a-z]+)*-analysis$"
EVIDENCE_KINDS = ("ip-address", "mac-address", "hostname", "vendor", "host-up", "arp-neighbor")
CONFIDENCES = ("observed", "reported", "weak")
MINIMAL, COMPLETE = 0.35, 0.85
# Limits of a saved analysis, and names that its fields may hold.
MAX_ANALYSIS_BYTES = 10 << 20
ANALYSIS_LIMITS = {"devices": 600, "externalEndpoints": 300, "flows": 1000, "animationEvents": 1000, "dnsQueries": 500, "alerts": 60}
CATEGORIES = ("dns", "mdns", "llmnr", "ssdp", "http", "https", "quic", "ssh", "smb", "rdp", "arp", "icmp", "other")
PROTOCOLS, LEVELS = ("tcp", "udp", "icmp", "arp", "other"), ("info", "review", "watch")


def json_files(spark: SparkSession, path: str, max_bytes: int = MAX_BUNDLE_BYTES) -> DataFrame:
    """(file, length, json): whole files; json is null above max_bytes, so no long file is read into a row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), "length", F.when(F.col("length") <= max_bytes, F.col("content").cast("string")).alias("json"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column, name: str | None = None) -> Column:
    x = v if name is None else _at(v, name)
    return F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string"))


def _number(v: Column, name: str, kind: str = "double") -> Column:
    x = _at(v, name)
    numeric = F.coalesce(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))
    return F.when(numeric, F.try_variant_get(x, "$", kind))


def _true(v: Column, name: str) -> Column:
    x = _at(v, name)
    return F.coalesce(F.when(_is(x, "BOOLEAN"), F.try_variant_get(x, "$", "boolean")), F.lit(False))


def _array(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _objects(v: Column, name: str) -> Column:
    return F.filter(_array(v, name), lambda x: _is(x, "OBJECT"))


def _texts(v: Column, name: str) -> Column:
    return F.transform(F.filter(_array(v, name), lambda x: _is(x, "STRING")), lambda x: F.try_variant_get(x, "$", "string"))


def _time(v: Column, name: str) -> Column:
    return F.try_to_timestamp(_text(v, name))


def _one_of(x: Column, names: tuple[str, ...], other) -> Column:
    return F.when(x.isin(*names), x).otherwise(other)


def _source_kind(x: Column) -> Column:
    return F.when(x.isin(*SOURCE_KINDS) | x.rlike(ANALYSIS_KIND), x).otherwise("run-manifest")


def coverage_status(score: Column, missing: Column) -> Column:
    return F.when(score < MINIMAL, "minimal").when((F.size(missing) == 0) & (score >= COMPLETE), "complete").otherwise("partial")


def bundles(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with error and the cleaned parts of an observation bundle: observation_id, site, batch, vantage, coverage, sources, devices, notes.

    error is null for a bundle; else too large (a null text with a length counts
    as that, see json_files), not JSON, another version, or a part that is
    missing; the parts are null then.  Lists are cut before their elements are looked
    at, so rows stay below the limits.
    """
    v = F.col("_v")
    rows = rows.withColumn("_v", F.when(F.octet_length(column) <= MAX_BUNDLE_BYTES, F.try_parse_json(column)))
    objects = F.lit(True)
    for part in ("site", "collector", "batch", "vantage", "coverage"):
        objects = objects & _is(_at(v, part), "OBJECT")
    lists = _is(_at(v, "sources"), "ARRAY") & _is(_at(v, "devices"), "ARRAY")
    first = lambda name, n: F.filter(F.slice(_array(v, name), 1, n), lambda x: _is(x, "OBJECT"))
    long = F.octet_length(column) > MAX_BUNDLE_BYTES
    if "length" in rows.columns:
        long = long | (F.col("length") > MAX_BUNDLE_BYTES) | (F.col(column).isNull() & F.col("length").isNotNull())
    error = F.when(F.coalesce(long, F.lit(False)), "too large").when(v.isNull(), "not JSON").when(~F.coalesce(_text(v, "schemaVersion").rlike(BUNDLE_VERSION), F.lit(False)), "not a bundle")
    error = error.when(~objects, "part missing").when(~lists, "list missing").when(F.size(first("sources", MAX_SOURCES)) == 0, "no sources")
    rows = rows.withColumn("error", error)
    ok = lambda c: F.when(F.col("error").isNull(), c)

    sources = F.transform(first("sources", MAX_SOURCES), lambda s: F.struct(
        Y.safe_id(_text(s, "sourceId"), "src-unknown").alias("source_id"), _source_kind(_text(s, "kind")).alias("kind"), F.coalesce(Y.text_or_null(_text(s, "artifactLabel"), 80), F.lit("unknown")).alias("label"),
        Y.file_name(_text(s, "fileName")).alias("file_name"), _true(s, "parsed").alias("parsed"), F.floor(F.greatest(F.coalesce(_number(s, "recordCount"), F.lit(0.0)), F.lit(0.0))).cast("long").alias("n_records"),
        Y.safe_notes(_texts(s, "notes")).alias("notes")))
    rows = rows.withColumn("sources", ok(sources))
    held = F.transform("sources", lambda s: s["source_id"])

    def evidence(e):
        kind, source, value = _text(e, "kind"), Y.safe_id(_text(e, "sourceId"), ""), Y.safe_text(_text(e, "value"), 160)
        own = F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("|", kind, value, source), 256), 1, 12))
        return F.struct(Y.safe_id(_text(e, "evidenceId"), own).alias("evidence_id"), kind.alias("kind"), value.alias("value"), source.alias("source_id"), _one_of(_text(e, "confidence"), CONFIDENCES, "weak").alias("confidence"))

    def port(p):
        n = _number(p, "port")
        return F.struct(
            F.coalesce(Y.text_or_null(_text(p, "protocol"), 16), F.lit("tcp")).alias("protocol"), F.when((n == F.floor(n)) & n.between(1, 65535), n.cast("int")).alias("port"),
            Y.text_or_null(_text(p, "service"), 80).alias("service"), Y.text_or_null(_text(p, "product"), 120).alias("product"), Y.text_or_null(_text(p, "version"), 80).alias("version"),
            Y.safe_id(_text(p, "sourceId"), "").alias("source_id"))

    known = lambda x: (x["source_id"] != "") & F.array_contains(held, x["source_id"])
    devices = F.transform(first("devices", MAX_DEVICES), lambda d: F.struct(
        Y.safe_id(_text(d, "deviceId"), "dev-unknown").alias("device_id"), _time(d, "firstSeen").alias("first_seen"), _time(d, "lastSeen").alias("last_seen"),
        F.filter(Y.safe_texts(_texts(d, "ips"), 45), is_ipv4).alias("ips"), F.filter(F.transform(Y.safe_texts(_texts(d, "macs"), 17), lambda x: mac(x)), lambda x: x.isNotNull()).alias("macs"),
        Y.safe_texts(_texts(d, "hostnames"), 120).alias("hostnames"), Y.safe_texts(_texts(d, "vendors"), 120).alias("vendors"),
        F.slice(F.filter(F.transform(_objects(d, "identityEvidence"), evidence), lambda x: x["kind"].isin(*EVIDENCE_KINDS) & known(x) & (x["value"] != "")), 1, MAX_EVIDENCE).alias("evidence"),
        F.slice(F.filter(F.transform(_objects(d, "openPorts"), port), lambda x: x["port"].isNotNull() & known(x)), 1, MAX_PORTS).alias("ports"), Y.safe_notes(_texts(d, "notes")).alias("notes")))

    part = lambda name: _at(v, name)
    cover = part("coverage")
    expected, present = Y.safe_texts(_texts(cover, "expectedSources"), 80), Y.safe_texts(_texts(cover, "presentSources"), 80)
    missing = F.array_union(Y.safe_texts(_texts(cover, "missingSources"), 80), F.array_except(expected, present))
    score = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.floor(_number(cover, "score") * 100 + F.lit(0.5)) / 100)), F.lit(0.0))
    unknown = lambda c, most: F.coalesce(Y.text_or_null(c, most), F.lit("unknown"))
    rows = rows.withColumn("coverage", ok(F.struct(coverage_status(score, missing).alias("status"), score.alias("score"), present.alias("present"), missing.alias("missing"), Y.safe_notes(_texts(cover, "notes")).alias("notes"))))
    partial = _true(part("batch"), "partial") | (F.col("coverage.status") != "complete") | (F.size("coverage.missing") > 0)
    out = rows.withColumns({
        "observation_id": ok(Y.safe_id(_text(v, "observationId"), "obs-unknown")),
        "site": ok(F.struct(Y.safe_id(_text(part("site"), "siteId"), "site-unknown").alias("site_id"), unknown(_text(part("site"), "networkName"), 120).alias("network"), Y.text_or_null(_text(part("site"), "networkScope"), 120).alias("scope"))),
        "batch": ok(F.struct(
            Y.safe_id(_text(part("batch"), "batchId"), "batch-unknown").alias("batch_id"), Y.safe_id(_text(part("batch"), "sourceRunUid"), "run-unknown").alias("source_run_uid"), _time(part("batch"), "startedAt").alias("started_at"),
            _time(part("batch"), "endedAt").alias("ended_at"), _time(part("batch"), "generatedAt").alias("generated_at"), partial.alias("partial"), Y.safe_notes(_texts(part("batch"), "notes")).alias("notes"))),
        "vantage": ok(F.struct(
            F.coalesce(Y.text_or_null(_text(part("vantage"), "type"), 80), F.lit("active-scan-upload")).alias("type"), Y.text_or_null(_text(part("vantage"), "runType"), 80).alias("run_type"),
            unknown(_text(part("vantage"), "networkName"), 120).alias("network"), Y.text_or_null(_text(part("vantage"), "collectorHost"), 120).alias("collector_host"), Y.text_or_null(_text(part("vantage"), "target"), 120).alias("target"))),
        "devices": ok(devices), "notes": ok(Y.safe_notes(_texts(v, "notes"))),
    })
    return out.drop("_v")


def bundle_devices(cleaned: DataFrame, *keys: str) -> DataFrame:
    """(keys, device_id, first_seen, ..., evidence, ports, notes): a row a device of each bundle.

    The outer form keeps the optimizer from testing the list's size first,
    which would clean every device twice; a device always has an id.
    """
    return cleaned.select(*keys, F.inline_outer("devices")).filter("device_id is not null")


def analyses(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with error, meta, devices, endpoints, flows, dns and alerts of a saved traffic analysis, each list within its limit.

    Numbers that are missing or below 0 are 0, unknown names the last of their
    kind (other, info, external); an analysis without devices and flows is an error.
    """
    v = F.col("_v")
    rows = rows.withColumn("_v", F.when(F.octet_length(column) <= MAX_ANALYSIS_BYTES, F.try_parse_json(column)))
    some = lambda name: F.slice(_objects(v, name), 1, ANALYSIS_LIMITS[name])
    text = lambda x, name, most, other=None: F.coalesce(F.substring(_text(x, name), 1, most), F.lit(other))
    filled = lambda x, name, most: F.nullif(F.substring(_text(x, name), 1, most), F.lit(""))
    amount = lambda x, name, other=0: F.coalesce(F.when(_number(x, name) >= 0, _number(x, name)), F.lit(float(other)))
    names = lambda x, name, n, most: F.transform(F.slice(_texts(x, name), 1, n), lambda t: F.substring(t, 1, most))
    category = lambda x: _one_of(x, CATEGORIES, "other")
    categories = lambda x: F.transform(F.slice(_array(x, "categories"), 1, 16), lambda t: category(_text(t)))
    long = F.coalesce(F.octet_length(column) > MAX_ANALYSIS_BYTES, F.lit(False))
    if "length" in rows.columns:
        long = long | (F.col("length") > MAX_ANALYSIS_BYTES) | (F.col(column).isNull() & F.col("length").isNotNull())
    shaped = F.coalesce(_number(v, "version") == 1, F.lit(False)) & _is(_at(v, "meta"), "OBJECT")
    error = F.when(long, "too large").when(v.isNull(), "not JSON").when(~shaped, "not an analysis").when(F.size(some("devices")) + F.size(some("flows")) == 0, "empty analysis")
    rows = rows.withColumn("error", error)
    ok = lambda c: F.when(F.col("error").isNull(), c)
    meta = _at(v, "meta")

    def device(x):
        return F.struct(
            text(x, "id", 40, "dev-unknown").alias("id"), filled(x, "mac", 23).alias("mac"), names(x, "ips", 16, 45).alias("ips"), filled(x, "name", 80).alias("name"), filled(x, "vendor", 80).alias("vendor"),
            _one_of(_text(x, "role"), ("gateway", "broadcast"), "device").alias("role"), _true(x, "isKnown").alias("is_known"),
            *[amount(x, a).cast("long").alias(b) for a, b in (("packetsSent", "packets_sent"), ("packetsReceived", "packets_received"), ("bytesSent", "bytes_sent"), ("bytesReceived", "bytes_received"), ("externalPeerCount", "external_peers"), ("dnsQueryCount", "dns_queries"))],
            _time(x, "firstSeen").alias("first_seen"), _time(x, "lastSeen").alias("last_seen"), categories(x).alias("categories"), filled(x, "notes", 500).alias("notes"))

    def flow(x):
        port = _number(x, "port")
        return F.struct(
            text(x, "id", 40, "flow-unknown").alias("id"), text(x, "fromId", 40, "").alias("from_id"), text(x, "toId", 40, "").alias("to_id"), _one_of(_text(x, "protocol"), PROTOCOLS, "other").alias("protocol"),
            F.when((port == F.floor(port)) & port.between(0, 65535), port.cast("int")).alias("port"), category(_text(x, "category")).alias("category"),
            *[amount(x, a).cast("long").alias(b) for a, b in (("packets", "packets"), ("bytes", "bytes"), ("bytesFromInitiator", "bytes_from_initiator"))],
            _time(x, "firstSeen").alias("first_seen"), _time(x, "lastSeen").alias("last_seen"), _one_of(_text(x, "scope"), ("internal", "broadcast"), "external").alias("scope"))

    out = rows.withColumns({
        "meta": ok(F.struct(
            F.coalesce(F.nullif(F.substring(F.regexp_replace(F.element_at(F.split(text(meta, "fileName", 120, "analysis.json"), r"[\\/]"), -1), r"[^A-Za-z0-9_.\- ()]", "_"), 1, 80), F.lit("")), F.lit("capture")).alias("file_name"),
            amount(meta, "packetCount").cast("long").alias("packets"), amount(meta, "byteCount").cast("long").alias("bytes"), _time(meta, "startTime").alias("start"), _time(meta, "endTime").alias("end"),
            F.when(_number(meta, "durationMs") >= 0, _number(meta, "durationMs")).alias("duration_ms"), _true(meta, "truncated").alias("truncated"), amount(meta, "ignoredPackets").cast("long").alias("ignored_packets"))),
        "devices": ok(F.transform(some("devices"), device)), "flows": ok(F.transform(some("flows"), flow)),
        "endpoints": ok(F.transform(some("externalEndpoints"), lambda x: F.struct(
            text(x, "id", 40, "ext-unknown").alias("id"), text(x, "ip", 60, "unknown").alias("ip"), _true(x, "isAggregate").alias("is_aggregate"), amount(x, "packets").cast("long").alias("packets"), amount(x, "bytes").cast("long").alias("bytes"), categories(x).alias("categories")))),
        "dns": ok(F.transform(some("dnsQueries"), lambda x: F.struct(text(x, "name", 260, "(invalid name)").alias("name"), amount(x, "count", 1).cast("long").alias("n"), _one_of(_text(x, "kind"), ("mdns", "llmnr"), "dns").alias("kind")))),
        "alerts": ok(F.transform(some("alerts"), lambda x: F.struct(
            text(x, "id", 40, "alert-unknown").alias("id"), text(x, "ruleId", 60, "unknown").alias("rule"), _one_of(_text(x, "level"), LEVELS, "info").alias("level"), text(x, "title", 160, "Watch item").alias("title"),
            text(x, "detail", 800, "").alias("detail"), names(x, "deviceIds", 50, 40).alias("device_ids"), names(x, "flowIds", 50, 40).alias("flow_ids")))),
    })
    return out.drop("_v")
