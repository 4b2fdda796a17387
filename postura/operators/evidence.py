"""Evidence of devices, what supplements an observation, and what may be said about a site's activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, identity_text, mac
from .observations import latest_valid_pair
from .pairs import sharing

# Most evidence and ports that a device's record holds.
MAX_EVIDENCE, MAX_PORTS = 40, 256
# Fixed values: (kind of device, words that tell it), the first that fits counts.
DEVICE_WORDS = (
    ("printer", "printer|print|scanner|ipp"), ("speaker", "speaker|audio|voice assistant|smart speaker|assistant"), ("display", "tv|television|display|monitor|streaming stick|streamer"),
    ("phone", "phone|smartphone|mobile|cell"), ("computer", "laptop|notebook|computer|desktop|workstation|pc"), ("gateway", "router|gateway|firewall|access point|wireless ap"),
)
# What a source is called.
SOURCE_LABELS = {
    "ports": "port scan", "discovery": "discovery scan", "hosts_up": "host-up list", "arp_snapshot": "ARP snapshot", "scan_metadata": "scan metadata",
    "collection_vantage": "collection vantage", "capture_timing": "capture timing", "parser_limits": "parser limits",
}


def _first(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_k") <= n)


def device_records(evidence: DataFrame, ports: DataFrame) -> DataFrame:
    """(device_id, evidence, ports): a record a device with evidence; lists are cut before they are collected, so a busy device's stays small.

    evidence: (device_id, seq, kind, value, source_id), each kind, value and
    source once, by first place, at most MAX_EVIDENCE; ports: (device_id, seq,
    protocol, port, service, source_id), each once, by port and protocol, at
    most MAX_PORTS.  The whole of either is in its rows.
    """
    e = evidence.groupBy("device_id", "kind", "value", "source_id").agg(F.min("seq").alias("seq"))
    e = _first(e, ["device_id"], [F.col("seq"), F.col("kind"), F.col("value")], MAX_EVIDENCE)
    name = F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("|", "kind", "value", "source_id"), 256), 1, 12))
    e = e.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("_k", name.alias("evidence_id"), "kind", "value", "source_id"))).alias("evidence"))
    p = ports.groupBy("device_id", "protocol", "port", "service", "source_id").agg(F.min("seq").alias("seq"))
    p = _first(p, ["device_id"], [F.col("port"), F.col("protocol"), F.col("seq")], MAX_PORTS)
    p = p.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("_k", "protocol", "port", "service", "source_id"))).alias("ports"))
    empty = F.array().cast("array<struct<protocol:string,port:int,service:string,source_id:string>>")
    drop = lambda c: F.transform(c, lambda x: x.dropFields("_k"))
    return e.join(p, "device_id", "left").select("device_id", drop("evidence").alias("evidence"), F.coalesce(drop("ports"), empty).alias("ports"))


def hashed_mac(c: Column | str) -> Column:
    """hash:digits of a text of 32 to 128 hex digits, with or without a mark before; else null."""
    digits = F.regexp_extract(F.lower(F.trim(col(c))), "^(?:sha256:|hash:)?([a-f0-9]{32,128})$", 1)
    return F.when(digits != "", F.concat(F.lit("hash:"), digits))


def evidence_ids(evidence: Column | str, kinds: Column | str, values: Column | str) -> Column:
    """Ids, sorted, of the evidence of some kinds whose value is among values: as text, as a MAC, as a hashed MAC, or as one part of a value joined by |."""
    wanted = F.transform(col(values), lambda v: identity_text(v))
    parts = F.flatten(F.transform(F.filter(wanted, lambda v: v.contains("|")), lambda v: F.split(v, r"\|")))
    every = F.array_union(wanted, parts)

    def fits(e):
        text = identity_text(e["value"])
        others = F.array(F.lower(mac(e["value"])), hashed_mac(e["value"]))
        return F.array_contains(col(kinds), e["kind"]) & (F.array_contains(every, text) | F.coalesce(F.arrays_overlap(wanted, F.filter(others, lambda x: x.isNotNull())), F.lit(False)))

    return F.array_sort(F.array_distinct(F.transform(F.filter(col(evidence), fits), lambda e: e["evidence_id"])))


def supplements(entries: DataFrame, primaries: DataFrame) -> DataFrame:
    """(primary_id, registry_id, observed_at): supplemental entries of the same site, or of a network of the same name.

    entries: (registry_id, site_id, network, observed_at, supplemental);
    primaries: (primary_id, site_id, network).  Sites and names are keys of
    one join that makes each pair once, so only the two tables are shuffled;
    of an entry told twice the later time counts.
    """
    mark = lambda m, c: F.concat(F.lit(m), c)
    keys = F.array_compact(F.array(mark("s", F.lower("site_id")), mark("n", F.nullif(F.lower(F.trim("network")), F.lit(""))))).alias("k")
    held = lambda name: F.array_distinct(F.flatten(F.collect_list("k"))).alias(name)
    extra = entries.filter("supplemental").select("registry_id", "observed_at", keys).groupBy("registry_id").agg(F.max("observed_at").alias("observed_at"), held("_extra"))
    own = primaries.select("primary_id", keys).groupBy("primary_id").agg(held("_own"))
    return sharing(own, extra, "_own", "_extra").select("primary_id", "registry_id", "observed_at")


def supplement_counts(entries: DataFrame, primaries: DataFrame) -> DataFrame:
    """(primary_id, n_supplements, newest): of each primary the number and the newest of the entries that `supplements` lists, none listed.

    Entries are counted once by site, by network and by both, and a primary
    looks its three counts up; one site with very many of both costs no pairs.
    """
    keyed = lambda rows: rows.withColumns({"_s": F.lower("site_id"), "_n": F.nullif(F.lower(F.trim("network")), F.lit(""))})
    extra = keyed(entries.filter("supplemental")).select("_s", "_n", "observed_at")

    def counted(*keys: str) -> DataFrame:
        name = "".join(keys)
        return extra.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(f"c{name}"), F.max("observed_at").alias(f"t{name}"))

    rows = keyed(primaries)
    for keys in (("_s",), ("_n",), ("_s", "_n")):
        rows = rows.join(counted(*keys), list(keys), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("primary_id", (n("c_s") + n("c_n") - n("c_s_n")).alias("n_supplements"), F.greatest("t_s", "t_n").alias("newest"))


def activity_status(entries: DataFrame) -> DataFrame:
    """(site, status, n, current_id, baseline_id) of every site: empty without a primary observation, one-observation, no-comparison, or ready with its pair.

    entries: (registry_id, site, observed_at, partial, supplemental).
    """
    key = F.lower("site").alias("_site")
    counts = entries.groupBy(key).agg(F.count_if(~F.col("supplemental")).alias("n"), F.min("site").alias("site"))
    pairs = latest_valid_pair(entries.filter(~F.col("supplemental"))).select(key, "current_id", "baseline_id")
    status = F.when(F.col("n") == 0, "empty").when(F.col("n") == 1, "one-observation").when(F.col("current_id").isNull(), "no-comparison").otherwise("ready")
    return counts.join(pairs, "_site", "left").select("site", status.alias("status"), "n", "current_id", "baseline_id")


def limitations(pairs: DataFrame) -> DataFrame:
    """(pair_id, code, severity), each once: what a reader of a pair's activity must bear in mind beside its guardrails.

    pairs: (pair_id, freshness, base_missing, current_missing, n_supplements).
    """
    one = lambda test, code, severity: F.when(test, F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity")))
    all_ = F.array(
        one(F.col("n_supplements") > 0, "supplemental-evidence", "info"),
        one(F.col("freshness") != "fresh", F.concat(F.lit("freshness-"), "freshness"), F.when(F.col("freshness") == "aging", "info").otherwise("warning")),
        one(F.size("base_missing") > 0, "baseline-missing-sources", "warning"), one(F.size("current_missing") > 0, "current-missing-sources", "warning"),
    )
    return pairs.select("pair_id", F.inline(F.filter(all_, lambda x: x.isNotNull()))).distinct()


def device_kind(rows: DataFrame) -> DataFrame:
    """rows (role, name, notes, is_known, categories, external_peers) with kind, strength and weak_kind.

    A role tells it, else the first word of name and notes; else generic if
    known and unknown if not, with a guess from the traffic.
    """
    text = F.lower(F.concat_ws(" ", F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("notes"), F.lit(""))))
    told = F.coalesce(*[F.when(text.rlike(rf"\b(?:{words})\b"), F.lit(kind)) for kind, words in DEVICE_WORDS])
    weak = F.when(F.arrays_overlap("categories", F.array(F.lit("mdns"), F.lit("ssdp"))), "speaker").when(F.array_contains("categories", "quic") & (F.col("external_peers") > 0), "display")
    role = F.col("role").isin("gateway", "broadcast")
    kind = F.when(role, F.col("role")).when(told.isNotNull(), told).when(F.col("is_known"), "generic").otherwise("unknown")
    strength = F.when(role, "role").when(told.isNotNull(), "inventory_text").when(weak.isNotNull(), "weak").otherwise("unknown")
    return rows.withColumns({"kind": kind, "strength": strength, "weak_kind": F.when(~role & told.isNull(), weak)})


def source_label(c: Column | str) -> Column:
    """What a source is called; of others the name with spaces."""
    names = F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, col(c)), F.replace(col(c), F.lit("_"), F.lit(" ")))
