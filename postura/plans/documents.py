"""Queries of outside documents, evidence and activity, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safety as Y
from ..operators import evidence as E
from ..operators import observations as T
from ..sources import documents as D
from . import bridges as B
from .registry import _FRESH, _WS, query

# texts


#: What is unsafe, said again for DuckDB: texts are collapsed, so a space is the only white space left.
_UNSAFE = r"""(regexp_matches(' ' || t, '[ "''=(](/[^ "'']|[A-Za-z]:[/\\]|\\\\[^ \\]+\\[^ "''])')
  or regexp_matches(t, '\b(sk-[A-Za-z0-9_-]{20,}|gh[oprsu]_[A-Za-z0-9_]{20,}|AKIA[A-Z0-9]{16})\b') or regexp_matches(t, 'BEGIN ((DSA|EC|OPENSSH|RSA) )?PRIVATE KEY') or regexp_matches(lower(t), '\b(api(_|-|)key|password|secret|token) ?[=:]')
  or regexp_matches(lower(t), '<([?]?xml|host|nmaprun|packet)\b') or lower(t) like '%pcap global header%' or lower(t) like '%pcapng global header%'
  or regexp_matches(lower(t), '\b(nmap scan report for|starting nmap|port state service|raw packets sent)\b') or regexp_matches(' ' || lower(t), ' (icmp|ip|tcp|udp) .{1,160} >'))"""
_TRIM = f"regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


@query(f"""with x as (select doc_id, substr(regexp_replace({_TRIM}, '[{_WS}]+', ' ', 'g'), 1, 300) as t from documents)
select doc_id, {_UNSAFE} as unsafe, md5(case when t is null or {_UNSAFE} then '' else t end) as text_md5 from x""")
def safe_texts(spark, d):
    rows = B.read(spark, d, "documents").select("doc_id", "text", Y.safe_text("text", 300).alias("t"))
    return rows.select("doc_id", F.when(F.col("text").isNotNull(), (F.col("t") == "") & (Y.trimmed("text") != "")).alias("unsafe"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


_IDS = "case c_custkey % 6 when 0 then 'run ' || c_custkey when 1 then '/srv/' || c_custkey when 2 then 'a//b??' || c_custkey when 3 then 'token = ' || c_custkey when 4 then 'port state service ' || c_custkey else '  ok_' || c_custkey || '  ' end"


@query("""select c_custkey, case c_custkey % 6 when 0 then 'run-' || c_custkey when 2 then 'a-b-' || c_custkey when 5 then 'ok_' || c_custkey else 'none' end as id from customer""")
def safe_ids(spark, d):
    return B.read(spark, d, "customer").select("c_custkey", Y.safe_id(F.expr(_IDS), "none").alias("id"))


# documents

_PARTS = ('"collector":{},"vantage":{"type":"active-scan-upload"},"batch":{"batchId":"b1","startedAt":"2024-01-02T03:04:05Z"},"sources":[{"sourceId":"s1","kind":"nmap-xml"},{"sourceId":"s2","kind":"?"},5],'
          '"coverage":{"score":0.9,"expectedSources":["ports","discovery"],"presentSources":["ports"]}')


def _bundles(spark, d):
    """A bundle a customer: names, numbers and lists with values to drop; every ninth is none."""
    k = F.col("c_custkey")
    n = k.cast("string")
    device = F.concat(
        F.lit('{"deviceId":"d '), n, F.lit('","ips":["10.0.0.'), (k % 256).cast("string"), F.lit('","10.0.0.256",7,"10.0.0.'), (k % 256).cast("string"), F.lit('"],"macs":["'), F.lower(F.lpad(F.hex(k), 12, "0")), F.lit('","zz"],"hostnames":["  h '), n,
        F.lit('  ","/etc/x"],"openPorts":[{"port":'), (k % 3 * 40000).cast("string"), F.lit(',"sourceId":"s1","service":"web"},{"port":22,"sourceId":"s9"},{"port":"80","sourceId":"s1"},{"port":53,"sourceId":"s2","protocol":"udp"}],'),
        F.lit('"identityEvidence":[{"kind":"hostname","value":"h'), n, F.lit('","sourceId":"s1","confidence":"sure"},{"kind":"colour","value":"red","sourceId":"s1"}]}'))
    text = F.concat(F.lit('{"schemaVersion":"x.observation-bundle.v'), F.when(k % 9 == 0, "2").otherwise("1"), F.lit('","observationId":"obs/'), n, F.lit('","site":{"siteId":"site-'), (k % 50).cast("string"), F.lit('","networkName":'), F.when(k % 2 == 0, F.concat(F.lit('"Net '), (k % 50).cast("string"), F.lit('"'))).otherwise("5"), F.lit("},"), F.lit(_PARTS), F.lit(',"devices":['), device, F.lit(",null]}"))
    # a short key becomes a long document, so the keys are dealt to all cores before
    customers = B.read(spark, d, "customer").select("c_custkey").repartition(8 * spark.sparkContext.defaultParallelism)
    return D.bundles(customers.select("c_custkey", text.alias("json")))


@query("""select c_custkey, case when c_custkey % 9 = 0 then 'not a bundle' end as error, case when c_custkey % 9 <> 0 then 'obs-' || c_custkey end as observation_id, case when c_custkey % 9 <> 0 then 'site-' || (c_custkey % 50) end as site_id,
  case when c_custkey % 9 <> 0 then case when c_custkey % 2 = 0 then 'Net ' || (c_custkey % 50) else 'unknown' end end as network, case when c_custkey % 9 <> 0 then 'partial' end as status, case when c_custkey % 9 <> 0 then true end as partial,
  case when c_custkey % 9 <> 0 then 'discovery' end as missing, case when c_custkey % 9 <> 0 then 's1:nmap-xml,s2:run-manifest' end as sources from customer""")
def bundle_headers(spark, d):
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source_id"], s["kind"])), ",")
    return _bundles(spark, d).select("c_custkey", "error", "observation_id", "site.site_id", "site.network", "coverage.status", F.when(F.col("error").isNull(), F.col("batch.partial")).alias("partial"), F.array_join("coverage.missing", ",").alias("missing"), sources.alias("sources"))


@query("""with x as (select c_custkey, lpad(to_hex(c_custkey), 12, '0') as m from customer where c_custkey % 9 <> 0)
select c_custkey, 'd-' || c_custkey as device_id, '10.0.0.' || (c_custkey % 256) as ips, upper(array_to_string([m[1:2], m[3:4], m[5:6], m[7:8], m[9:10], m[11:12]], ':')) as macs, 'h ' || c_custkey as hostnames,
  case when c_custkey % 3 = 1 then 'tcp/40000/web;' else '' end || 'udp/53/' as ports, 'ev-' || substr(sha256('hostname|h' || c_custkey || '|s1'), 1, 12) || ':weak' as evidence from x""")
def bundle_devices(spark, d):
    rows = D.bundle_devices(_bundles(spark, d), "c_custkey")
    ports = F.array_join(F.transform("ports", lambda p: F.concat_ws("/", p["protocol"], p["port"].cast("string"), F.coalesce(p["service"], F.lit("")))), ";")
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["evidence_id"], e["confidence"])), ";")
    return rows.select("c_custkey", "device_id", F.array_join("ips", ",").alias("ips"), F.array_join("macs", ",").alias("macs"), F.array_join("hostnames", ",").alias("hostnames"), ports.alias("ports"), evidence.alias("evidence"))


@query("""select o_orderkey, case when o_orderkey % 8 = 3 then 'empty analysis' end as error, case when o_orderkey % 8 <> 3 then (o_orderkey % 90000) end as port_given, case when o_orderkey % 8 <> 3 and o_orderkey % 90000 <= 65535 then (o_orderkey % 90000)::int end as port,
  case when o_orderkey % 8 <> 3 then case when o_orderkey % 2 = 0 then 'https' else 'other' end end as category, case when o_orderkey % 8 <> 3 then greatest(o_custkey - 700, 0) end as bytes, case when o_orderkey % 8 <> 3 then 'external' end as scope from orders""")
def analysis_flows(spark, d):
    k = F.col("o_orderkey")
    flow = F.concat(F.lit('[{"id":"f1","port":'), (k % 90000).cast("string"), F.lit(',"category":'), F.when(k % 2 == 0, '"https"').otherwise("3"), F.lit(',"bytes":'), (F.col("o_custkey") - 700).cast("string"), F.lit(',"scope":"elsewhere"},9]'))
    text = F.concat(F.lit('{"version":1,"meta":{"fileName":"a.pcap"},"flows":'), F.when(k % 8 == 3, "[]").otherwise(flow), F.lit("}"))
    rows = D.analyses(B.read(spark, d, "orders").select("o_orderkey", text.alias("json")))
    f = F.get("flows", F.lit(0))
    return rows.select("o_orderkey", "error", F.when(F.col("error").isNull(), k % 90000).alias("port_given"), f["port"].alias("port"), f["category"].alias("category"), f["bytes"].alias("bytes"), f["scope"].alias("scope"))


# evidence


@query(f"""with {B.FINDINGS}, e0 as (select ip as device_id, ord * 2 as seq, 'ip-address' as kind, ip as value, run from f union all select ip, ord * 2 + 1, 'hostname', hostname, run from f where hostname <> ''),
e1 as (select device_id, kind, value, run, min(seq) as seq from e0 group by all), e2 as (select *, row_number() over (partition by device_id order by seq, kind, value) as k from e1),
ev as (select device_id, string_agg('ev-' || substr(sha256(kind || '|' || value || '|' || run), 1, 12), ',' order by k) as evidence from e2 where k <= 40 group by 1),
p1 as (select ip as device_id, protocol, port, service, run, min(ord) as seq from f where state = 'open' group by all), p2 as (select *, row_number() over (partition by device_id order by port, protocol, seq) as k from p1),
po as (select device_id, string_agg(protocol || '/' || port || '/' || service || '/' || run, ',' order by k) as ports from p2 where k <= 256 group by 1)
select device_id, evidence, coalesce(ports, '') as ports from ev left join po using (device_id)""")
def device_records(spark, d):
    f = B.findings(spark, d)
    row = lambda seq, kind, value: f.select(F.col("ip").alias("device_id"), seq.alias("seq"), F.lit(kind).alias("kind"), F.col(value).alias("value"), F.col("run").alias("source_id"))
    evidence = row(F.col("ord") * 2, "ip-address", "ip").unionByName(row(F.col("ord") * 2 + 1, "hostname", "hostname").filter("value <> ''"))
    ports = f.filter("state = 'open'").select(F.col("ip").alias("device_id"), F.col("ord").alias("seq"), "protocol", "port", "service", F.col("run").alias("source_id"))
    join = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *[x[n].cast("string") for n in names])), ",").alias(c)
    return E.device_records(evidence, ports).select("device_id", join("evidence", "evidence_id"), join("ports", "protocol", "port", "service", "source_id"))


@query("""select c_custkey, array_to_string(list_filter([case when c_custkey % 2 = 0 then 'e1' end, case when c_custkey % 3 = 0 then 'e2' end, case when c_custkey % 5 = 0 then 'e3' end], lambda x: x is not null), ',') as ids from customer""")
def evidence_ids(spark, d):
    k = F.col("c_custkey")
    e = lambda i, kind, value: F.struct(F.lit(i).alias("evidence_id"), F.lit(kind).alias("kind"), value.alias("value"))
    digits = F.upper(F.lpad(F.hex(k), 12, "0"))
    colons = F.lower(F.regexp_replace(digits, "(..)(?=.)", "$1:"))
    hashed = F.sha2(k.cast("string"), 256)
    found = F.array(e("e3", "hostname", F.concat(F.lit(" Nas  "), k.cast("string"))), e("e1", "mac-address", digits), e("e2", "mac-address", F.upper(hashed)), e("e4", "vendor", digits))
    values = F.filter(F.array(F.when(k % 2 == 0, colons), F.when(k % 3 == 0, F.concat(F.lit("hash:"), hashed)), F.when(k % 5 == 0, F.concat(F.lit("nas "), k.cast("string"), F.lit("|acme")))), lambda x: x.isNotNull())
    kinds = F.array(F.lit("mac-address"), F.lit("hostname"))
    rows = B.read(spark, d, "customer").select("c_custkey", found.alias("evidence"), kinds.alias("kinds"), values.alias("values"))
    return rows.select("c_custkey", F.array_join(E.evidence_ids("evidence", "kinds", "values"), ",").alias("ids"))


_ENTRIES = "en as (select o_orderkey as registry_id, 'S' || (o_custkey % 40) as site_id, case when o_orderkey % 3 = 0 then ' NET' || (o_custkey % 90) else 'net' || (o_custkey % 90) end as network, o_orderdate as observed_at, o_orderkey % 50 = 0 as supplemental from orders)"


@query(f"""with {_ENTRIES}, pr as (select s_suppkey as primary_id, 's' || (s_suppkey % 60) as site_id, 'Net' || (s_suppkey % 100) as network from supplier)
select distinct primary_id, registry_id, observed_at from pr join en on supplemental and (lower(en.site_id) = lower(pr.site_id) or lower(trim(en.network)) = lower(pr.network))""")
def supplements(spark, d):
    return E.supplements(*_entries(spark, d))


@query(f"""with {_ENTRIES}, pr as (select s_suppkey as primary_id, 's' || (s_suppkey % 60) as site_id, 'Net' || (s_suppkey % 100) as network from supplier)
select primary_id, count(registry_id) as n_supplements, max(observed_at) as newest from pr left join en on supplemental and (lower(en.site_id) = lower(pr.site_id) or lower(trim(en.network)) = lower(pr.network)) group by primary_id""")
def supplement_counts(spark, d):
    return E.supplement_counts(*_entries(spark, d))


def _entries(spark, d):
    """orders as entries of sites and networks, suppliers as primary observations."""
    k, c, s = F.col("o_orderkey"), (F.col("o_custkey") % 90).cast("string"), F.col("s_suppkey")
    entries = B.read(spark, d, "orders").select(k.alias("registry_id"), F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("site_id"), F.concat(F.when(k % 3 == 0, " NET").otherwise("net"), c).alias("network"), F.col("o_orderdate").alias("observed_at"), (k % 50 == 0).alias("supplemental"))
    primaries = B.read(spark, d, "supplier").select(s.alias("primary_id"), F.concat(F.lit("s"), (s % 60).cast("string")).alias("site_id"), F.concat(F.lit("Net"), (s % 100).cast("string")).alias("network"))
    return entries, primaries


@query(f"""with {B.OBSERVATIONS}, pn as (select *, registry_id % 4 = 1 as supplemental from ob), pm as (select * from pn where not supplemental),
n as (select site, count(*) filter (where not supplemental) as n from pn group by site), nw as (select site, max(observed_at) as newest from pm group by site),
cu as (select pm.site, min(registry_id) as id from pm join nw on nw.site = pm.site and observed_at = newest group by 1), ba as (select pm.site, registry_id as id, row_number() over (partition by pm.site order by observed_at desc, registry_id) as k from pm join nw on nw.site = pm.site and observed_at < newest)
select n.site, case when n = 0 then 'empty' when n = 1 then 'one-observation' when ba.id is null then 'no-comparison' else 'ready' end as status, n, case when ba.id is not null then cu.id end as current_id, ba.id as baseline_id from n left join cu using (site) left join ba on ba.site = n.site and k = 1""")
def activity_status(spark, d):
    return E.activity_status(B.observations(spark, d).withColumn("supplemental", F.col("registry_id") % 4 == 1))


@query(f"""with {B.OBSERVATIONS}, x as (select registry_id as pair_id, {_FRESH} as freshness, registry_id % 3 = 0 as b, registry_id % 4 = 0 as c, registry_id % 5 = 0 as s from ob)
select pair_id, 'supplemental-evidence' as code, 'info' as severity from x where s union all select pair_id, 'freshness-' || freshness, case when freshness = 'aging' then 'info' else 'warning' end from x where freshness <> 'fresh'
union all select pair_id, 'baseline-missing-sources', 'warning' from x where b union all select pair_id, 'current-missing-sources', 'warning' from x where c""")
def activity_limitations(spark, d):
    o = T.with_freshness(B.observations(spark, d), F.lit("2001-08-01").cast("timestamp_ntz"))
    k = F.col("registry_id")
    gap = lambda n: F.when(k % n == 0, F.array(F.lit("ports"))).otherwise(F.array().cast("array<string>"))
    return E.limitations(o.select(k.alias("pair_id"), "freshness", gap(3).alias("base_missing"), gap(4).alias("current_missing"), F.when(k % 5 == 0, 2).otherwise(0).alias("n_supplements")))


_WORDS = ["", "Office Printer 5", "Kitchen speaker", "tvs", "Sam's Mobile", "old PC", "Router"]


@query(f"""with x as (select c_custkey as k, ({[w.replace("'", "") for w in _WORDS]!r})[c_custkey % 7 + 1] as w, c_custkey % 11 = 0 as gw, c_custkey % 2 = 0 as known, c_custkey % 3 = 0 as q, c_custkey % 5 = 0 as m from customer),
y as (select *, case c_custkey_mod when 1 then 'printer' when 2 then 'speaker' when 4 then 'phone' when 5 then 'computer' when 6 then 'gateway' end as told, case when m then 'speaker' when q and k % 4 > 0 then 'display' end as weak from (select *, k % 7 as c_custkey_mod from x))
select k as c_custkey, case when gw then 'gateway' when told is not null then told when known then 'generic' else 'unknown' end as kind, case when gw then 'role' when told is not null then 'inventory_text' when weak is not null then 'weak' else 'unknown' end as strength,
  case when not gw and told is null then weak end as weak_kind from y""")
def device_kinds(spark, d):
    k = F.col("c_custkey")
    words = F.get(F.array(*[F.lit(w) for w in _WORDS]), (k % 7).cast("int"))
    rows = B.read(spark, d, "customer").select(
        "c_custkey", F.when(k % 11 == 0, "gateway").otherwise("device").alias("role"), words.alias("name"), F.lit(None).cast("string").alias("notes"), (k % 2 == 0).alias("is_known"),
        F.filter(F.array(F.when(k % 3 == 0, "quic"), F.when(k % 5 == 0, "mdns")), lambda x: x.isNotNull()).alias("categories"), (k % 4).alias("external_peers"))
    return E.device_kind(rows).select("c_custkey", "kind", "strength", "weak_kind")


@query("select o_orderpriority, case o_orderpriority when '1-URGENT' then 'port scan' when '2-HIGH' then 'ARP snapshot' else 'other list' end as label, count(*) as n from orders group by all")
def source_labels(spark, d):
    p = F.col("o_orderpriority")
    rows = B.read(spark, d, "orders").withColumn("s", F.when(p == "1-URGENT", "ports").when(p == "2-HIGH", "arp_snapshot").otherwise("other_list"))
    return rows.groupBy(p, E.source_label("s").alias("label")).agg(F.count("*").alias("n"))
