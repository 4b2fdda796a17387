"""The standard tables seen as findings, packets, observations and devices; the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = (23, 445, 3389, 8080, 8443, 22, 80, 443, 3306, 6379, 9100, 631, 5353, 8000, 21, 1900)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """events as scan findings of two runs."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        F.col("event_id").alias("ord"), F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "base").otherwise("cur").alias("run"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 7).cast("string"), F.lit("."), F.col("user_id").cast("string")).alias("ip"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("host-"), F.col("event_id").cast("string"))).alias("hostname"),
        F.get(F.array(*[F.lit(p) for p in PORTS]), (k % 16).cast("int")).alias("port"), F.when(F.col("event_type") == "view", "udp").otherwise("tcp").alias("protocol"),
        F.when(F.col("event_type") == "error", "closed").otherwise("open").alias("state"), F.concat(F.lit("svc-"), "event_type").alias("service"),
    )
    return rows.filter(F.col("run") == run) if run else rows


FINDINGS = f"""
f as (select event_id as ord, case when ts < timestamp '2024-01-16' then 'base' else 'cur' end as run,
  '10.0.' || (user_id % 7) || '.' || user_id as ip, case when user_id % 5 = 0 then '' else 'host-' || event_id end as hostname,
  ({list(PORTS)})[cast(json_extract_string(props, '$.k') as bigint) % 16 + 1] as port, case when event_type = 'view' then 'udp' else 'tcp' end as protocol,
  case when event_type = 'error' then 'closed' else 'open' end as state, 'svc-' || event_type as service from events)"""

RISK = """
pr(port, risk) as (values (23,'P0'),(445,'P0'),(3389,'P0'),(3306,'P0'),(6379,'P0'),(8080,'P1'),(8443,'P1'),(8000,'P1'),(22,'P2'),(80,'P2'),(443,'P2'),(21,'P2'))"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom rules: nations as networks, regions as rules for all."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    ports = F.array(*[F.lit(p) for p in PORTS])
    own = nation.select(
        F.get(ports, F.col("n_nationkey") % 16).alias("port"), F.lit("tcp").alias("protocol"), F.lower("n_name").alias("network"),
        F.when(F.col("n_nationkey") % 3 == 0, "whitelist").otherwise("override").alias("action"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("P"), (F.col("n_nationkey") % 3).cast("string"))).alias("custom_risk"),
    )
    every = region.select(F.get(ports, F.col("r_regionkey") * 3).alias("port"), F.lit("tcp").alias("protocol"), F.lit("*").alias("network"), F.lit("override").alias("action"), F.lit("P1").alias("custom_risk"))
    return own.unionByName(every)


RULES = f"""
ru as (select ({list(PORTS)})[n_nationkey % 16 + 1] as port, 'tcp' as protocol, lower(n_name) as network,
    case when n_nationkey % 3 = 0 then 'whitelist' else 'override' end as action, case when n_nationkey % 4 <> 0 then 'P' || (n_nationkey % 3) end as custom_risk from nation
  union all select ({list(PORTS)})[r_regionkey * 3 + 1], 'tcp', '*', 'override', 'P1' from region),
nets as (select n_nationkey, lower(n_name) as network from nation)"""


def hosts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers by the keys of their orders, every fourth in the first run, as hosts of two runs."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ip"), (F.col("o_orderkey") % 4 == 0).alias("first"))
    return o.filter("first").drop("first"), o.filter("not first").drop("first")


HOSTS = """
o as (select o_custkey::varchar as ip, o_orderkey % 4 = 0 as first from orders),
ha as (select distinct ip from o where first),
hb as (select distinct ip from o where not first)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as packets between local suppliers and parts, two thirds of them outside."""
    li = read(spark, sf_dir, "lineitem")
    outside = F.col("l_partkey") % 3 != 0
    back = F.col("l_linenumber") % 2 == 0  # half the packets come back
    q = F.col("l_quantity").cast("int")
    sup, part = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    part_mac = F.when(outside, F.lit("gw")).otherwise(part)
    port = F.get(F.array(*[F.lit(p) for p in (443, 80, 53, 22, 3389, 8080, 445, 5353)]), F.col("l_partkey").cast("int") % 8)
    sup_port = F.lit(50000) + F.col("l_suppkey").cast("int") % 10
    both = lambda a, b: (F.when(back, b).otherwise(a), F.when(back, a).otherwise(b))
    (src_mac, dst_mac), (src_ip, dst_ip), (src_port, dst_port) = both(sup, part_mac), both(sup, part), both(sup_port, port)
    src_local, dst_local = both(F.lit(True), ~outside)
    group = (q == 1) & ~back
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_shipdate").alias("ts"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("orig_len"),
        src_mac.alias("src_mac"), dst_mac.alias("dst_mac"), F.when(q % 4 == 0, "udp").otherwise("tcp").alias("protocol"), src_ip.alias("src_ip"), dst_ip.alias("dst_ip"),
        src_port.alias("src_port"), dst_port.alias("dst_port"), src_local.alias("src_local"), dst_local.alias("dst_local"), group.alias("dst_broadcast"), (group & (F.col("l_suppkey") % 2 == 0)).alias("dst_mac_broadcast"),
        F.when(q % 4 == 0, F.concat(F.lit("n"), (F.col("l_partkey") % 50).cast("string"))).alias("dns_name"), F.when(q % 4 == 0, "dns").alias("dns_kind"),
    )


PACKETS = """
l as (select *, l_partkey % 3 <> 0 as outside, l_linenumber % 2 = 0 as back, cast(l_quantity as int) as q, 's' || l_suppkey as sup, 'p' || l_partkey as part,
  ([443, 80, 53, 22, 3389, 8080, 445, 5353])[l_partkey % 8 + 1] as port, 50000 + l_suppkey % 10 as sport from lineitem),
p as (select l_orderkey * 10 + l_linenumber as ord, l_shipdate as ts, cast(round(l_extendedprice * 100) as bigint) as orig_len,
  case when back then (case when outside then 'gw' else part end) else sup end as src_mac, case when back then sup else (case when outside then 'gw' else part end) end as dst_mac,
  case when q % 4 = 0 then 'udp' else 'tcp' end as protocol, case when back then part else sup end as src_ip, case when back then sup else part end as dst_ip,
  case when back then port else sport end as src_port, case when back then sport else port end as dst_port,
  case when back then not outside else true end as src_local, case when back then true else not outside end as dst_local, q = 1 and not back as dst_broadcast, q = 1 and not back and l_suppkey % 2 = 0 as dst_mac_broadcast,
  case when q % 4 = 0 then 'n' || (l_partkey % 50) end as dns_name, case when q % 4 = 0 then 'dns' end as dns_kind from l)"""

FLOWS = """
k as (select *, src_ip || '#' || src_port as a, case when dst_broadcast then 'broadcast#' || dst_port else dst_ip || '#' || dst_port end as b from p),
kk as (select *, protocol || '|' || case when dst_broadcast or a <= b then a || '|' || b else b || '|' || a end as flow_key from k),
fl as (select flow_key, protocol, arg_min(src_mac, ord) as src_mac, arg_min(dst_mac, ord) as dst_mac, arg_min(src_ip, ord) as src_ip, arg_min(dst_ip, ord) as dst_ip, arg_min(src_port, ord) as src_port, arg_min(dst_port, ord) as dst_port,
    arg_min(src_local, ord) as src_local, arg_min(dst_local, ord) as dst_local, arg_min(dst_broadcast, ord) as dst_broadcast,
    count(*)::bigint as packets, sum(orig_len)::bigint as bytes, min(ts) as first_seen, max(ts) as last_seen, min(ord) as first_ord, arg_min(a, ord) as init
  from kk group by flow_key, protocol),
fb as (select kk.flow_key, kk.protocol, sum(orig_len)::bigint as bytes_from_initiator from kk join fl on fl.flow_key = kk.flow_key and fl.protocol = kk.protocol and fl.init = kk.a group by all),
sv(protocol, port, category) as (values ('tcp',53,'dns'),('tcp',80,'http'),('tcp',443,'https'),('tcp',22,'ssh'),('tcp',445,'smb'),('tcp',3389,'rdp'),('udp',53,'dns'),('udp',5353,'mdns'),('udp',5355,'llmnr'),('udp',1900,'ssdp'),('udp',443,'quic')),
fs as (select fl.*, fb.bytes_from_initiator, case when src_local then src_mac end as from_device, case when dst_local and not dst_broadcast then dst_mac end as to_device, coalesce(d.category, s.category, 'other') as category, case when d.category is not null then fl.dst_port when s.category is not null then fl.src_port end as service_port,
    case when dst_broadcast then 'broadcast' when src_local and dst_local then 'internal' else 'external' end as scope
  from fl join fb on fb.flow_key = fl.flow_key and fb.protocol = fl.protocol left join sv d on d.protocol = fl.protocol and d.port = fl.dst_port left join sv s on s.protocol = fl.protocol and s.port = fl.src_port)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as observations of customers' sites."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("registry_id"), F.concat(F.lit("Site-"), F.col("o_custkey").cast("string")).alias("site"), F.col("o_orderdate").alias("observed_at"), (F.col("o_orderstatus") == "P").alias("partial"), F.col("o_orderkey").alias("ord"))


OBSERVATIONS = """
ob as (select o_orderkey as registry_id, 'Site-' || o_custkey as site, o_orderdate as observed_at, o_orderstatus = 'P' as partial, o_orderkey as ord from orders)"""


def devices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """customers as the devices of a base and a current observation; keys move with the key's remainder."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    base = c.filter(key % 11 != 0).select(
        text("b", key).alias("device_id"), F.when(key % 2 == 0, F.array(text("id", key))).otherwise(F.array().cast("array<string>")).alias("ids"),
        F.when(key % 5 == 0, F.array(text("m", F.floor(key / 10)))).otherwise(F.array(text("mm", key))).alias("macs"),
        F.array(text("h", key % 40)).alias("names"), F.array(text("ip", key)).alias("ips"),
    )
    current = c.filter(key % 13 != 0).select(
        text("c", key).alias("device_id"), F.when(key % 4 == 0, F.array(text("id", key))).otherwise(F.array().cast("array<string>")).alias("ids"),
        F.when(key % 5 == 0, F.array(text("m", F.floor(key / 10)))).when(key % 3 == 0, F.array(text("mx", key))).otherwise(F.array(text("mm", key))).alias("macs"),
        F.array(text("h", (key + 1) % 40)).alias("names"), F.array(text("ip", key + F.when(key % 7 == 0, 1).otherwise(0))).alias("ips"),
    )
    return base, current


DEVICES = """
b as (select 'b' || c_custkey as device_id, case when c_custkey % 2 = 0 then ['id' || c_custkey] else []::varchar[] end as ids,
  case when c_custkey % 5 = 0 then ['m' || (c_custkey // 10)] else ['mm' || c_custkey] end as macs, ['h' || (c_custkey % 40)] as names, ['ip' || c_custkey] as ips from customer where c_custkey % 11 <> 0),
c as (select 'c' || c_custkey as device_id, case when c_custkey % 4 = 0 then ['id' || c_custkey] else []::varchar[] end as ids,
  case when c_custkey % 5 = 0 then ['m' || (c_custkey // 10)] when c_custkey % 3 = 0 then ['mx' || c_custkey] else ['mm' || c_custkey] end as macs,
  ['h' || ((c_custkey + 1) % 40)] as names, ['ip' || (c_custkey + case when c_custkey % 7 = 0 then 1 else 0 end)] as ips from customer where c_custkey % 13 <> 0)"""
