"""Queries by name and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar as S
from ..operators import findings as P
from ..operators import identity as I
from ..operators import observations as T
from ..operators import traffic as N
from ..storage import saved
from . import bridges as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _open(spark, d, run="cur"):
    return P.open_ports(B.findings(spark, d, run))


def _risky(spark, d, run="cur"):
    return P.with_default_risk(_open(spark, d, run), dims.port_risk(spark))


_OPEN = B.FINDINGS + ", op as (select * from f where state = 'open' and run = 'cur'), ba as (select * from f where state = 'open' and run = 'base')"
_RISKY = _OPEN + "," + B.RISK + ", rk as (select op.*, pr.risk from op left join pr using (port))"


@query(f"with {_OPEN} select protocol, port::int as port, service, count(distinct ip) as hosts from op group by all order by hosts desc, port, protocol, service limit 25")
def top_ports(spark, d):
    return P.top_ports(_open(spark, d))


@query(f"""with {_RISKY}, h as (select protocol, port, risk, ip, min(ord) as ord, arg_min(service, ord) as service from rk group by all)
select protocol, port::int as port, risk, arg_min(service, ord) as service, count(*) as hosts_affected, string_agg(ip, ',' order by ord) as hosts from h group by protocol, port, risk""")
def risk_ports(spark, d):
    return P.risk_groups(_risky(spark, d)).withColumn("hosts", F.array_join("hosts", ","))


@query(f"""with {_OPEN}, {B.RISK}, {B.RULES},
x as (select op.ord, op.ip, op.port, op.protocol, nets.network, pr.risk as d, n.action as na, n.custom_risk as nc, g.action as ga, g.custom_risk as gc
  from op join nets on op.ord % 25 = nets.n_nationkey left join pr using (port) left join ru n on n.port = op.port and n.protocol = op.protocol and n.network = nets.network
  left join ru g on g.port = op.port and g.protocol = op.protocol and g.network = '*')
select ord, ip, port::int as port, protocol, network, case when na is not null then case when na = 'override' then nc end when ga is not null then case when ga = 'override' then gc end else d end as risk from x""")
def risk_with_rules(spark, d):
    nets = B.read(spark, d, "nation").select((F.col("n_nationkey")).alias("_k"), F.lower("n_name").alias("network"))
    rows = _open(spark, d).withColumn("_k", F.col("ord") % 25).join(F.broadcast(nets), "_k")  # 25 nations
    rows = P.with_effective_risk(rows, dims.port_risk(spark), B.rules(spark, d), F.col("network"))
    return rows.select("ord", "ip", "port", "protocol", "network", "risk")


@query(f"with {_RISKY} select count(distinct ip) as total_hosts, count(distinct nullif(service, '')) as services, count(*) as open_ports, count(distinct case when risk in ('P0','P1') then protocol || port end) as risk_ports, count(distinct case when risk = 'P0' then ip end) as p0_hosts from rk")
def scorecard_counts(spark, d):
    return P.scorecard_counts(_risky(spark, d))


@query(f"with {_RISKY}, g as (select protocol, port, risk, count(distinct ip) as n from rk group by all) select coalesce(risk, 'unclassified') as bucket, count(*) as n_groups, sum(n)::bigint as n_hosts from g group by 1")
def risk_buckets(spark, d):
    return P.risk_buckets(P.risk_group_counts(_risky(spark, d)))


@query(f"with {_RISKY} select protocol, port::int as port, count(distinct ip) as hosts from rk where risk = 'P0' group by all order by hosts desc, port, protocol limit 3")
def top_actions(spark, d):
    return P.top_actions(_risky(spark, d))


@query(f"with {_RISKY} select protocol, port::int as port, risk, ip, min(ord) as ord from rk group by all")
def risk_group_hosts(spark, d):
    return P.risk_group_hosts(_risky(spark, d))


@query(f"with {_OPEN} select ip, protocol, port::int as port, count(*) as n from op group by all")
def device_ports(spark, d):
    return P.device_ports(_open(spark, d))


@query(f"with {_OPEN} select ip, coalesce(arg_min(hostname, ord) filter (where hostname <> ''), '') as hostname, count(*) as n_ports from op group by ip")
def device_summary(spark, d):
    return P.device_counts(_open(spark, d))


_KEY_SQL = "select x.ord, x.ip, x.protocol, x.port::int as port, x.service from {a} x where not exists (select 1 from {b} y where y.ip = x.ip and y.protocol = x.protocol and y.port = x.port)"


@query(f"with {_OPEN} " + _KEY_SQL.format(a="op", b="ba"))
def ports_opened(spark, d):
    return P.ports_opened(_open(spark, d, "base"), _open(spark, d)).select("ord", "ip", "protocol", "port", "service")


@query(f"with {_OPEN} " + _KEY_SQL.format(a="ba", b="op"))
def ports_closed(spark, d):
    return P.ports_closed(_open(spark, d, "base"), _open(spark, d)).select("ord", "ip", "protocol", "port", "service")


@query(f"with {B.HOSTS} select 'new' as change, ip from hb where ip not in (select ip from ha) union all select 'removed', ip from ha where ip not in (select ip from hb)")
def hosts_delta(spark, d):
    return P.hosts_delta(*B.hosts(spark, d))


@query(f"""with {_RISKY}, {B.HOSTS}, od as (select rk.* from rk where not exists (select 1 from ba y where y.ip = rk.ip and y.protocol = rk.protocol and y.port = rk.port)),
s as (select count(*) filter (where risk = 'P0') as p0, count(*) filter (where risk = 'P1') as p1, count(*) as opened, (select count(*) from hb where ip not in (select ip from ha)) as new_hosts from od),
t as (select *, greatest(0, least(100, 100 - 15 * p0 - 5 * p1 - 3 * new_hosts - least(opened, 10)))::bigint as score from s)
select *, case when score >= 90 then 'Excellent' when score >= 70 then 'Good' when score >= 50 then 'Fair' when score >= 30 then 'Poor' else 'Critical' end as band from t""")
def diff_score(spark, d):
    opened = P.ports_opened(_open(spark, d, "base"), _risky(spark, d))
    return P.diff_score(opened, P.hosts_delta(*B.hosts(spark, d)))


@query(f"""with {_RISKY} select ord, ip, port::int as port, risk, risk || ' exposure: ' || protocol || '/' || port || case when service <> '' then ' ' || service else '' end as reason from rk where risk in ('P0', 'P1', 'P2')""")
def risky_rows(spark, d):
    return P.risky_rows(_risky(spark, d), dims.LEVELS).select("ord", "ip", "port", "risk", "reason")


# traffic


@query(f"with {B.PACKETS} select count(*) as packets, sum(orig_len)::bigint as bytes, min(ts) as first_seen, max(ts) as last_seen, count(*) filter (where ord % 10 = 7) as arp_packets, count(*) filter (where ord % 10 in (5, 6)) as icmp_packets, count(*) filter (where ord % 10 in (3, 4)) as ipv6_packets from p")
def capture_totals(spark, d):
    n = F.col("ord") % 10
    protocol = F.when(n == 7, "arp").when(n == 6, "icmp").when(n == 5, "icmpv6").otherwise(F.col("protocol"))
    six = lambda c, k: F.when(n == k, F.concat(F.lit("fe80::"), F.col(c))).otherwise(F.col(c))
    return N.totals(B.packets(spark, d).withColumns({"protocol": protocol, "src_ip": six("src_ip", 4), "dst_ip": six("dst_ip", 3)}))


@query(f"""with {B.PACKETS}, r as (
  select src_mac as mac, 1 as s, orig_len, ts, case when src_local then src_ip end as ip, case when not dst_broadcast and not dst_local then dst_ip end as peer, ord * 2 as seq, (dns_name is not null)::int as q from p
  union all select dst_mac, 0, orig_len, ts, case when dst_local and not dst_broadcast then dst_ip end, case when not dst_broadcast and not src_local then src_ip end, ord * 2 + 1, 0 from p where not dst_mac_broadcast)
select mac, count(*) filter (where s = 1) as packets_sent, count(*) filter (where s = 0) as packets_received, coalesce(sum(orig_len) filter (where s = 1), 0)::bigint as bytes_sent,
  coalesce(sum(orig_len) filter (where s = 0), 0)::bigint as bytes_received, min(ts) as first_seen, max(ts) as last_seen, 0::bigint as arp_packets, sum(q)::bigint as dns_queries, count(distinct ip) as local_ips, count(distinct peer) as external_peers, min(seq) as first_ord from r group by mac""")
def host_traffic(spark, d):
    return N.host_traffic(B.packets(spark, d))


@query(f"""with {B.PACKETS}, v as (select dst_mac as mac, dst_ip as ip, ord * 2 as seq from p where not dst_local and not dst_broadcast and not dst_mac_broadcast union all select src_mac, src_ip, ord * 2 + 1 from p where not src_local and not dst_broadcast)
select mac, least(10000, count(distinct ip)) as votes from v group by mac order by votes desc, min(seq) limit 1""")
def gateway_pick(spark, d):
    return N.gateway(B.packets(spark, d))


_FLOW_COLS = ["flow_key", "protocol", "src_mac", "dst_mac", "src_port", "dst_port", "packets", "bytes", "bytes_from_initiator", "first_seen", "last_seen", "first_ord"]


def _flows(spark, d):
    return N.flows(B.packets(spark, d))


def _served(spark, d):
    return N.with_scope(N.services(_flows(spark, d), dims.service_ports(spark)))


@query(f"""with {B.PACKETS}, {B.FLOWS} select flow_key, fl.protocol, fl.src_mac, fl.dst_mac, fl.src_port::int as src_port, fl.dst_port::int as dst_port, packets, bytes,
  (select sum(orig_len) from kk where kk.flow_key = fl.flow_key and kk.protocol = fl.protocol and kk.a = fl.init)::bigint as bytes_from_initiator, first_seen, last_seen, first_ord from fl""")
def flow_aggregate(spark, d):
    return _flows(spark, d).select(*_FLOW_COLS)


@query(f"""with {B.PACKETS}, {B.FLOWS}, t as (select flow_key from fl order by first_ord, flow_key limit 5000)
select count(distinct t.flow_key) as tracked_flows, count(t.flow_key) as tracked_packets, (count(*) - count(t.flow_key))::bigint as dropped_flow_packets from kk left join t using (flow_key)""")
def flow_cap_first_seen(spark, d):
    return N.flow_cap(B.packets(spark, d))


@query(f"with {B.PACKETS}, {B.FLOWS} select flow_key, category, service_port::int as service_port, scope from fs")
def service_categories(spark, d):
    return _served(spark, d).select("flow_key", "category", "service_port", "scope")


@query(f"with {B.PACKETS}, {B.FLOWS} select category, sum(bytes)::bigint as bytes, count(*) as n_flows from fs group by 1")
def category_bytes(spark, d):
    return N.category_bytes(_served(spark, d))


@query(f"""with {B.PACKETS}, {B.FLOWS}, s as (select sum(bytes)::bigint as bytes, sum(case when category in ('https','quic','ssh') then bytes else 0 end)::bigint as encrypted_bytes from fs)
select *, ((200 * encrypted_bytes + bytes) // (2 * bytes))::bigint as encrypted_pct from s""")
def encrypted_share(spark, d):
    return N.encrypted_share(_served(spark, d))


_ENDS = """e as (select src_ip as ip, orig_len, ord * 2 as seq from p where not src_local union all select dst_ip, orig_len, ord * 2 + 1 from p where not dst_local and not dst_broadcast),
g as (select ip, count(*) as packets, sum(orig_len)::bigint as bytes from e group by ip)"""


@query(f"with {B.PACKETS}, {_ENDS}, t as (select ip from g order by bytes desc, ip limit 200) select coalesce(t.ip, 'ext-other') as ip, sum(packets)::bigint as packets, sum(bytes)::bigint as bytes, count(*) as n_keys from g left join t using (ip) group by 1")
def endpoint_topk_overflow(spark, d):
    return N.top_with_overflow(N.endpoints(B.packets(spark, d)), "ip", "bytes", N.TOP_ENDPOINTS, "ext-other")


@query(f"with {B.PACKETS} select dns_kind, dns_name, count(*) as n from p where dns_name is not null group by all")
def dns_counts(spark, d):
    return N.dns_names(B.packets(spark, d)).select("dns_kind", "dns_name", "n")


_SENT = """x as (select from_device as device, bytes_from_initiator as sent from fs where scope = 'external' and from_device is not null
  union all select to_device, bytes - bytes_from_initiator from fs where scope = 'external' and to_device is not null),
ob as (select device, sum(sent)::bigint as bytes from x group by 1)"""


@query(f"with {B.PACKETS}, {B.FLOWS}, {_SENT} select device, bytes from ob")
def outbound_bytes(spark, d):
    return N.outbound_bytes(_served(spark, d))


@query(f"with {B.PACKETS}, {B.FLOWS}, t as (select flow_key, bytes, row_number() over (order by bytes desc, first_ord) as n from fl) select 'flow-' || n as flow_id, flow_key, bytes from t where n <= 500")
def surrogate_ids(spark, d):
    return N.numbered(_flows(spark, d), [F.desc("bytes"), F.col("first_ord")], "flow_id", "flow-", N.TOP_FLOWS).select("flow_id", "flow_key", "bytes")


@query(f"""with {B.PACKETS}, {B.FLOWS}, c as (select epoch(min(ts))::bigint as s, epoch(max(ts))::bigint as e from p), t as (select * from fl order by packets desc, first_ord limit 40),
x as (select flow_key, least(7, floor(log2(packets)))::bigint + 1 as n, (epoch(first_seen)::bigint - s)::double / greatest(1, e - s) as a, (epoch(last_seen)::bigint - s)::double / greatest(1, e - s) as b from t, c),
y as (select flow_key, n, a, b, unnest(range(0, n)) as event from x)
select flow_key, event::bigint as event, cast(round(1e6 * case when n = 1 then (a + b) / 2 else a + (b - a) * event / (n - 1) end) as bigint) as t_ppm from y""")
def timeline_events(spark, d):
    packets = B.packets(spark, d)
    span = packets.agg(F.unix_seconds(F.to_timestamp(F.min("ts"))).alias("_s"), F.unix_seconds(F.to_timestamp(F.max("ts"))).alias("_e")).withColumn("_k", F.lit(1))
    top = N.flows(packets).orderBy(F.desc("packets"), "first_ord").limit(40).withColumn("_k", F.lit(1)).join(F.broadcast(span), "_k")  # one row
    return N.timeline(top, F.col("_s"), F.col("_e")).select("flow_key", "event", F.round(F.col("t") * 1e6).cast("long").alias("t_ppm"))


_ADMIN = "(category in ('ssh', 'rdp') or coalesce(service_port in (22, 8080, 8443, 8888, 9000, 9090, 5985, 5986), false))"
_CRITICAL = "coalesce(service_port in (23, 445, 3389, 5900, 135, 139, 1080, 1433, 3306, 5432, 6379, 27017, 9200), false)"
_ALERTS = f"""{_SENT},
hr as (select src_mac as mac, case when not dst_broadcast and not dst_local then dst_ip end as peer, (dns_name is not null)::int as q, orig_len from p
  union all select dst_mac, case when not dst_broadcast and not src_local then src_ip end, 0, orig_len from p where not dst_mac_broadcast),
de as (select mac as device, count(distinct peer) as peers, sum(q)::bigint as dns, sum(orig_len)::bigint as total_bytes, mac like '%7' as known, coalesce(any_value(ob.bytes), 0) as outbound
  from hr left join ob on ob.device = hr.mac where mac <> 'gw' group by mac),
fr as (select 'admin-remote-ports' as rule, * from fs where {_ADMIN} union all select 'critical-ports', * from fs where {_CRITICAL} and category <> 'ssh' union all select 'unencrypted-http', * from fs where category = 'http'),
fd as (select rule, count(distinct d) as n from (select rule, from_device as d from fr union all select rule, to_device from fr) group by rule),
ft as (select rule, string_agg(flow_key, ',' order by bytes desc, first_ord) as flows from (select *, row_number() over (partition by rule order by bytes desc, first_ord) as k from fr) where k <= 10 group by rule),
fc as (select rule, count(*) as n, bool_or(scope = 'external') as outside from fr group by rule),
dc as (select count(*) filter (where dns > 150) as chatty, max(dns) as asked, (select count(*) from (select distinct dns_kind, dns_name from p where dns_name is not null)) as names from de),
al as (select 'unknown-device' as rule, 'review' as level, '' as subject, count(*) as n_devices, 0::bigint as n_flows, count(*) as value, '' as flows from de where not known having count(*) > 0
  union all select 'high-outbound-volume', 'review', device, 1, 0, outbound, '' from de where outbound > 52428800
  union all select 'many-external-endpoints', 'review', '', count(*), 0, max(peers), '' from de where peers > 25 having count(*) > 0
  union all select 'many-dns-queries', 'info', '', chatty, 0, case when chatty > 0 then asked else names end, '' from dc where chatty > 0 or names > 300
  union all select rule, case when outside and rule <> 'unencrypted-http' then 'watch' else 'review' end, '', fd.n, fc.n, fc.n, flows from fc join fd using (rule) join ft using (rule))"""


def _watched(spark, d):
    """Devices with their counters, served flows, and alerts."""
    packets = B.packets(spark, d)
    served = N.with_scope(N.services(N.flows(packets), dims.service_ports(spark)))
    served = saved(served.select("flow_key", "src_mac", "dst_mac", "src_local", "dst_local", "dst_broadcast", "bytes", "bytes_from_initiator", "first_ord", "category", "service_port", "scope"), "served")  # read several times
    devices = N.host_traffic(packets).withColumnRenamed("mac", "device").join(N.outbound_bytes(served).withColumnRenamed("bytes", "outbound_bytes"), "device", "left")
    devices = devices.select(
        "device", F.when(F.col("device") == "gw", "gateway").otherwise("device").alias("role"), F.col("device").endswith("7").alias("is_known"), "dns_queries", "external_peers",
        F.coalesce("outbound_bytes", F.lit(0)).alias("outbound_bytes"), (F.col("bytes_sent") + F.col("bytes_received")).alias("total_bytes"),
    )
    return devices, served, N.watch_rules(devices, served, N.dns_names(packets).agg(F.count("*").alias("n")))


@query(f"with {B.PACKETS}, {B.FLOWS}, {_ALERTS} select rule, level, subject, n_devices, n_flows, value, flows from al")
def watch_rules(spark, d):
    return N.alert_order(_watched(spark, d)[2])


@query(f"""with {B.PACKETS}, {B.FLOWS}, {_ALERTS}, n as (select count(*) as n, count(*) filter (where known) as k from de)
select 'devices' as stat, '' as name, n as value from n union all select 'known_devices', '', k from n union all select 'unknown_devices', '', n - k from n
union all select * from (select 'top_category', category, sum(bytes)::bigint as b from fs group by category order by b desc, category limit 3)
union all select * from (select 'busiest_device', device, total_bytes from de where total_bytes > 0 order by total_bytes desc, device limit 1)""")
def traffic_summary(spark, d):
    return N.summary_stats(*_watched(spark, d)[:2])


_ATTENTION = f"case when category = 'other' then 'unclassified' when category = 'http' then 'review' when {_ADMIN} or {_CRITICAL} then case when scope = 'external' then 'watch' else 'review' end else 'routine' end"


@query(f"with {B.PACKETS}, {B.FLOWS} select flow_key, {_ATTENTION} as attention from fs")
def flow_attention(spark, d):
    return N.attention(_served(spark, d)).select("flow_key", "attention")


@query(f"""with {B.PACKETS}, {B.FLOWS}, {_ALERTS}, li as (select rule, level, unnest(string_split(flows, ',')) as flow_key from al where flows <> '' and level in ('watch', 'review')),
lk as (select flow_key, max(case level when 'watch' then 3 else 2 end) as r, string_agg(distinct rule, ',' order by rule) as reasons from li group by 1),
ow as (select flow_key, {_ATTENTION} as a from fs)
select flow_key, (['routine', 'unclassified', 'review', 'watch'])[greatest(coalesce(r, 0), case a when 'watch' then 3 when 'review' then 2 when 'unclassified' then 1 else 0 end) + 1] as attention, coalesce(reasons, '') as reasons from ow left join lk using (flow_key)""")
def flow_attention_linked(spark, d):
    _, served, alerts = _watched(spark, d)
    return N.flow_attention_reasons(served, alerts).withColumn("reasons", F.array_join("reasons", ","))


_NODES = f"""hs as (select src_mac as mac, orig_len, ord * 2 as seq from p union all select dst_mac, orig_len, ord * 2 + 1 from p where not dst_mac_broadcast),
hk as (select mac, sum(orig_len)::bigint as total_bytes, min(seq) as first_ord from hs group by mac order by first_ord limit 512),
nd as (select mac, case when mac = 'gw' then 'gateway' else 'dev-' || row_number() over (partition by mac = 'gw' order by total_bytes desc, first_ord) end as node_id, case when mac = 'gw' then 'gateway' else 'device' end as role, total_bytes from hk),
es as (select src_ip as ip, orig_len, ord * 2 as seq from p where not src_local union all select dst_ip, orig_len, ord * 2 + 1 from p where not dst_local and not dst_broadcast),
ek as (select ip, sum(orig_len)::bigint as bytes, min(seq) as first_ord from es group by ip order by first_ord limit 2000),
en as (select ip, case when k <= 200 then 'ext-' || k else 'ext-other' end as node_id, bytes from (select *, row_number() over (order by bytes desc, first_ord) as k from ek)),
ed as (select fs.*, case when src_local then a.node_id else x.node_id end as from_id, case when dst_broadcast then 'broadcast' when dst_local then b.node_id else y.node_id end as to_id
  from fs left join nd a on a.mac = fs.src_mac left join nd b on b.mac = fs.dst_mac left join en x on x.ip = fs.src_ip left join en y on y.ip = fs.dst_ip),
ee as (select *, row_number() over (order by bytes desc, first_ord) as seq from ed where from_id is not null and to_id is not null qualify seq <= 500)"""


def _edges(spark, d):
    packets = B.packets(spark, d)
    nodes = N.node_ids(N.host_traffic(packets), N.gateway(packets))
    ends = N.endpoint_ids(N.endpoints(packets))
    return nodes, ends, N.flow_edges(_served(spark, d), nodes, ends)


@query(f"with {B.PACKETS}, {B.FLOWS}, {_NODES} select mac, node_id, role, total_bytes from nd")
def device_ids(spark, d):
    return _edges(spark, d)[0]


@query(f"with {B.PACKETS}, {B.FLOWS}, {_NODES} select ip, node_id, bytes from en")
def endpoint_ids(spark, d):
    return _edges(spark, d)[1]


@query(f"with {B.PACKETS}, {B.FLOWS}, {_NODES} select 'flow-' || seq as flow_id, from_id, to_id, category, service_port::int as service_port, scope, packets, bytes from ee")
def flow_edges(spark, d):
    return _edges(spark, d)[2]


@query(f"""with {B.PACKETS}, {B.FLOWS}, {_NODES}, x as (select from_id as node_id, category, seq from ee union all select to_id, category, seq from ee), y as (select node_id, category, min(seq) as seq from x group by all)
select node_id, string_agg(category, ',' order by seq) as categories from y group by node_id""")
def node_categories(spark, d):
    return N.node_categories(_edges(spark, d)[2]).withColumn("categories", F.array_join("categories", ","))


# observations over time


@query(f"with {B.OBSERVATIONS} select site, registry_id, observed_at, lag(registry_id) over w as previous_id, lag(observed_at) over w as previous_at, ((epoch(observed_at)::bigint - epoch(lag(observed_at) over w)::bigint) // 86400)::bigint as days from ob window w as (partition by lower(site) order by observed_at, registry_id) qualify lag(registry_id) over w is not null")
def adjacent_pairs(spark, d):
    return T.adjacent_pairs(B.observations(spark, d))


@query(f"""with {B.OBSERVATIONS}, j as (select c.site, c.registry_id as current_id, c.observed_at as current_at, b.registry_id as baseline_id, b.observed_at as baseline_at,
  row_number() over (partition by lower(c.site) order by c.observed_at desc, c.registry_id, b.observed_at desc, b.registry_id) as n
  from ob c join ob b on lower(b.site) = lower(c.site) and b.observed_at < c.observed_at and not b.partial where c.observed_at = (select max(observed_at) from ob z where lower(z.site) = lower(c.site)))
select site, current_id, current_at, baseline_id, baseline_at from j where n = 1""")
def latest_valid_pair(spark, d):
    return T.latest_valid_pair(B.observations(spark, d), ~F.col("partial"))


_FRESH = "case when partial then 'partial' when timestamp '2001-08-01' <= observed_at + interval 30 day then 'fresh' when timestamp '2001-08-01' <= observed_at + interval 37 day then 'aging' else 'stale' end"


@query(f"with {B.OBSERVATIONS} select registry_id, {_FRESH} as freshness from ob")
def freshness(spark, d):
    return T.with_freshness(B.observations(spark, d), F.lit("2001-08-01").cast("timestamp_ntz")).select("registry_id", "freshness")


@query(f"with {B.OBSERVATIONS} select {_FRESH} as freshness, count(*) as n from ob group by 1")
def freshness_counts(spark, d):
    return T.with_freshness(B.observations(spark, d), F.lit("2001-08-01").cast("timestamp_ntz")).groupBy("freshness").agg(F.count("*").alias("n"))


@query("""with x as (select o_orderkey as registry_id, list_filter(['ports','discovery','hosts_up','arp_snapshot','scan_metadata'], lambda s: s = 'ports' and o_orderkey % 2 = 0 or s = 'discovery' and o_orderkey % 3 = 0 or s = 'hosts_up' and o_orderkey % 5 <> 0 or s = 'arp_snapshot' and o_custkey % 2 = 0 or s = 'scan_metadata') as p from orders),
y as (select *, (case when list_contains(p,'ports') then 35 else 0 end + case when list_contains(p,'discovery') then 25 else 0 end + case when list_contains(p,'hosts_up') then 20 else 0 end + case when list_contains(p,'arp_snapshot') then 15 else 0 end + 5)::bigint as score_pct from x)
select registry_id, score_pct, (5 - len(p))::bigint as n_missing, case when score_pct < 35 then 'minimal' when len(p) = 5 then 'complete' else 'partial' end as status from y""")
def coverage_score(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    has = F.filter(F.array(F.when(k % 2 == 0, "ports"), F.when(k % 3 == 0, "discovery"), F.when(k % 5 != 0, "hosts_up"), F.when(c % 2 == 0, "arp_snapshot"), F.lit("scan_metadata")), lambda x: x.isNotNull())
    rows = T.coverage(B.read(spark, d, "orders").select(k.alias("registry_id"), has.alias("present")))
    return rows.select("registry_id", (F.col("score") * 100).cast("long").alias("score_pct"), F.size("missing").cast("long").alias("n_missing"), "status")


@query(f"with {B.OBSERVATIONS} select site, count(*) as n, max(observed_at) as last_seen, arg_max(registry_id, (observed_at, registry_id)) as last_id from ob group by site")
def site_options(spark, d):
    return T.site_options(B.observations(spark, d))


@query(f"with {B.OBSERVATIONS} select count(*) as n, count(distinct site) as sites, count(*) filter (where partial) as partials, min(observed_at) as first_seen, max(observed_at) as last_seen from ob")
def registry_stats(spark, d):
    return T.registry_stats(B.observations(spark, d))


@query(f"with {B.OBSERVATIONS} select registry_id, site, observed_at from ob where observed_at between timestamp '1996-01-01' and timestamp '1996-03-31 23:59:59.999'")
def period_filter(spark, d):
    return T.in_period(B.observations(spark, d), *T.day_range("1996-01-01", "1996-03-31")).select("registry_id", "site", "observed_at")


@query(f"with {B.OBSERVATIONS} select registry_id, site, observed_at from ob where lower(site) = (select lower(site) from ob order by observed_at desc, registry_id limit 1)")
def newest_site(spark, d):
    return T.newest_site(B.observations(spark, d)).select("registry_id", "site", "observed_at")


@query(f"with {B.OBSERVATIONS} select site, registry_id, observed_at from ob qualify row_number() over (partition by site order by observed_at, registry_id) = 1")
def dedupe_first(spark, d):
    return T.first_by_key(B.observations(spark, d), ["site"], ["observed_at", "registry_id"]).select("site", "registry_id", "observed_at")


_LADDER = """x as (select o_orderkey as ord, o_custkey as content_hash, case when o_orderkey % 3 <> 0 then o_custkey // 2 end as source_run_uid, o_custkey as observation_id from orders),
nw as (select * from x where ord % 4 <> 0), hd as (select * from x where ord % 4 = 0),
a as (select * from nw qualify row_number() over (partition by content_hash order by ord) = 1), b as (select * from a where content_hash not in (select content_hash from hd)),
c as (select * from b where source_run_uid is not null qualify row_number() over (partition by source_run_uid order by ord) = 1), e as (select * from b where source_run_uid is null qualify row_number() over (partition by observation_id order by ord) = 1)"""


@query(f"with {_LADDER} select ord, content_hash, source_run_uid, observation_id from c where source_run_uid not in (select source_run_uid from hd where source_run_uid is not null) union all select ord, content_hash, source_run_uid, observation_id from e where observation_id not in (select observation_id from hd where source_run_uid is null)")
def dedupe_ladder(spark, d):
    o = B.read(spark, d, "orders")
    x = o.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("content_hash"), F.when(F.col("o_orderkey") % 3 != 0, F.floor(F.col("o_custkey") / 2)).alias("source_run_uid"), F.col("o_custkey").alias("observation_id"))
    return T.dedupe_ladder(x.filter("ord % 4 <> 0"), x.filter("ord % 4 = 0"))


@query(f"""with {B.OBSERVATIONS} select registry_id, case when registry_id % 3 = 0 then 'different_sites' when registry_id % 5 = 0 then 'identical_observations'
  when observed_at < timestamp '1998-01-01' then 'reversed_chronology' when observed_at = timestamp '1998-01-01' then 'ambiguous_comparison' end as error_code from ob""")
def validation_codes(spark, d):
    o = B.observations(spark, d)
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    base = F.struct(F.when(F.col("registry_id") % 3 == 0, "elsewhere").otherwise(F.col("site")).alias("site"), F.when(F.col("registry_id") % 5 == 0, F.col("registry_id")).otherwise(-1).alias("id"), at.alias("at"))
    pairs = o.select("registry_id", base.alias("base"), F.struct("site", F.col("registry_id").alias("id"), F.col("observed_at").alias("at")).alias("current"))
    return T.validated_pairs(pairs).select("registry_id", "error_code")


# devices


_PAIRS = """jc as (select b.device_id as base_id, c.device_id as current_id, k from (select device_id, unnest({k}) as k from b) b join (select device_id, unnest({k}) as k from c) c using (k)),
cp as (select base_id, current_id, string_agg(distinct k, ',' order by k) as shared from jc group by all)"""


@query(f"with {B.DEVICES}, {_PAIRS.format(k='macs')} select base_id, current_id, shared from cp")
def identity_candidates(spark, d):
    return I.candidates(*B.devices(spark, d), "macs").withColumn("shared", F.array_join("shared", ","))


@query(f"with {B.DEVICES}, {_PAIRS.format(k='macs')} select base_id, current_id, count(*) over (partition by base_id) as n_base, count(*) over (partition by current_id) as n_current, count(*) over (partition by base_id) = 1 and count(*) over (partition by current_id) = 1 as \"unique\" from cp")
def identity_unique(spark, d):
    return I.unique_pairs(I.candidates(*B.devices(spark, d), "macs")).drop("shared")


def _tier_sql(b: str = "b", c: str = "c") -> str:
    """Each tier of pairs excludes what stronger ones have found."""
    parts, seen = [], []
    for rule, col, conf, ok in (("persisted-device-id", "ids", "strongest", True), ("mac", "macs", "strong", True), ("hostname-vendor", "names", "medium", False), ("ip-continuity", "ips", "low", False)):
        n = len(seen)
        gone = " and ".join(f"b.device_id not in (select base_id from t{i}) and c.device_id not in (select current_id from t{i})" for i in seen) or "true"
        parts.append(f"j{n} as (select distinct b.device_id as base_id, c.device_id as current_id from (select device_id, unnest({col}) as k from {b}) b join (select device_id, unnest({col}) as k from {c}) c using (k) where {gone})")
        one = "count(*) over (partition by base_id) = 1 and count(*) over (partition by current_id) = 1"
        parts.append(f"t{n} as (select base_id, current_id, '{rule}' as rule, '{conf}' as confidence, " + (f"case when {one} then 'confirmed' else 'uncertain' end" if ok else "'uncertain'") + f" as outcome from j{n})")
        seen.append(n)
    return ", ".join(parts)


_TIERS = {"persisted-device-id": "ids", "mac": "macs", "hostname-vendor": "names", "ip-continuity": "ips"}
_TIER_SQL = _tier_sql()
_ALL_TIERS = " union all ".join(f"select * from t{i}" for i in range(4))


@query(f"with {B.DEVICES}, {_TIER_SQL} {_ALL_TIERS}")
def identity_tiers(spark, d):
    return I.tiered(*B.devices(spark, d), _TIERS).drop("shared")


@query(f"with {B.DEVICES}, {_TIER_SQL}, m as ({_ALL_TIERS}) select 'new-device-observed' as event_type, device_id from c where device_id not in (select current_id from m) union all select 'previously-observed-device-not-observed', device_id from b where device_id not in (select base_id from m)")
def unmatched_devices(spark, d):
    b, c = B.devices(spark, d)
    return I.unmatched(b, c, I.matched_ids(I.outcomes(b, c, _TIERS)))


@query(f"""with {B.DEVICES}, {_TIER_SQL}, m as ({_ALL_TIERS}), w as (select *, count(*) over (partition by base_id) as nb, count(*) over (partition by current_id) as nc from m)
select 'base' as side, base_id as device_id, rule, confidence, max(outcome) as outcome, max(case when nb = 1 and nc = 1 then current_id end) as partner_id, count(*) as n_links from w group by base_id, rule, confidence
union all select 'current', current_id, rule, confidence, max(outcome), max(case when nb = 1 and nc = 1 then base_id end), count(*) from w group by current_id, rule, confidence""")
def identity_outcomes(spark, d):
    return I.outcomes(*B.devices(spark, d), _TIERS)


@query(f"""with {B.DEVICES}, pr as (select b.device_id as base_id, c.device_id as current_id, b.names as bn, c.names as cn, b.ips as bi, c.ips as ci from b join c on substr(b.device_id, 2) = substr(c.device_id, 2))
select base_id, current_id, 'names' as field, array_to_string(bn, ',') as before, array_to_string(cn, ',') as after from pr where bn <> cn union all select base_id, current_id, 'ips', array_to_string(bi, ','), array_to_string(ci, ',') from pr where bi <> ci""")
def metadata_changes(spark, d):
    b, c = B.devices(spark, d)
    key = F.expr("substring(device_id, 2)").alias("k")
    pairs = b.select(F.col("device_id").alias("base_id"), key).join(c.select(F.col("device_id").alias("current_id"), key), "k")
    return I.metadata_changes(pairs, b, c, ["names", "ips"])


@query(f"""with {_OPEN}, x as (select ip, protocol, port, arg_max(service, ord) as s from ba group by all), y as (select ip, protocol, port, arg_max(service, ord) as s from op group by all),
m as (select distinct ba.ip from ba join op using (ip)),
z as (select coalesce(x.ip, y.ip) as ip, coalesce(x.protocol, y.protocol) as protocol, coalesce(x.port, y.port) as port, x.s as xs, y.s as ys from x full join y on x.ip = y.ip and x.protocol = y.protocol and x.port = y.port)
select ip as base_id, ip as current_id, case when xs is null then 'service-or-port-opened' else 'service-or-port-closed' end as change, protocol, port::int as port, coalesce(ys, xs) as service from z join m using (ip) where xs is null or ys is null""")
def matched_port_delta(spark, d):
    b, c = _open(spark, d, "base"), _open(spark, d)
    shape = lambda f: f.select(F.col("ip").alias("device_id"), F.col("ord").alias("pos"), "protocol", "port", "service")
    pairs = b.select("ip").distinct().join(c.select("ip").distinct(), "ip").select(F.col("ip").alias("base_id"), F.col("ip").alias("current_id"))
    return I.port_delta(pairs, shape(b), shape(c))


_INVENTORY = """iv as (select s_suppkey as ord, 'm' || (s_suppkey % 60) as mac, case when s_suppkey % 4 = 0 then null else 'ip' || (s_suppkey * 3) end as ip, s_name as item from supplier),
ho as (select c_custkey, 'M' || c_custkey as mac, ['ip' || c_custkey, 'ip' || (c_custkey + 1)] as ips from customer)"""


def _inventory(spark, d):
    s = F.col("s_suppkey")
    inv = B.read(spark, d, "supplier").select(s.alias("ord"), F.concat(F.lit("m"), (s % 60).cast("string")).alias("mac"), F.when(s % 4 != 0, F.concat(F.lit("ip"), (s * 3).cast("string"))).alias("ip"), F.col("s_name").alias("item"))
    k = F.col("c_custkey")
    c = B.read(spark, d, "customer")
    return c.select(F.concat(F.lit("M"), k.cast("string")).alias("mac"), F.array(F.concat(F.lit("ip"), k.cast("string")), F.concat(F.lit("ip"), (k + 1).cast("string"))).alias("ips")), inv


@query(f"""with {_INVENTORY}, bm as (select upper(mac) as m, arg_min(item, ord) as item from iv group by 1),
bi as (select h.mac, arg_min(iv.item, iv.ord) as item from (select mac, unnest(ips) as ip from ho) h join iv using (ip) group by 1)
select ho.mac, coalesce(bm.item, bi.item) as item from ho left join bm on bm.m = upper(ho.mac) left join bi on bi.mac = ho.mac""")
def inventory_match(spark, d):
    return I.inventory_match(*_inventory(spark, d)).select("mac", "item")


@query(f"with {_INVENTORY}, h as (select mac, ips[1] as ip from ho) select mac, ip from h where upper(mac) in (select upper(mac) from iv) or ip in (select ip from iv where ip is not null)")
def known_semi(spark, d):
    hosts, inv = _inventory(spark, d)
    return I.known(hosts.select("mac", F.get("ips", F.lit(0)).alias("ip")), inv)


@query(f"with {_INVENTORY}, h as (select mac, ips[1] as ip from ho) select mac, ip from iv union all select mac, ip from h where upper(mac) not in (select upper(mac) from iv) and ip not in (select ip from iv where ip is not null)")
def inventory_insert(spark, d):
    hosts, inv = _inventory(spark, d)
    return I.insert_absent(inv.select("mac", "ip"), hosts.select("mac", F.get("ips", F.lit(0)).alias("ip")))


@query("""with u as (select o_custkey as k, o_orderkey as seq, o_orderpriority as state, o_orderdate as created_from, o_orderkey % 2 as w from orders)
select k, arg_max(seq, (w, seq)) as seq, arg_max(state, (w, seq)) as state, arg_min(created_from, (w, seq)) as created_from from u group by k""")
def upsert_rows(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("state"), F.col("o_orderdate").alias("created_from"))
    return I.upsert(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"), ["k"], "seq", keep=("created_from",))


@query()  # recursive SQL grows with the square of a component
def connected_records(spark, d):
    from ..operators.graph import connected

    k = F.col("c_custkey")
    c = B.read(spark, d, "customer")
    edge = lambda rows, b: rows.select(F.concat(F.lit("r"), k.cast("string")).alias("a"), F.concat(F.lit("k"), b.cast("string")).alias("b"))
    return connected(edge(c, k % 37).unionByName(edge(c.filter((k % 4 < 2) & (k % 37 > 30)), F.floor(k / 4) + 100)))


# text and scalars


_WS = r"\t\n\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_REDACT_SQL = rf"""
a as (select doc_id, regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g') as t from documents),
b as (select doc_id, regexp_replace(t, '<[?]?xml\b[^>]*>|<nmaprun\b[^>]*>|<host\b[^>]*>|<packet\b[^>]*>|</(nmaprun|host|packet)>', '[redacted raw evidence]', 'gi') as t from a),
c as (select doc_id, regexp_replace(t, '\bpcap(ng)?[{_WS}]+global[{_WS}]+header\b|\braw[{_WS}]+(packet|payload|scan|capture)\b', '[redacted raw evidence]', 'gi') as t from b),
d as (select doc_id, regexp_replace(t, '\b(api[_-]?key|secret|password|token)[{_WS}]*[:=][{_WS}]*[^{_WS},;]+', '[redacted secret]', 'gi') as t from c),
e as (select doc_id, regexp_replace(regexp_replace(t, '\bsk-[A-Za-z0-9_-]{{10,}}\b', '[redacted secret]', 'g'), 'BEGIN (RSA |OPENSSH |EC |DSA )?PRIVATE KEY', '[redacted secret]', 'gi') as t from d),
f as (select doc_id, regexp_replace(t, '\b({_OCTET}[.]){{3}}{_OCTET}\b', '[redacted ip]', 'g') as t from e),
g as (select doc_id, regexp_replace(t, '\b([0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}\b|\b[0-9A-Fa-f]{{4}}[.][0-9A-Fa-f]{{4}}[.][0-9A-Fa-f]{{4}}\b', '[redacted mac]', 'g') as t from f),
h as (select doc_id, regexp_replace(t, '[A-Za-z]:\\[^{_WS},;)"'']+', '[redacted path]', 'g') as t from g),
i as (select doc_id, regexp_replace(t, '\\\\[^\\{_WS}]+\\[^{_WS},;)"'']+', '[redacted path]', 'g') as t from h),
j as (select doc_id, regexp_replace(t, '/(home|tmp|Users|var|etc|workspace|opt)/[^{_WS},;)"'']*', '[redacted path]', 'g') as t from i),
k as (select doc_id, regexp_replace(regexp_replace(t, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '[{_WS}]+', ' ', 'g') as t from j)"""


@query(f"with {_REDACT_SQL} select doc_id, md5(case when t = '' then '[redacted]' else substr(t, 1, 800) end) as redacted_md5 from k")
def redact_text(spark, d):
    return B.read(spark, d, "documents").select("doc_id", F.md5(S.redact("text").cast("binary")).alias("redacted_md5"))


@query("""with h as (select page_id, list_filter(string_split(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.'), lambda x: x <> '') as l from pages)
select page_id, array_to_string(case when len(l) <= 2 then l else l[-2:] end, '.') as domain from h""")
def domain_summary(spark, d):
    return B.read(spark, d, "pages").select("page_id", S.domain_summary(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("domain"))


@query("""with x as (select c_custkey, c_custkey % 5 as n, lpad(to_hex(c_custkey * 7919), 12, '0') as m from customer)
select c_custkey, case n when 0 then '—' when 1 then '…' else m[1:2] || ':' || m[3:4] || ':' || m[5:6] || ':••:••:••' end as masked_mac,
  case n when 0 then (c_custkey % 300) || '.' || (c_custkey % 256) || '.•.•' when 1 then 'fe80:…' when 2 then 'host.' || c_custkey when 3 then '::' || c_custkey else 'node' || c_custkey end as masked_ip from x""")
def mask_identifiers(spark, d):
    k = F.col("c_custkey")
    n, text = k % 5, k.cast("string")
    pairs = F.regexp_replace(F.lpad(F.hex(k * 7919), 12, "0"), "(..)(?=.)", "$1:")
    ip = F.when(n == 0, F.concat_ws(".", k % 300, k % 256, F.lit("0"), k % 250)).when(n == 1, F.concat(F.lit("fe80::"), text)).when(n == 2, F.concat(F.lit("host."), text)).when(n == 3, F.concat(F.lit("::"), text)).otherwise(F.concat(F.lit("node"), text))
    rows = B.read(spark, d, "customer").select(k, F.when(n == 0, "").when(n == 1, F.concat(F.lit("m:"), text)).otherwise(pairs).alias("m"), ip.alias("ip"))
    return rows.select("c_custkey", S.mask_mac("m").alias("masked_mac"), S.mask_ip("ip").alias("masked_ip"))


@query()  # white space beyond ASCII is another in DuckDB
def text_normalize(spark, d):
    return B.read(spark, d, "conversations").select("conv_id", "turn", F.md5(S.identity_text("text").cast("binary")).alias("text_md5"))


@query("select c_custkey, substr(sha256(c_name || chr(31) || c_nationkey || chr(31) || coalesce(nullif(c_mktsegment, 'BUILDING'), '')), 1, 16) as id from customer")
def hash_ids(spark, d):
    return B.read(spark, d, "customer").select("c_custkey", S.short_hash("c_name", "c_nationkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))).alias("id"))


@query("""select s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_note":null,"s_suppkey":' || s_suppkey || '}') as json_sha from supplier""")
def canonical_json(spark, d):
    rows = B.read(spark, d, "supplier").withColumn("s_note", F.lit(None).cast("string"))
    return rows.select("s_suppkey", F.sha2(S.canonical_json("s_suppkey", "s_name", "s_note", "s_nationkey"), 256).alias("json_sha"))


@query("""with x as (select l_orderkey, l_linenumber, l_partkey * l_partkey * (case when l_linenumber % 3 = 0 then 3701 when l_linenumber % 3 = 1 then 37 else -1 end) as n from lineitem)
select l_orderkey, l_linenumber, case when n < 0 then '0 B' when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f', round(n / 1024.0::double, 1)) || ' KB'
  when n < 1073741824 then printf('%.1f', round(n / 1048576.0::double, 1)) || ' MB' else printf('%.2f', round(n / 1073741824.0::double, 2)) || ' GB' end as size from x""")
def format_bytes(spark, d):
    times = F.when(F.col("l_linenumber") % 3 == 0, 3701).when(F.col("l_linenumber") % 3 == 1, 37).otherwise(-1)
    return B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.format_bytes(F.col("l_partkey") * F.col("l_partkey") * times).alias("size"))


@query("""with x as (select l_orderkey, l_linenumber, case when l_linenumber = 7 then null when l_linenumber = 6 then -1 else l_partkey * l_partkey * l_linenumber end as ms from lineitem),
y as (select *, ms / 1000.0::double as s from x)
select l_orderkey, l_linenumber, case when ms is null or ms < 0 then 'an unknown amount of time' when s < 1 then 'under a second' when s < 90 then 'about ' || floor(s + 0.5)::bigint || ' seconds'
  when s / 60 < 90 then 'about ' || floor(s / 60 + 0.5)::bigint || case when floor(s / 60 + 0.5) = 1 then ' minute' else ' minutes' end else 'about ' || printf('%.1f', round(s / 3600, 1)) || ' hours' end as duration from y""")
def format_durations(spark, d):
    ms = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 6, -1).otherwise(F.col("l_partkey") * F.col("l_partkey") * F.col("l_linenumber"))
    return B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.format_duration(ms).alias("duration"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, (epoch_us(ts) // 60000000)::bigint as minute_key, greatest(0, (epoch_us(timestamp '2024-02-01') // 1000000 - epoch_us(ts) // 1000000) // 86400)::bigint as days from events""")
def date_keys(spark, d):
    rows = B.read(spark, d, "events")
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), S.minute_key("ts").alias("minute_key"), S.whole_days("ts", F.lit("2024-02-01")).alias("days"))


@query("""select doc_id, case when contains(text, ',') or contains(text, '"') or contains(text, chr(10)) or contains(text, chr(13)) then md5('"' || replace(text, '"', '""') || '"') else md5(text) end as field_md5 from documents""")
def csv_fields(spark, d):
    return B.read(spark, d, "documents").select("doc_id", F.md5(S.csv_field("text").cast("binary")).alias("field_md5"))
