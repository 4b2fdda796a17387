"""Queries of the comparison of observations, and lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar as S
from ..operators import comparison as C
from ..operators import findings as P
from ..operators import listings as L
from ..operators import observations as T
from ..operators import traffic as N
from . import bridges as B
from .registry import _OPEN, _RISKY, _open, _risky, _tier_sql, query

_PAIRED = f"""{B.DEVICES},
bb as (select substr(device_id, 2)::bigint % 3 as pair, device_id, ids, macs, []::varchar[] as hashed, names, ips from b),
cc as (select substr(device_id, 2)::bigint % 3 as pair, device_id, ids, macs, []::varchar[] as hashed, names, ips from c)"""
_KEYED = ", ".join(f"k{t} as (select pair || chr(31) || device_id as device_id, " + ", ".join(f"list_transform({x}, lambda v: pair || chr(31) || v) as {x}" for x in ("ids", "macs", "names", "ips")) + f" from {t}{t})" for t in "bc")
_MATCHED = f"""{_PAIRED}, {_KEYED}, {_tier_sql('kb', 'kc')},
mt as ({' union all '.join(f'select * from t{i}' for i in range(4))}),
ma as (select string_split(base_id, chr(31))[1] as pair_id, string_split(base_id, chr(31))[2] as base_id, string_split(current_id, chr(31))[2] as current_id, rule, confidence, outcome from mt)"""
_BEST = "case when len(ids) > 0 then 'strongest' when len(macs) > 0 then 'strong' when len(names) > 0 then 'medium' else 'low' end"
_VALUES = "array_to_string(list_sort(list_distinct(case when len(ids) > 0 then ids when len(macs) > 0 then macs when len(names) > 0 then names else ips end)), ',')"
_PORT_ROWS = """bp as (select pair, device_id, unnest([{'q': 'tcp', 'p': n % 7}, {'q': 'tcp', 'p': n % 5 + 100}]) as r from (select *, substr(device_id, 2)::bigint as n from bb)),
cp as (select pair, device_id, unnest([{'q': 'tcp', 'p': n % 7 + (n % 9 = 0)::int}, {'q': 'tcp', 'p': n % 5 + 100}]) as r from (select *, substr(device_id, 2)::bigint as n from cc))"""
_EVENTS = f"""{_MATCHED}, {_PORT_ROWS}, su as (select * from ma where outcome = 'confirmed'),
op as (select su.*, r from su join cp on cp.pair = su.pair_id and cp.device_id = su.current_id where su.pair_id <> '2' and not exists (select 1 from bp where bp.pair = su.pair_id and bp.device_id = su.base_id and bp.r = cp.r)),
cl as (select su.*, r from su join bp on bp.pair = su.pair_id and bp.device_id = su.base_id where su.pair_id <> '2' and not exists (select 1 from cp where cp.pair = su.pair_id and cp.device_id = su.current_id and cp.r = bp.r)),
mc as (select su.*, array_to_string(list_filter([case when bb.ips <> cc.ips then 'ips' end, case when bb.macs <> cc.macs then 'macs' end, case when bb.names <> cc.names then 'names' end], lambda x: x is not null), ',') as f
  from su join bb on bb.pair = su.pair_id and bb.device_id = su.base_id join cc on cc.pair = su.pair_id and cc.device_id = su.current_id),
ev as (select pair_id, 'identity-uncertain-possibly-same-device' as event_type, 'identity.uncertain' as rule_id, base_id, current_id, confidence, rule as identity_rule, '' as detail from ma where outcome = 'uncertain'
  union all select pair::varchar, 'new-device-observed', 'device.new-observed', null, device_id, case when pair = 1 then 'low' else {_BEST} end, 'no-baseline-match', {_VALUES} from cc where not exists (select 1 from ma where ma.pair_id = cc.pair and ma.current_id = cc.device_id)
  union all select pair::varchar, 'previously-observed-device-not-observed', 'device.not-observed', device_id, null, {_BEST}, 'no-current-match', {_VALUES} from bb where pair <> 2 and not exists (select 1 from ma where ma.pair_id = bb.pair and ma.base_id = bb.device_id)
  union all select pair_id, 'service-or-port-opened', 'port.opened', base_id, current_id, confidence, rule, r.q || ':' || r.p from op
  union all select pair_id, 'service-or-port-closed', 'port.closed', base_id, current_id, confidence, rule, r.q || ':' || r.p from cl
  union all select pair_id, 'important-device-metadata-changed', 'metadata.changed', base_id, current_id, confidence, rule, f from mc where f <> ''),
ei as (select *, substr(sha256(pair_id || chr(31) || event_type || chr(31) || coalesce(base_id, '') || chr(31) || coalesce(current_id, '') || chr(31) || rule_id || chr(31) || detail || chr(31) || identity_rule), 1, 16) as event_id from ev)"""


def _devices(spark, d):
    """Devices of three pairs of observations with their ports and coverage: the second base and the third current one have gaps."""
    pair = F.expr("cast(substring(device_id, 2) as bigint) % 3").alias("pair_id")
    n = F.expr("cast(substring(device_id, 2) as bigint)")
    none = F.array().cast("array<string>").alias("hashed")
    base, current = (x.select(pair, "device_id", "ids", "macs", none, "names", "ips") for x in B.devices(spark, d))

    def ports(devices, moved):
        row = lambda pos, port: F.struct(F.lit(pos).alias("pos"), F.lit("tcp").alias("protocol"), port.cast("int").alias("port"), F.lit("s").alias("service"))
        return devices.select("pair_id", "device_id", F.inline(F.array(row(0, n % 7 + moved), row(1, n % 5 + 100))))

    sources = ["ports", "discovery"]
    snapshots = C.coverage_snapshots(spark.createDataFrame(
        [(f"{side}{k}", None, False, "complete" if k != gap else "partial", sources if k != gap else ["discovery"], [] if k != gap else ["ports"] if side == "c" else ["hosts_up"]) for side, gap in (("b", 1), ("c", 2)) for k in range(3)],
        "obs_id string, observed_at timestamp, partial boolean, status string, present array<string>, missing array<string>"))
    snapshots = snapshots.withColumn("usable_ports", F.col("obs_id") != "c2")
    pairs = spark.createDataFrame([(k, f"b{k}", f"c{k}") for k in range(3)], "pair_id long, base_obs string, current_obs string")
    return base, current, ports(base, F.lit(0)), ports(current, F.when(n % 9 == 0, 1).otherwise(0)), C.pair_coverage(pairs, snapshots)


@query(f"with {_MATCHED} select pair_id, base_id, current_id, rule, confidence, outcome from ma")
def device_matches(spark, d):
    base, current, *_ = _devices(spark, d)
    return C.device_matches(base, current)


@query(f"with {_EVENTS} select pair_id, event_type, rule_id, base_id, current_id, confidence, identity_rule, detail, event_id from ei")
def comparison_events(spark, d):
    return C.ordered_events(*_devices(spark, d))


@query(f"""with {_EVENTS}, sj as (select pair, device_id, 'cur' as obs, case when len(ids) > 0 then 'persisted-device-id' else 'mac-address' end as kind, case when len(ids) > 0 then list_min(ids) else list_min(macs) end as target from cc
  union all select pair, device_id, 'base', case when len(ids) > 0 then 'persisted-device-id' else 'mac-address' end, case when len(ids) > 0 then list_min(ids) else list_min(macs) end from bb),
rs as (select case when c_custkey % 4 = 0 then 'persisted-device-id' else 'mac-address' end as kind, case when c_custkey % 4 = 0 then 'id' || c_custkey else 'mm' || c_custkey end as target,
  (['mine', 'guest', 'not_sure', 'investigate'])[c_custkey % 7 % 4 + 1] as state, case when c_custkey % 2 = 0 then 'cur' else 'old' end as obs from customer),
jn as (select ei.*, sj.target, sj.obs = rs.obs as same, rs.state as s, ei.confidence in ('strongest', 'strong') and ei.identity_rule = case when sj.kind = 'mac-address' then 'mac' else sj.kind end as ok
  from ei left join sj on sj.pair = ei.pair_id and sj.device_id = coalesce(ei.current_id, ei.base_id) and ei.event_type <> 'identity-uncertain-possibly-same-device' left join rs on rs.kind = sj.kind and rs.target = sj.target),
st as (select *, case when same or (s is not null and ok) then s end as state from jn)
select pair_id, event_id, event_type, target, state, coalesce(s is not null and not same and ok, false) as carried, case when state = 'investigate' then 'user-investigate' else 'normal' end as priority from st""")
def activity_events(spark, d):
    base, current, *rest = _devices(spark, d)
    shape = lambda x, obs: C.response_targets(x).select("pair_id", "device_id", F.lit(obs).alias("observation_id"), "target_kind", "target")
    k = F.col("c_custkey")
    own = k % 4 == 0
    responses = B.read(spark, d, "customer").select(
        F.when(own, "persisted-device-id").otherwise("mac-address").alias("target_kind"), F.concat(F.when(own, "id").otherwise("mm"), k.cast("string")).alias("target"),
        F.element_at(F.array(*[F.lit(x) for x in ("mine", "guest", "not_sure", "investigate")]), (k % 7 % 4 + 1).cast("int")).alias("state"), F.when(k % 2 == 0, "cur").otherwise("old").alias("observation_id"))
    return C.activity_events(C.change_events(base, current, *rest), shape(current, "cur").unionByName(shape(base, "base")), responses)


@query(f"""with {B.OBSERVATIONS}, x as (select *, lag(registry_id) over w as bid, lag(observed_at) over w as bat, lag(partial) over w as bpartial from ob window w as (partition by lower(site) order by observed_at, registry_id)),
y as (select registry_id as pair_id, partial or registry_id % 3 = 0 as ci, bpartial or bid % 3 = 0 as bi, not (registry_id % 3 = 0) as cp, not (bid % 3 = 0) as bp, epoch(timestamp '2001-08-01') - epoch(observed_at) > 37 * 86400 or epoch(timestamp '2001-08-01') - epoch(bat) > 37 * 86400 as stale from x where bid is not null)
select pair_id, 'partial-coverage' as code from y where ci or bi union all select pair_id, 'port-coverage-incomplete' from y where not (cp and bp) union all select pair_id, 'stale-data' from y where stale""")
def coverage_guardrails(spark, d):
    o = B.observations(spark, d)
    gap = F.col("registry_id") % 3 == 0
    names = lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
    rows = o.select(F.col("registry_id").alias("obs_id"), "observed_at", "partial", F.when(gap, "partial").otherwise("complete").alias("status"), F.when(gap, names("discovery")).otherwise(names("ports", "discovery")).alias("present"), F.when(gap, names("ports")).otherwise(names()).alias("missing"))
    pairs = T.adjacent_pairs(o).select(F.col("registry_id").alias("pair_id"), F.col("previous_id").alias("base_obs"), F.col("registry_id").alias("current_obs"))
    return C.guardrails(C.pair_coverage(pairs, C.coverage_snapshots(rows, F.lit("2001-08-01").cast("timestamp_ntz"))))


@query(f"""with {B.PACKETS}, n as (select dns_name || '.' || (ord % 3) || '.example.org' as name, count(*) as c from p where dns_name is not null group by 1), g as (select array_to_string(string_split(name, '.')[-2:], '.') as domain, sum(c)::bigint as n from n group by 1)
select domain, n from g order by n desc, domain limit 12""")
def dns_domains(spark, d):
    names = B.packets(spark, d).filter("dns_name is not null").withColumn("dns_name", F.concat("dns_name", F.lit("."), (F.col("ord") % 3).cast("string"), F.lit(".example.org")))
    return N.dns_domains(N.dns_names(names))


# lists and look-ups


@query(f"""with {_OPEN}, n(port, service_name, action) as (values {', '.join(f"({p}, {repr(dims.SERVICE_NAMES[p]) if p in dims.SERVICE_NAMES else 'null'}, {repr(dims.P0_ACTIONS[p]) if p in dims.P0_ACTIONS else 'null'})" for p in sorted(dims.P0_ACTIONS.keys() | dims.SERVICE_NAMES.keys()))})
select ord, ip, port::int as port, service_name, action from op left join n using (port)""")
def port_notes(spark, d):
    return L.with_port_notes(_open(spark, d), dims.port_notes(spark)).select("ord", "ip", "port", "service_name", "action")


@query(f"with {B.RULES} select port::int as port, protocol, network, action, custom_risk from ru where lower(network) = 'france' or network = '*'")
def rules_of_network(spark, d):
    return L.rule_order(L.in_network(B.rules(spark, d), "FRANCE", every=True))


@query(f"with {B.RULES} select distinct lower(network) as network from ru where network <> '*'")
def network_list(spark, d):
    return L.networks(B.rules(spark, d))


@query("select s_suppkey, s_name from supplier where contains(lower(s_name), '7') or contains(lower(coalesce(s_nationkey::varchar, '')), '7')")
def text_filter(spark, d):
    return L.with_text(B.read(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("note")), " 7 ", ["s_name", "note"]).select("s_suppkey", "s_name")


@query(f"with {B.OBSERVATIONS} select registry_id, site, observed_at from ob order by observed_at desc nulls last, registry_id limit 50 offset 100")
def observations_page(spark, d):
    return L.newest_first(B.observations(spark, d), "observed_at", "registry_id", 100, 50).select("registry_id", "site", "observed_at")


@query(f"with {B.PACKETS}, {B.FLOWS} select from_device, place, flow_key, bytes from (select from_device, flow_key, bytes, row_number() over (partition by from_device order by bytes desc, first_ord) as place from fs where from_device is not null) where place <= 8")
def device_top_flows(spark, d):
    rows = N.flow_devices(N.with_scope(N.services(N.flows(B.packets(spark, d)), dims.service_ports(spark)))).filter("from_device is not null")
    return L.first_of_each(rows, ["from_device"], [F.desc("bytes"), F.col("first_ord")], 8).select("from_device", "place", "flow_key", "bytes")


_RUNS = "rn as (select o_orderkey as run_uid, o_orderpriority as run_type, case when o_orderkey % 7 <> 0 then o_orderdate end as timestamp, o_custkey from orders)"


def _runs(spark, d):
    return B.read(spark, d, "orders").select(F.col("o_orderkey").alias("run_uid"), F.col("o_orderpriority").alias("run_type"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("timestamp"), "o_custkey")


@query(f"with {_RUNS} select run_uid, run_type from rn order by run_type <> '1-URGENT', timestamp desc nulls last, run_uid limit 1")
def default_run(spark, d):
    return L.default_run(_runs(spark, d), "1-URGENT").select("run_uid", "run_type")


@query(f"with {_RUNS}, x as (select run_uid, row_number() over (order by timestamp desc nulls last, run_uid) as k from rn) select max(case when k = 1 then run_uid end) as current_run, max(case when k = 2 then run_uid end) as baseline_run from x")
def default_pair(spark, d):
    return L.default_pair(_runs(spark, d))


@query(f"""with {_RUNS}, w as (select *, row_number() over (partition by o_custkey, run_type order by timestamp desc nulls last, run_uid desc) as k, lead(run_uid) over (partition by o_custkey, run_type order by timestamp desc nulls last, run_uid desc) as previous_run from rn)
select 'n' || o_custkey as network, run_type, run_uid, previous_run from w where k = 1""")
def newest_pairs(spark, d):
    return P.newest_pair(_runs(spark, d).withColumn("network", F.concat(F.lit("n"), F.col("o_custkey").cast("string"))))


@query(f"""with {_RUNS}, k as (select 'n' || (o_custkey % 50) as network, date_trunc('minute', timestamp::timestamp) as m, run_uid from rn)
select network, count(*) as n_runs, min(run_uid) as first_run, max(run_uid) as last_run from k group by network, m having count(*) > 1 and m is not null""")
def same_minute_guard(spark, d):
    return P.same_minute_guard(_runs(spark, d).filter("timestamp is not null").withColumn("network", F.concat(F.lit("N"), (F.col("o_custkey") % 50).cast("string"))))


@query(f"with {B.DEVICES}, x as (select b.device_id as base_id, list_concat(b.macs, b.ips) as u, list_concat(c.macs, c.ips) as v from b join c on substr(b.device_id, 2) = substr(c.device_id, 2)) select base_id, array_to_string(list_sort(list_intersect(u, v)), ',') as shared from x")
def shared_identity(spark, d):
    b, c = B.devices(spark, d)
    key = F.expr("substring(device_id, 2)").alias("k")
    both = b.select(F.col("device_id").alias("base_id"), key, F.concat("macs", "ips").alias("u")).join(c.select(key, F.concat("macs", "ips").alias("v")), "k")
    return L.shared_values(both, "u", "v").select("base_id", F.array_join("shared", ",").alias("shared"))


@query("select distinct unnest(string_split(o_orderpriority || '-' || o_orderstatus, '-')) as label from orders")
def label_sets(spark, d):
    return L.label_set(B.read(spark, d, "orders").select(F.split(F.concat("o_orderpriority", F.lit("-"), "o_orderstatus"), "-").alias("x")), "x")


@query(f"with {_RISKY} select risk as priority, count(*) as n from rk where risk is not null group by 1")
def priority_counts(spark, d):
    return L.priority_counts(_risky(spark, d).filter("risk is not null"))


@query(f"""with {_RISKY}, {B.HOSTS}, od as (select rk.* from rk where not exists (select 1 from ba y where y.ip = rk.ip and y.protocol = rk.protocol and y.port = rk.port)),
cd as (select ba.* from ba where not exists (select 1 from op y where y.ip = ba.ip and y.protocol = ba.protocol and y.port = ba.port)),
x as (select 'ports_opened' as part, count(*) as n from od union all select 'risky_exposures', count(*) from od where risk = 'P0' union all select 'ports_closed', count(*) from cd
  union all select 'new_hosts', count(*) from hb where ip not in (select ip from ha) union all select 'removed_hosts', count(*) from ha where ip not in (select ip from hb))
select part, n from x where n > 0""")
def change_counts(spark, d):
    base = _open(spark, d, "base")
    return L.change_counts(P.hosts_delta(*B.hosts(spark, d)), P.ports_opened(base, _risky(spark, d)), P.ports_closed(base, _open(spark, d)))


@query("""with x as (select c_custkey, case c_custkey % 5 when 0 then '/data/extracted/Home_' || lpad(to_hex(c_custkey), 8, '0') || '/rawscans/2024-01-02_0304_full' when 1 then 'data/rawscans/2024-01-02_0304_full' when 2 then 'up/Office' || c_custkey || '/rawscans/2024-01-02_0304_full'
  when 3 then 'Lab/2024-01-01_0000_quick/2024-01-02_0304_full' else 'x' end as k, c_custkey % 5 as m from customer)
select c_custkey, case m when 0 then 'home' when 1 then 'unknown' when 2 then 'office' || c_custkey when 3 then 'lab' else 'unknown' end as network from x""")
def network_guess(spark, d):
    k = F.col("c_custkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("/data/extracted/Home_"), F.lpad(F.hex(k), 8, "0"), F.lit("/rawscans/2024-01-02_0304_full"))).when(k % 5 == 1, "data/rawscans/2024-01-02_0304_full")
    path = path.when(k % 5 == 2, F.concat(F.lit("up/Office"), k.cast("string"), F.lit("/rawscans/2024-01-02_0304_full"))).when(k % 5 == 3, "Lab/2024-01-01_0000_quick/2024-01-02_0304_full").otherwise("x")
    return B.read(spark, d, "customer").select("c_custkey", L.network_of_path(path).alias("network"))


@query("""with x as (select o_orderkey as ord, o_orderkey as run_uid, sha256(array_to_string(list_sort([sha256((o_custkey % 90)::varchar), sha256(o_orderpriority)]), ':')) as content_hash from orders),
h as (select content_hash from x where ord % 400 = 0), n as (select * from x where ord % 400 <> 0 qualify row_number() over (partition by content_hash order by ord) = 1)
select ord, run_uid, content_hash from n where content_hash not in (select content_hash from h)""")
def registered_runs(spark, d):
    o = B.read(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("run_uid"), L.content_key(F.array(F.sha2((F.col("o_custkey") % 90).cast("string"), 256), F.sha2("o_orderpriority", 256))).alias("content_hash"))
    return L.register_runs(rows.filter("ord % 400 = 0"), rows.filter("ord % 400 <> 0"))


@query("select count(*) filter (where o_orderdate + interval 30 day >= timestamp '1998-01-01') as valid, count(*) filter (where o_orderdate + interval 30 day < timestamp '1998-01-01') as expired from orders")
def cache_stats(spark, d):
    return L.cache_stats(B.read(spark, d, "orders").select((F.col("o_orderdate") + F.expr("interval 30 days")).alias("expires_at")), F.lit("1998-01-01").cast("timestamp_ntz"))


@query("""select c_custkey, case when m < 8 then upper(printf('%02x:%02x:%02x:%02x:%02x:%02x', k % 256, (k // 2) % 256, 7, 8, 9, 10)) end as mac from (select c_custkey, c_custkey as k, c_custkey % 10 as m from customer)""")
def mac_forms(spark, d):
    k = F.col("c_custkey")
    pair = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    parts = [pair(k % 256), pair(F.floor(k / 2) % 256), *[pair(F.lit(x)) for x in (7, 8, 9, 10)]]
    forms = F.when(k % 10 < 3, F.concat_ws(":", *parts)).when(k % 10 < 6, F.concat_ws("-", *parts)).when(k % 10 < 8, F.concat(*parts)).otherwise(F.concat_ws(":", *parts[:5]))
    return B.read(spark, d, "customer").select("c_custkey", S.mac(forms).alias("mac"))


@query("""with x as (select c_custkey, c_custkey % 256 as a, c_custkey % 7 as m from customer), y as (select *, case m when 0 then '10.1.2.' || a when 1 then '172.' || a || '.0.1' when 2 then '192.168.' || a || '.1' when 3 then a || '.1.2.3' when 4 then 'fe80:0:0:0:0:0:0:' || a when 5 then 'ff02:0:0:0:0:0:0:1' else '169.254.0.' || a end as ip from x)
select c_custkey, case m when 0 then true when 1 then a between 16 and 31 when 2 then true when 3 then a in (10, 127) when 4 then true when 5 then false else true end as is_local, case m when 3 then a between 224 and 239 when 5 then true else false end as is_multicast from y""")
def address_kinds(spark, d):
    k = F.col("c_custkey")
    a, m = (k % 256).cast("string"), k % 7
    ip = F.when(m == 0, F.concat(F.lit("10.1.2."), a)).when(m == 1, F.concat(F.lit("172."), a, F.lit(".0.1"))).when(m == 2, F.concat(F.lit("192.168."), a, F.lit(".1"))).when(m == 3, F.concat(a, F.lit(".1.2.3")))
    ip = ip.when(m == 4, F.concat(F.lit("fe80:0:0:0:0:0:0:"), a)).when(m == 5, "ff02:0:0:0:0:0:0:1").otherwise(F.concat(F.lit("169.254.0."), a))
    return B.read(spark, d, "customer").select("c_custkey", S.is_local(ip).alias("is_local"), S.is_multicast(ip).alias("is_multicast"))
