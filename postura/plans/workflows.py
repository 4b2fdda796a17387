"""Queries of inventories, registries, captures' limits, canonical forms and statements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import canonical as K
from ..functions import labels as LB
from ..operators import capture_devices as CD
from ..operators import device_keys as D
from ..operators import findings as P
from ..operators import identity as I
from ..operators import inventory as V
from ..operators import limits as M
from ..operators import orders as O
from ..operators import reports as RP
from ..operators import statement as ST
from ..operators.identity import TIERS
from ..sources import ingest as G
from . import bridges as B
from .registry import _RISKY, _open, _risky, query


# ordered import of an inventory


def _items(spark, d):
    """customers as a list to import: blocks of keys share MACs and addresses by turns."""
    c = B.read(spark, d, "customer")
    k = F.col("c_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    rows = c.select(
        F.concat(F.lit("net-"), (k % 5).cast("string")).alias("network"), text("d", k).alias("id"), k.alias("ord"), F.col("c_name").alias("device"),
        F.when(k % 7 == 0, "").when(k % 2 == 0, text("aa:", F.floor(k / 10))).otherwise(text("AA:", F.floor((k + 4) / 10))).alias("mac"), F.col("c_mktsegment").alias("vendor"),
        F.when(k % 11 == 0, "").otherwise(text("10.", F.floor((k + 7) / 15))).alias("ip"), F.lit("h").alias("hostnames"), F.lit("unknown").alias("status"), F.lit("").alias("notes"), F.lit("").alias("security"),
        F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("added_at"), F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("updated_at"),
    )
    return rows.filter("ord % 4 = 0"), rows.filter("ord % 4 <> 0")


@query("""with recursive it as (
  select 'net-' || (c_custkey % 5) as network, 'd' || c_custkey as id, c_custkey as ord, c_name as device, case when c_custkey % 7 = 0 then '' when c_custkey % 2 = 0 then 'aa:' || (c_custkey // 10) else 'AA:' || ((c_custkey + 4) // 10) end as mac,
    case when c_custkey % 11 = 0 then '' else '10.' || ((c_custkey + 7) // 15) end as ip from customer),
hd as (select *, upper(mac) as m from it where ord % 4 = 0),
hk as (select network, kind, k, max(ord) as owner from (select network, 'mac' as kind, m as k, ord from hd union all select network, 'ip', ip, ord from hd) where k <> '' group by all),
nw as (select it.*, upper(it.mac) as m, a.owner as by_mac, b.owner as by_ip, row_number() over (partition by it.network order by it.ord) as n from it left join hk a on a.network = it.network and a.kind = 'mac' and a.k = upper(it.mac)
  left join hk b on b.network = it.network and b.kind = 'ip' and b.k = it.ip where it.ord % 4 <> 0),
w as (
  select network, 0::bigint as n, []::varchar[] as macs, []::bigint[] as mac_ords, []::varchar[] as ips, []::bigint[] as ip_ords, null::bigint as ord, false as fresh, null::bigint as target, 0 as side from (select distinct network from nw)
  union all
  select x.network, x.n, case when x.fresh and x.m <> '' then list_append(x.macs, x.m) else x.macs end, case when x.fresh and x.m <> '' then list_append(x.mac_ords, x.ord) else x.mac_ords end,
    case when x.fresh and x.ip <> '' then list_append(x.ips, x.ip) else x.ips end, case when x.fresh and x.ip <> '' then list_append(x.ip_ords, x.ord) else x.ip_ords end, x.ord, x.fresh,
    coalesce(x.by_mac, x.new_mac, x.by_ip, x.new_ip), case when x.by_mac is not null then 0 when x.new_mac is not null then 1 when x.by_ip is not null then 0 else 1 end
  from (select *, by_mac is null and by_ip is null and new_mac is null and new_ip is null as fresh from (
    select nw.network, nw.n, w.macs, w.mac_ords, w.ips, w.ip_ords, nw.ord, nw.m, nw.ip, nw.by_mac, nw.by_ip,
      case when nw.m <> '' then w.mac_ords[list_position(w.macs, nw.m)] end as new_mac, case when nw.ip <> '' then w.ip_ords[list_position(w.ips, nw.ip)] end as new_ip
    from w join nw on nw.network = w.network and nw.n = w.n + 1)) x),
l as (select w.network, w.side, w.target as ord, arg_max(nw.device, nw.ord) as device, arg_max(nw.mac, nw.ord) as mac, arg_max(nw.ip, nw.ord) as ip, count(*) as n from w join nw on nw.network = w.network and nw.ord = w.ord where not w.fresh group by all),
bs as (select network, 0 as side, ord, id, device, mac, ip from hd union all select nw.network, 1, nw.ord, nw.id, nw.device, nw.mac, nw.ip from nw join w on w.network = nw.network and w.ord = nw.ord where w.fresh)
select bs.network, bs.id, coalesce(l.device, bs.device) as device, coalesce(l.mac, bs.mac) as mac, coalesce(l.ip, bs.ip) as ip, l.n is not null as updated from bs left join l using (network, side, ord)""")
def inventory_import(spark, d):
    held, new = _items(spark, d)
    rows = V.imported(held, new, F.to_timestamp(F.lit("2026-02-01 00:00:00")))
    return rows.select("network", "id", "device", "mac", "ip", (F.col("updated_at") > F.col("added_at")).alias("updated"))


# limits of a capture


_LIMITS = {"flow": 1500, "host": 90, "endpoint": 400, "name": 30}
_MOST = 15_000
_KINDS = " union all ".join(f"select capture, '{kind}' as kind, {k} as k, ord * 2 + {back} as seq from kk where {when}" for kind, k, back, when in (
    ("flow", "flow_key", 0, "true"), ("host", "src_mac", 0, "true"), ("host", "dst_mac", 1, "not dst_mac_broadcast"), ("endpoint", "src_ip", 0, "not src_local"), ("endpoint", "dst_ip", 1, "not dst_local and not dst_broadcast"), ("name", "dns_kind || '|' || dns_name", 0, "dns_name is not null")))


@query(f"""with {B.PACKETS.replace(" as ord,", " as ord, 'c' || (l_orderkey % 7)::int // 3 as capture,")},
n as (select capture, count(*) as n from p group by 1), ct as (select capture, ord as cut from p qualify row_number() over (partition by capture order by ord) = {_MOST}), pp as (select p.* from p left join ct using (capture) where cut is null or ord <= cut),
k as (select *, src_ip || '#' || src_port as a, case when dst_broadcast then 'broadcast#' || dst_port else dst_ip || '#' || dst_port end as b from pp),
kk as (select *, protocol || '|' || case when dst_broadcast or a <= b then a || '|' || b else b || '|' || a end as flow_key from k),
u as ({_KINDS}), y as (select capture, kind, k, min(seq) as first, count(*) as uses from u group by all),
r as (select *, row_number() over (partition by capture, kind order by first, k) <= case kind {" ".join(f"when '{k}' then {v}" for k, v in _LIMITS.items())} end as t from y)
select capture, kind, count(*) filter (where t) as tracked, count(*) filter (where not t) as dropped, coalesce(sum(uses) filter (where t), 0)::bigint as uses, coalesce(sum(uses) filter (where not t), 0)::bigint as dropped_uses,
  kind <> 'host' and count(*) filter (where not t) > 0 as truncated from r group by capture, kind
union all select capture, 'packet', least(n, {_MOST}), greatest(n - {_MOST}, 0), least(n, {_MOST}), greatest(n - {_MOST}, 0), n >= {_MOST} from n""")
def capture_limits(spark, d):
    packets = B.packets(spark, d)
    capture = F.concat(F.lit("c"), F.floor((F.floor(F.col("ord") / 10) % 7) / 3).cast("string"))
    return M.limit_counts(packets.withColumn("capture", capture), _MOST, _LIMITS)


# canonical forms and ids


@query(r"""with t as (select conv_id, turn, role, to_json(text)::varchar as s, len(text) as n from conversations)
select conv_id, turn, sha256('{"a":[' || s || ',{"x":null,"y":' || n || '.5},[]],"b":{"A":true,"b":{"deep":[1,[2,{"k":' || s || '}]]},"é":' || (n * 10) || '},"role":"' || role || '","turn":' || turn || '}') as json_sha,
  'chg-' || substr(sha256('{"at":[{"n":' || n || '}],"text":' || s || '}'), 1, 16) as event_id from t""")
def canonical_documents(spark, d):
    t = B.read(spark, d, "conversations")
    s, n = F.to_json(F.array("text")), F.length("text").cast("string")
    s = F.substr(s, F.lit(2), F.length(s) - 2)
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    part = cat('{"\\u00e9": ', n, '0, "b": {"deep": [1.0, [2, {"k": ', s, '}]]} , "A": true}')
    arr = cat('[', s, ', {"y": ', n, '.50, "x": null}, [ ]]')
    turn, role = F.col("turn").cast("string"), F.col("role")
    spelled = F.when(F.col("turn") % 2 == 0, cat('{"turn": ', turn, ', "b": ', part, ', "a": ', arr, ', "role": "', role, '"}')).otherwise(cat('{"role":"', role, '","a":', arr, ',"turn":', turn, '.0,"b":', part, '}'))
    seed = F.struct(F.col("text"), F.array(F.struct(F.length("text").alias("n"))).alias("at"))
    return t.select("conv_id", "turn", K.content_hash(spelled).alias("json_sha"), K.event_id(seed).alias("event_id"))


@query(r"""with x as (select o_orderkey, o_custkey, o_orderdate, '  Site  ' || (o_custkey % 50) || ' ÄB' as site, case when o_custkey % 9 = 0 then '' else 'N--' || (o_custkey % 7) || '..' end as network, sha256(o_orderkey::varchar) as h from orders),
y as (select *, regexp_replace(regexp_replace(regexp_replace(lower(case when network = '' then 'unknown' else network end), '[^a-z0-9]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as nw,
  regexp_replace(regexp_replace(regexp_replace(lower(case when o_custkey % 4 = 0 then network else site end), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as st from x)
select o_orderkey, 'dresp_' || substr(sha256('site ' || (o_custkey % 50) || ' äb|mac-address|' || h), 1, 32) as response_id,
  'obs_' || case when o_custkey % 6 = 0 then 'undated' else strftime(o_orderdate, '%Y%m%d') end || '_' || case when st = '' then 'site' else st end || '_' || h as registry_id,
  substr(nw, 1, 32) || '_' || case when o_custkey % 6 = 0 then 'notime' else strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') end || '_rawscan_' || substr(sha256(h || ':' || h), 1, 12) as run_uid from y""")
def stable_ids(spark, d):
    k = F.col("o_custkey")
    at = F.when(k % 6 != 0, F.col("o_orderdate"))
    x = B.read(spark, d, "orders").select(
        "o_orderkey", at.alias("at"), F.concat(F.lit("  Site  "), (k % 50).cast("string"), F.lit(" ÄB")).alias("site"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("N--"), (k % 7).cast("string"), F.lit(".."))).alias("network"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"), (k % 4 == 0).alias("unnamed"))
    return x.select(
        "o_orderkey", K.response_id("site", F.lit("mac-address"), "h").alias("response_id"),
        K.registry_id(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(F.col("unnamed"), "").otherwise(F.col("site")), "network", "h").alias("registry_id"),
        K.run_uid("network", "at", F.lit("RawScan"), K.combined_hash(F.array("h", "h"))).alias("run_uid"))


# keys of devices


_IDS = ("NAS {k}", "dev-{h}", "printer-10.0.{m}.7", "cam_192-168-1-{m}", "v1.2.300.{m}", "fe80::{m} lab", "a:b:{m}", "abcde:f:{m}", "unit ab:cd", "dev-unknown", " Tv   {k} ", "")


def _keyed_devices(spark, d, side: int):
    """customers as devices of one of two observations, with ids of many kinds and evidence."""
    c, k = B.read(spark, d, "customer"), F.col("c_custkey")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    m, h = k % 250, F.substring(F.sha2(k.cast("string"), 256), 1, 12)
    ids = [cat("NAS ", k), cat("dev-", h), cat("printer-10.0.", m, ".7"), cat("cam_192-168-1-", m), cat("v1.2.300.", m), cat("fe80::", m, " lab"), cat("a:b:", m), cat("abcde:f:", m), F.lit("unit ab:cd"), F.lit("dev-unknown"), cat(" Tv   ", k), F.lit("")]
    own = F.get(F.array(*ids), ((k + F.lit(side) * (k % 3)) % 12).cast("int"))
    digits = F.upper(F.lpad(F.hex(k), 12, "0"))
    e = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    told = F.filter(F.array(F.when(k % 4 == side, e("mac-address", digits)), F.when(k % 5 == 0, e("mac-address", cat("sha256:", F.sha2(k.cast("string"), 256)))), e("hostname", digits)), lambda x: x.isNotNull())
    array = lambda *p: F.filter(F.array(*p), lambda x: x.isNotNull())
    return c.filter(k % (11 + 2 * side) != 0).select(
        cat("bc"[side], k).alias("row"), own.alias("device_id"), array(F.when(k % 4 == 1 - side, F.lower(F.regexp_replace(digits, "(..)(?=.)", "$1-"))), F.when(k % 50 == 0, "short")).alias("macs"),
        array(cat("Host ", m), F.when(k % 2 == 0, "alt")).alias("hostnames"), array(F.col("c_mktsegment"), F.when(k % 7 == 0, " ")).alias("vendors"), array(cat("10.0.0.", k % 400)).alias("ips"), told.alias("evidence"),
    )


def _keyed_sql(side: int) -> str:
    spelled = "([" + ", ".join("'" + x.replace("{k}", "' || c_custkey || '").replace("{m}", "' || (c_custkey % 250) || '").replace("{h}", "' || substr(sha256(c_custkey::varchar), 1, 12) || '") + "'" for x in _IDS) + "])"
    pairs = "regexp_replace(lower(lpad(printf('%x', c_custkey), 12, '0')), '(..)', '\\1:', 'g')[1:17]"
    t = "bc"[side]
    return f"""{t}0 as (select c_custkey as n, '{t}' || c_custkey as row, trim(regexp_replace(lower({spelled}[((c_custkey + {side} * (c_custkey % 3)) % 12 + 1)::int]), '\\s+', ' ', 'g')) as t, {pairs} as m, c_mktsegment as v from customer where c_custkey % {11 + 2 * side} <> 0),
{t} as (select row as device_id, case when t = '' or t like 'dev-%' or regexp_matches(t, '^(printer|cam)') or regexp_matches(t, '^(fe80|a:b)') then []::varchar[] else [t] end as ids,
  case when n % 4 in (0, 1) then [m] else []::varchar[] end as macs, case when n % 5 = 0 then ['hash:' || sha256(n::varchar)] else []::varchar[] end as hashed,
  list_sort(case when n % 2 = 0 then ['alt|' || lower(v), 'host ' || (n % 250) || '|' || lower(v)] else ['host ' || (n % 250) || '|' || lower(v)] end) as names, ['10.0.0.' || (n % 400)] as ips from {t}0)"""


@query(f"with {_keyed_sql(0)} select device_id as row, array_to_string(ids, ',') as ids, array_to_string(macs, ',') as macs, array_to_string(hashed, ',') as hashed, array_to_string(names, ',') as names, array_to_string(ips, ',') as ips from b")
def device_keys(spark, d):
    rows = D.with_keys(_keyed_devices(spark, d, 0))
    return rows.select("row", *[F.array_join(c, ",").alias(c) for c in ("ids", "macs", "hashed", "names", "ips")])


_TIER_KEYS = {"persisted-device-id": "ids", "mac": "macs", "hashed-mac": "hashed", "hostname-vendor": "names", "ip-continuity": "ips"}


def _outcome_sql() -> str:
    """Each tier by its pairs, told by device; stronger tiers take devices away."""
    parts = []
    for n, (rule, confidence, confirms) in enumerate(TIERS):
        gone = lambda side: " and ".join(f"{side}.device_id not in (select {'base' if side == 'b' else 'current'}_id from t{i})" for i in range(n)) or "true"
        k = _TIER_KEYS[rule]
        parts.append(f"""t{n} as (select b.device_id as base_id, c.device_id as current_id, count(*) as n, '{rule}' as rule, '{confidence}' as confidence, {str(confirms).lower()} as ok
  from (select device_id, unnest({k}) as k from b where {gone('b')}) b join (select device_id, unnest({k}) as k from c where {gone('c')}) c using (k) group by 1, 2)""")
    return ", ".join(parts)


@query(f"""with {_keyed_sql(0)}, {_keyed_sql(1)}, {_outcome_sql()}, m as ({" union all ".join(f"select * from t{i}" for i in range(5))}),
w as (select *, count(*) over (partition by base_id) as nb, count(*) over (partition by current_id) as nc from m)
select 'base' as side, base_id as device_id, rule, confidence, case when bool_and(ok and nb = 1 and nc = 1) then 'confirmed' else 'uncertain' end as outcome, max(case when nb = 1 and nc = 1 then current_id end) as partner_id, sum(n)::bigint as n_links from w group by base_id, rule, confidence
union all select 'current', current_id, rule, confidence, case when bool_and(ok and nb = 1 and nc = 1) then 'confirmed' else 'uncertain' end, max(case when nb = 1 and nc = 1 then base_id end), sum(n)::bigint from w group by current_id, rule, confidence""")
def device_key_outcomes(spark, d):
    keyed = [D.with_keys(_keyed_devices(spark, d, side)).drop("device_id").withColumnRenamed("row", "device_id") for side in (0, 1)]
    return I.outcomes(*keyed, _TIER_KEYS)


# statements of sites


_FROM, _TO, _AT = "1995-03-01 00:00:00", "1995-03-08 00:00:00", "1995-03-09 12:30:00"


def _statement_parts(spark, d):
    """orders of a week as observations of sites, their comparisons, events and what supplements them."""
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    at = F.col("o_orderdate").cast("timestamp")
    o = B.read(spark, d, "orders").withColumn("site_id", F.when(ck % 10 == 0, cat("site-10.0.0.", ck % 3)).otherwise(cat("site-", ck % 10)))
    o = o.filter((at >= F.lit(_FROM).cast("timestamp")) & (at <= F.lit(_TO).cast("timestamp")))
    entries = o.select(
        "site_id", F.concat(F.lit("net "), "site_id").alias("network"), (ck % 10 < 5).alias("scoped"), cat("obs-", k).alias("observation_id"), at.alias("observed_at"), (F.col("o_orderstatus") == "P").alias("partial"), F.when(k % 6 == 0, "partial").otherwise("complete").alias("status"),
        F.filter(F.array(F.when(k % 8 == 1, "port scan"), F.when(k % 8 == 2, "discovery scan")), lambda x: x.isNotNull()).alias("missing"), F.when(k % 9 == 0, "stale").otherwise("fresh").alias("freshness"), F.when(k % 9 == 0, cat("old by ", k % 4)).alias("reason"),
        cat("vantage ", k % 2).alias("vantage"), F.array(cat("note ", k % 6)).alias("notes"), (k % 7 == 0).alias("supplemental"))
    pairs = ST.consecutive(entries)
    number = F.col("number")
    comparisons = pairs.select("site_id", "number", "baseline_id", "current_id", F.lit("rules-1").alias("rule_version"), F.when(number % 2 == 0, F.array(F.lit("stale-data"), F.lit("partial-coverage"))).otherwise(F.array().cast("array<string>")).alias("guardrails"), F.when(number % 5 == 0, "no common time").alias("skipped"))
    seq = F.explode(F.when(number % 3 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (number % 4 + 1).cast("int")))).alias("seq")
    events = comparisons.filter("skipped is null").select("site_id", "number", "baseline_id", seq)
    s = F.col("seq")
    events = events.select("site_id", "number", "seq", cat("ev ", F.col("baseline_id"), "/", s).alias("evidence_id"), cat("Title ", s).alias("title"), cat("Summary ", number, ".").alias("summary"), cat("Look at ", s, ".").alias("review"),
                           F.when((number + s) % 3 == 0, "not_sure").when((number + s) % 3 == 1, "mine").alias("state"), F.when(number % 2 == 0, cat("pet ", s)).alias("friendly_name"), ((number + s) % 2 == 0).alias("investigate"))
    extra = entries.filter("supplemental").select("site_id", F.lit(0).alias("seq"), F.lit("Capture").alias("label"), F.col("observation_id").alias("summary"), "vantage", "observed_at", F.col("observation_id").alias("registry_id"))
    return entries, comparisons, events, extra


def _statement(spark, d):
    lit = lambda x: F.lit(x).cast("timestamp")
    return ST.statement_rows(*_statement_parts(spark, d), lit(_FROM), lit(_TO), lit(_AT))


_DT = "case when {x} is null then 'not available' else strftime({x}, '%b ') || day({x}) || strftime({x}, ', %Y, ') || ((hour({x}) + 11) % 12 + 1) || strftime({x}, ':%M %p UTC') end"
_HIDE = "site_id like '%10.0.0.%'"
_SITE = "replace(replace(replace(site_id, '10.0.0.0', '[redacted ip]'), '10.0.0.1', '[redacted ip]'), '10.0.0.2', '[redacted ip]')"
_SHORT = "asked and not week"


def _fixed_sql() -> str:
    """The items a site has at most once, as (section, place, item, severity, text, condition)."""
    reason = f"case when n_pairs = 0 then 'The week has no two comparable observations.' when not week then 'Observations span too little of the week: ' || {_DT.format(x='first')} || ' to ' || {_DT.format(x='last')} || '.' else 'Observations span the week.' end"
    w = lambda bad: f"case when {bad} then 'warning' else 'info' end"
    no = "n_primary = 0"
    quiet = "n_pairs > 0 and n_events = 0"
    lim = "coalesce(partial, false) or coalesce(stale, false)"
    rows = [
        (1, 1, "period-title", "'info'", "case when week then 'Weekly Network Statement' else 'Network Statement' end", ""), (1, 2, "period-range", "'info'", "'Period: Mar 1, 1995 to Mar 8, 1995.'", ""), (1, 3, "period-generated", "'info'", "'Generated: Mar 9, 1995, 12:30 PM UTC.'", ""),
        (1, 4, "period-title-reason", w(_SHORT), reason, ""), (2, 1, "site-name", "'info'", f"'Network: net ' || {_SITE} || '.'", ""), (2, 2, "site-id", "'info'", f"'Site: ' || {_SITE} || '.'", ""),
        (2, 3, "site-scope", "'info'", "case when scoped then 'A scope is recorded; its targets are not repeated here.' else 'No scope is recorded.' end", ""),
        (3, 1, "coverage-counts", w("n_pairs = 0"), "'Primary observations: ' || n_primary || '; comparable pairs: ' || n_pairs || '; supplemental records: ' || n_extra || '.'", ""), (3, 2, "coverage-vantage", w("vantages is null"), "coalesce('Vantage: ' || vantages || '.', 'No primary vantage.')", ""),
        (3, 3, "coverage-title-gap", "'warning'", reason, _SHORT), (3, 4, "coverage-statuses", w(no), "coalesce('Coverage: ' || statuses || '.', 'No coverage statuses.')", ""), (3, 5, "coverage-missing-sources", w("missing is not null"), "coalesce('Gaps: ' || missing || '.', 'No gaps reported.')", ""),
        (4, 1, "freshness-counts", w(no), "coalesce('Freshness: ' || freshnesses || '.', 'No freshness.')", ""), (4, 2, "freshness-latest", w(f"{no} or latest <> 'fresh'"), f"case when {no} then 'No latest observation.' else 'Latest: ' || {_DT.format(x='last')} || '; ' || latest || '.' end", ""),
        (4, 3, "freshness-fresh", "'info'", "'All within the cadence.'", "n_primary > 0 and not stale"), (5, 1, "stable-none", "'warning'", "'Fewer than two comparable observations: nothing can be called stable.'", "n_pairs = 0"),
        (5, 1, "stable-no-events", w(lim), "'No changes in ' || n_pairs || case when n_pairs = 1 then ' comparison.' else ' comparisons.' end", quiet), (5, 2, "stable-boundary", "'info'", f"case when {lim} then 'Bounded by coverage and freshness; no proof of safety.' else 'Stored observations only; no proof of safety.' end", quiet),
        (5, 1, "stable-bounded", "'info'", "n_pairs || case when n_pairs = 1 then ' pair' else ' pairs' end || ' compared; what did not change is not listed.'", "n_pairs > 0 and n_events > 0"), (6, 1, "changed-none", "'info'", "'No change events.'", "n_events = 0"), (7, 1, "review-none", "'info'", "'Nothing needs review.'", "n_events = 0"),
        (8, 1, "responses-none", "'info'", "'No open responses.'", "n_open = 0"), (9, 1, "supplement-none", "'info'", "'No supplemental evidence.'", "n_extra = 0"), (10, 1, "cannot-safety", "'info'", "'Neither safety nor compromise nor compliance can be proved.'", ""),
        (10, 2, "cannot-absence", "'info'", "'Absence outside these observations, sources and dates can''t be proved.'", ""), (10, 3, "cannot-responses", "'info'", "'Responses tell what users know, not what is secure.'", ""), (10, 4, "cannot-week", "'warning'", "'The evidence does not cover the week.'", _SHORT),
        (10, 5, "cannot-limited", "'warning'", "'Coverage, freshness or too few comparisons limit every conclusion.'", f"{lim} or n_pairs = 0"), (10, 6, "cannot-supplement", "'info'", "'Captures prove no full inventory, ownership, safety or cause.'", "n_extra > 0"),
        (11, 1, "action-observe", "'warning'", "'Collect two primary observations or more.'", "n_primary < 2 or n_pairs = 0"), (11, 2, "action-week", "'warning'", "'Observe near both ends of the week.'", _SHORT), (11, 3, "action-fresh", "'warning'", "'Observe again before calling this current.'", "coalesce(stale, false)"),
        (11, 4, "action-missing-sources", "'warning'", "'Collect what is missing: ' || missing || '.'", "missing is not null"), (11, 5, "action-responses", "'review'", "'Settle the open responses.'", "n_open > 0"), (11, 6, "action-events", "'review'", "'Check that each change is expected.'", "n_events > 0"),
        (11, 7, "action-supplement", "'info'", "'Take captures as context only.'", "n_extra > 0"), (11, 8, "action-cadence", "'info'", "'Keep observing at this cadence.'", f"n_primary >= 2 and n_pairs > 0 and not ({_SHORT}) and not coalesce(stale, false) and missing is null and n_open = 0 and n_events = 0 and n_extra = 0"),
        (12, 1, "provenance-source", "'info'", "'Made from registered observations, their comparisons, coverage, responses and capture metadata.'", ""), (12, 2, "provenance-counts", "'info'", "'Observations: ' || n_primary || '; comparisons: ' || n_pairs || '; responses: ' || n_responses || '; supplemental: ' || n_extra || '.'", ""),
    ]
    return " union all ".join(f"select site_id, {s} as section, {p}::bigint as place, '{i}' as item, {sev} as severity, {text} as text, null as reference from facts where {when or 'true'}" for s, p, i, sev, text, when in rows)


_COUNTED = "select site_id, string_agg({c} || ': ' || n, ', ' order by {c}) as {as_} from (select site_id, {c}, count(*) as n from pm group by all) group by 1"


@query(f"""with en as (select case when o_custkey % 10 = 0 then 'site-10.0.0.' || (o_custkey % 3) else 'site-' || (o_custkey % 10) end as site_id, o_custkey % 10 < 5 as scoped, 'obs-' || o_orderkey as obs, o_orderdate::timestamp as tm, o_orderstatus = 'P' as partial, case when o_orderkey % 6 = 0 then 'partial' else 'complete' end as status,
  case o_orderkey % 8 when 1 then 'port scan' when 2 then 'discovery scan' end as miss, case when o_orderkey % 9 = 0 then 'stale' else 'fresh' end as freshness, 'old by ' || (o_orderkey % 4) as reason, 'vantage ' || (o_orderkey % 2) as vantage, 'note ' || (o_orderkey % 6) as note, o_orderkey % 7 = 0 as extra
  from orders where o_orderdate::timestamp between timestamp '{_FROM}' and timestamp '{_TO}'),
pm as (select * from en where not extra), rk as (select *, row_number() over (partition by site_id order by tm, obs) as n from pm),
cm as (select c.site_id, b.n as number, b.obs as base, c.obs as cur, b.n % 5 = 0 as skipped from rk b join rk c on c.site_id = b.site_id and c.n = b.n + 1),
ev as (select site_id, number, base, unnest(range(1, number % 4 + 2)) as seq from cm where not skipped and number % 3 <> 0),
e2 as (select *, case (number + seq) % 3 when 0 then 'not_sure' when 1 then 'mine' end as state, row_number() over (partition by site_id order by number, seq) as i from ev),
a as (select site_id, count(*) filter (where extra) as n_extra, coalesce(arg_max(scoped, (tm, obs)) filter (where not extra), arg_max(scoped, (tm, obs))) as scoped from en group by 1),
f as (select site_id, count(*) as n_primary, bool_or(partial or status <> 'complete' or miss is not null) as partial, bool_or(freshness = 'stale') as stale, min(tm) as first, max(tm) as last, arg_max(freshness, (tm, obs)) as latest, string_agg(distinct vantage, '; ' order by vantage) as vantages, string_agg(distinct miss, ', ' order by miss) as missing from pm group by 1),
facts as (select a.*, f.* exclude (site_id, n_primary), coalesce(n_primary, 0) as n_primary, coalesce(n_pairs, 0) as n_pairs, coalesce(n_events, 0) as n_events, coalesce(n_responses, 0) as n_responses, coalesce(n_open, 0) as n_open, statuses, freshnesses, true as asked,
  coalesce(n_pairs > 0 and first <= timestamp '{_FROM}' + interval 1 day and last >= timestamp '{_TO}' - interval 1 day and last - first >= interval 5 day, false) as week
  from a left join f using (site_id) left join (select site_id, count(*) filter (where not skipped) as n_pairs from cm group by 1) using (site_id) left join (select site_id, count(*) as n_events, count(state) as n_responses, count(*) filter (where state = 'not_sure') as n_open from e2 group by 1) using (site_id)
  left join ({_COUNTED.format(c='status', as_='statuses')}) using (site_id) left join ({_COUNTED.format(c='freshness', as_='freshnesses')}) using (site_id)),
ln as ({_fixed_sql()}
  union all select site_id, 3, 5 + i, 'coverage-note-' || i, 'info', 'Note: ' || note || '.', null from (select site_id, note, row_number() over (partition by site_id order by note) as i from (select distinct site_id, note from pm)) where i <= 4
  union all select site_id, 4, 2 + i, 'freshness-limit-' || i, 'warning', reason, null from (select site_id, reason, row_number() over (partition by site_id order by reason) as i from (select distinct site_id, reason from pm where freshness <> 'fresh'))
  union all select site_id, 6, i, 'changed-' || i, 'review', 'Comparison ' || number || ': Title ' || seq || '. Summary ' || number || '.', '/activity#ev+' || base || '%2F' || seq from e2
  union all select site_id, 7, i, 'review-' || i, case when (number + seq) % 2 = 0 then 'review' else 'info' end, 'Comparison ' || number || ': Look at ' || seq || '.' || coalesce(' User says: ' || state || '.', ''), '/activity#ev+' || base || '%2F' || seq from e2
  union all select site_id, 8, j, 'response-' || j, 'review', 'Comparison ' || number || ': not_sure' || case when number % 2 = 0 then ' (pet ' || seq || ')' else '' end || ' stays open for Title ' || seq || '.', '/activity#ev+' || base || '%2F' || seq from (select *, row_number() over (partition by site_id order by number, seq) as j from e2 where state = 'not_sure')
  union all select site_id, 9, i, 'supplement-' || i, 'info', 'Capture: ' || obs || ' Vantage: ' || vantage || '; observed ' || {_DT.format(x='tm')} || '.', '/captures?observation=' || obs from (select *, row_number() over (partition by site_id order by tm desc, obs) as i from en where extra)
  union all select site_id, 12, 2 + i, 'provenance-comparison-' || i, 'info', 'Comparison ' || number || ': ' || case when {_HIDE} then 'baseline to current' else base || ' to ' || cur end || '; rule rules-1; ' || n || case when n = 1 then ' event' else ' events' end || '; guardrails ' || case when number % 2 = 0 then 'partial-coverage, stale-data' else 'none' end || '.', '/activity'
    from (select cm.*, row_number() over (partition by cm.site_id order by number) as i, (select count(*) from ev where ev.site_id = cm.site_id and ev.number = cm.number) as n from cm where not skipped)
  union all select site_id, 12, 2 + n_pairs + i, 'provenance-skipped-' || i, 'warning', 'Skipped ' || case when {_HIDE} then 'baseline to current' else base || ' to ' || cur end || ': no common time.', null from (select cm.*, row_number() over (partition by cm.site_id order by number) as i from cm where skipped) join (select site_id, n_pairs from facts) using (site_id))
select site_id, section, ({[name for name, _ in ST.SECTIONS]})[section] as section_id, place, item, severity, text, case when not {_HIDE} then reference end as reference from ln""")
def statement_rows(spark, d):
    return _statement(spark, d)


# runs of archives


def _members(spark, d):
    """events as the members of archives: reports of runs, in rawscans folders or not, each with several files."""
    u = F.col("user_id")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    port = F.get_json_object("props", "$.k").cast("long") + 1
    host = cat('<host><status state="up"/><address addr="10.', u % 200, '.', F.col("event_id") % 200, '.1" addrtype="ipv4"/><ports><port protocol="tcp" portid="', port, '"><state state="', F.when(F.col("event_type") == "error", "closed").otherwise("open"), '"/><service name="', F.col("event_type"), '"/></port></ports></host>')
    kind = F.col("event_id") % 3
    file = F.when(kind == 1, "other.xml").when(kind == 2, "zz.XML").when(u % 4 == 0, "scan0.xml").otherwise("ports_a.xml")
    run = cat("2024-01-", F.lpad((u % 28 + 1).cast("string"), 2, "0"), "_1200_u", u)
    base = F.when(u % 2 == 1, "stuff/").when(u % 7 == 0, "home/other/").otherwise("home/rawscans/")
    rows = B.read(spark, d, "events").select(cat("a", u % 50).alias("archive"), F.concat(base, run, F.lit("/"), file).alias("name"), F.struct("event_id", host.alias("x")).alias("h"))
    xml = F.concat(F.lit("<nmaprun>"), F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["x"]), ""), F.lit("</nmaprun>"))
    return rows.groupBy("archive", "name").agg(xml.cast("binary").alias("content")).withColumn("error", F.lit(None).cast("string"))


_RUNS = """e as (select *, 'a' || (user_id % 50) as archive, '2024-01-' || lpad((user_id % 28 + 1)::varchar, 2, '0') || '_1200_u' || user_id as folder, event_id % 3 as kind,
  case when user_id % 2 = 1 then 'stuff/' when user_id % 7 = 0 then 'home/other/' else 'home/rawscans/' end as base from events),
ar as (select archive, bool_or(base = 'home/rawscans/') as raw from e group by 1),
rn as (select archive, base || folder as run_path, folder, any_value(user_id) as user_id, bool_or(kind = 0) as k0, bool_or(kind = 1) as k1 from e join ar using (archive) where case when raw then base = 'home/rawscans/' else true end group by all having bool_or(base = 'home/rawscans/') or bool_or(kind < 2))"""


@query(f"with {_RUNS} select archive, run_path, folder, strptime(substr(folder, 1, 10) || ' 12:00', '%Y-%m-%d %H:%M') as timestamp, substr(folder, 17) as run_type, case when run_path like 'home/rawscans/%' then 'home' end as network from rn")
def archive_runs(spark, d):
    return G.runs(_members(spark, d)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(f"""with {_RUNS}, pk as (select *, case when user_id % 4 <> 0 and k0 then 0 when k1 then 1 when k0 then 0 end as pick from rn)
select pk.archive, pk.run_path, case when pick = 1 then 'other.xml' when pk.user_id % 4 = 0 then 'scan0.xml' else 'ports_a.xml' end as report, '10.' || (e.user_id % 200) || '.' || (event_id % 200) || '.1' as ip, 'tcp' as protocol,
  (json_extract_string(props, '$.k')::bigint + 1)::int as port, event_type as service from pk join e on e.archive = pk.archive and e.base || e.folder = pk.run_path and e.kind = pk.pick where event_type <> 'error'""")
def archive_findings(spark, d):
    members = _members(spark, d)
    return G.run_findings(members, G.runs(members)).select("archive", "run_path", "report", "ip", "protocol", "port", "service")


# orders by the rules of language


_KINDS_OF_EVENT = ("identity-uncertain-possibly-same-device", "new-device-observed", "previously-observed-device-not-observed", "service-or-port-opened", "service-or-port-closed", "important-device-metadata-changed")
_WORD = "(['é', 'E', 'e', 'Ä', 'a', 'Z', '_', 'b-'])"


@query(f"""with x as (select conv_id, turn, conv_id % 7 as pair, ({list(_KINDS_OF_EVENT)})[(turn % 6 + 1)::int] as event_type, substr(text, 1, 9) as base_id, case when turn % 3 <> 0 then {_WORD}[(conv_id % 8 + 1)::int] || substr(text, 2, 4) end as current_id, conv_id || '-' || turn as event_id,
  case when turn % 4 = 1 then 'user-investigate' else 'normal' end as priority from conversations),
k as (select *, (turn % 6 * 10 + 10) || '|' || base_id || '|' || coalesce(current_id, '') || '|' || case when turn % 2 = 0 then 'tcp:' || turn else '' end || '||' || event_id as key from x),
p as (select *, row_number() over (partition by pair order by key collate en, key) as place from k)
select pair, event_id, place, row_number() over (partition by pair order by priority <> 'user-investigate', place) as activity_place from p""")
def event_places(spark, d):
    t, n = B.read(spark, d, "conversations"), F.col("turn")
    words = F.array(*[F.lit(x) for x in ("é", "E", "e", "Ä", "a", "Z", "_", "b-")])
    rows = t.select(
        (F.col("conv_id") % 7).alias("pair"), F.get(F.array(*[F.lit(x) for x in _KINDS_OF_EVENT]), (n % 6).cast("int")).alias("event_type"), F.substring("text", 1, 9).alias("base_id"),
        F.when(n % 3 != 0, F.concat(F.get(words, (F.col("conv_id") % 8).cast("int")), F.substring("text", 2, 4))).alias("current_id"), F.when(n % 2 == 0, F.concat(F.lit("tcp:"), n.cast("string"))).alias("base_port"), F.lit(None).cast("string").alias("current_port"),
        F.concat_ws("-", F.col("conv_id").cast("string"), n.cast("string")).alias("event_id"), F.when(n % 4 == 1, "user-investigate").otherwise("normal").alias("priority"))
    return O.activity_order(O.in_order(rows, "pair", O.event_key()), "pair").select("pair", "event_id", "place", "activity_place")


@query(f"""with x as (select p_partkey, p_partkey % 5 as pair, ({_WORD})[(p_partkey % 8 + 1)::int] || (p_partkey % 3) as rule, p_name as base_id, {_WORD}[(p_partkey // 8 % 8 + 1)::int] || p_partkey as current_id from part)
select pair, p_partkey, row_number() over (partition by pair order by key collate en, key) as place from (select *, rule || '|' || base_id || '|' || current_id || '|A,b' as key from x)""")
def candidate_places(spark, d):
    words = F.array(*[F.lit(x) for x in ("é", "E", "e", "Ä", "a", "Z", "_", "b-")])
    k = F.col("p_partkey")
    word = lambda n: F.get(words, n.cast("int"))
    rows = B.read(spark, d, "part").select((k % 5).alias("pair"), "p_partkey", F.concat(word(k % 8), (k % 3).cast("string")).alias("rule"), F.col("p_name").alias("base_id"), F.concat(word(F.floor(k / 8) % 8), k.cast("string")).alias("current_id"), F.array(F.lit("b"), F.lit("A")).alias("shared"))
    return O.in_order(rows, "pair", O.candidate_key()).select("pair", "p_partkey", "place")


# reasons and actions


_PRODUCT = "case when ord % 3 = 0 then '' when ord % 3 = 1 then ' prod ' || ord end"


@query(f"""with {_RISKY}, nt(port, note) as (values {", ".join(f"({p}, '{n}')" for p, n in sorted(dims.FLAG_NOTES.items()))})
select risk as priority, coalesce(note, 'Flagged port') || ' | service=' || service || coalesce(' | product=' || nullif(trim({_PRODUCT}), ''), '') as reason, ip, protocol, port::int as port, service, {_PRODUCT} as product, null::varchar as version, ord,
  row_number() over (order by risk, ip, port, ord) as place from rk left join nt using (port) where risk is not null""")
def flagged_changes(spark, d):
    n = F.col("ord") % 3
    rows = _risky(spark, d).withColumn("product", F.when(n == 0, "").when(n == 1, F.concat(F.lit(" prod "), F.col("ord").cast("string")))).withColumn("version", F.lit(None).cast("string"))
    return P.risk_flags(rows, dims.flag_notes(spark))


@query(f"""with {_RISKY}, g as (select protocol, port, risk, count(distinct ip) as n, arg_min(ip, ord) as h, arg_min(service, ord) as service from rk where risk in ('P0', 'P1') group by all order by risk, n desc, port, protocol limit 3),
nt(port, action) as (values {", ".join(f"({p}, '{a}')" for p, a in sorted(dims.P0_ACTIONS.items()))})
select row_number() over (order by risk, n desc, port, protocol)::int as place, case when risk = 'P1' then 'Review and restrict ' || service || ' access (' || n || ' hosts)'
  else coalesce(action || ' (' || port || '/' || protocol || ' on ' || case when n = 1 then h else n || ' hosts' end || ')', 'Block port ' || port || '/' || protocol || ' at perimeter (' || n || ' hosts)') end as action from g left join nt using (port)""")
def recommended_actions(spark, d):
    return P.recommended(P.risk_group_counts(_risky(spark, d)), dims.port_notes(spark))


# reports of a difference


def _difference(spark, d):
    """The runs of the events as parts of a report."""
    base, current = _open(spark, d, "base"), _risky(spark, d)
    opened = P.ports_opened(base, current)
    columns = ("ord", "ip", "port", "protocol", "service", "risk")
    shaped = lambda rows: rows.select(*[c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    hosts = lambda a, b: b.join(a.select("ip").distinct(), "ip", "left_anti").groupBy("ip").agg(F.min("ord").alias("ord"), F.min_by("hostname", "ord").alias("hostname"))
    return {
        "new_hosts": hosts(base, current), "removed_hosts": hosts(current, base), "opened": shaped(opened), "closed": shaped(P.ports_closed(base, current)),
        "risky": shaped(opened.filter(F.col("risk").isin("P0", "P1"))),
    }


_PARTS = f"""with {_RISKY}, od as (select rk.* from rk where not exists (select 1 from ba y where y.ip = rk.ip and y.protocol = rk.protocol and y.port = rk.port)),
cd as (select ba.* from ba where not exists (select 1 from op y where y.ip = ba.ip and y.protocol = ba.protocol and y.port = ba.port)),
nh as (select ip, min(ord) as ord, arg_min(hostname, ord) as hostname from op where ip not in (select ip from ba) group by ip), rh as (select ip, min(ord) as ord, arg_min(hostname, ord) as hostname from ba where ip not in (select ip from op) group by ip),
ri as (select * from od where risk in ('P0', 'P1')),
ct as (select (select count(*) from nh) as nh, (select count(*) from rh) as rh, (select count(*) from od) as od, (select count(*) from cd) as cd, (select count(*) from ri) as ri)"""
_HOST_LINE, _PORT_LINE = "ip || ',' || coalesce(nullif(hostname, ''), 'N/A')", "ip || ',' || port || ',' || protocol || ',' || coalesce(nullif(service, ''), 'unknown')"


def _csv_sql() -> str:
    out = []
    for k, (title, name, fields, nothing) in enumerate(RP.CSV_SECTIONS, 1):
        t = {"new_hosts": "nh", "removed_hosts": "rh", "opened": "od", "closed": "cd", "risky": "ri"}[name]
        line = _HOST_LINE if t in ("nh", "rh") else _PORT_LINE + (" || ',' || coalesce(risk, 'N/A')" if t != "cd" else "")
        head = ",".join(h for h, _ in fields)
        some = f"case when {t} > 0 then '{head}' else '{nothing}' end"
        out.append(f"select {k} as section, unnest([-1, 0, 1])::bigint as place, unnest(['', '{title}', {some}]) as line from ct" + ("" if nothing else f" where {t} > 0"))
        out.append(f"select {k}, 1 + row_number() over (order by ord, {line}), {line} from {t}")
    return " union all ".join(out)


@query(f"""{_PARTS} select 0 as section, unnest(range(10)) as place, unnest(['# SUMMARY', 'Metric,Value', 'Network,"home, lab"', 'Baseline Scan,a', 'Current Scan,b', 'New Hosts,' || nh, 'Removed Hosts,' || rh, 'Ports Opened,' || od, 'Ports Closed,' || cd, 'Risky Exposures,' || ri]) as line from ct
union all {_csv_sql()}""")
def diff_csv(spark, d):
    return RP.diff_csv(_difference(spark, d), 'home, lab', "a", "b")


def _table_sql(section: int, title: str, t: str, columns: str, cells: str) -> str:
    n = columns.count(",") + 1
    head = "| " + " | ".join(columns.split(",")) + " |"
    return f"""select {section}, unnest(case when {t} > 0 then [0, 1, 2, 1152921504606846976] else [0, 1, 1152921504606846976] end)::bigint, unnest(case when {t} > 0 then ['## {title}', '{head}', '|' || repeat('---|', {n}), ''] else ['## {title}', '_(none)_', ''] end) from ct
union all select {section}, 2 + i, line from (select row_number() over (order by ord, line) as i, line from (select ord, '| ' || {cells} || ' |' as line from {t})) where i <= {RP.TABLE_ROWS}"""


_CELLS = "ip || ' | ' || port || ' | ' || protocol || ' | ' || service"


@query(f"""{_PARTS} select 0 as section, unnest(range(5)) as place, unnest(['# CHANGES — home', '', '**Run A (baseline):** `a`', '**Run B (new):** `b`', '']) as line
union all select 1, unnest(range(7)), unnest(['## Summary', '- New hosts: **' || nh || '**', '- Removed hosts: **' || rh || '**', '- Ports opened (new exposures): **' || od || '**', '- Ports closed: **' || cd || '**', '- New risky exposures flagged: **' || ri || '**', '']) from ct
union all select 2, unnest([0, 1152921504606846976]), unnest(['## New hosts', '']) union all select 2, row_number() over (order by ord, ip), '- ' || ip from nh union all select 2, 1, '- (none)' from ct where nh = 0
union all select 3, unnest([0, 1152921504606846976]), unnest(['## Removed hosts', '']) union all select 3, row_number() over (order by ord, ip), '- ' || ip from rh union all select 3, 1, '- (none)' from ct where rh = 0
union all {_table_sql(4, 'Ports opened', 'od', 'ip,port,protocol,service', _CELLS)} union all {_table_sql(5, 'Ports closed', 'cd', 'ip,port,protocol,service', _CELLS)}
union all {_table_sql(6, 'New risky exposures (P0/P1/P2)', 'ri', 'risk,ip,port,protocol,service', "risk || ' | ' || " + _CELLS)}""")
def change_report(spark, d):
    return RP.change_report(_difference(spark, d), "home", "a", "b")


# devices of a capture


@query(r"""with x as (select c_custkey as k, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then '' else 'AA:' || c_custkey end as mac, case when c_custkey % 3 = 0 then c_mktsegment end as vendor, case when c_custkey % 5 = 0 then []::varchar[] else ['10.0.0.' || (c_custkey % 250), 'fe80::' || c_custkey] end as ips from customer),
y as (select *, nullif(mac, '') as m, '{"id":' || to_json(k || '/' || coalesce(vendor, '')) || ',"ips":' || to_json(ips) || ',"mac":' || coalesce('"' || nullif(mac, '') || '"', 'null') || '}' as seed from x),
e as (select k, i, unnest(list_concat(list_transform(ips, lambda v: 'ip-address|' || v), case when m is null then [] else ['mac-address|' || m] end, case when vendor is null then [] else ['vendor|' || vendor] end)) as v from y, (select 1 as i))
select k, 'dev-ph-' || substr(sha256(seed), 1, 12) as device_id, coalesce((select string_agg('ev-ph-' || substr(sha256(v), 1, 12), ',' order by v) from e where e.k = y.k), '') as evidence, 0::bigint as n_ports, 'guest seen in traffic only, ' || (k % 100 + 7) || ' packets' as note,
  case k % 3 when 0 then true when 1 then k % 2 = 0 else false end as supplement from y""")
def capture_devices(spark, d):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    vendor = F.when(k % 3 == 0, F.col("c_mktsegment"))
    devices = B.read(spark, d, "customer").select(
        "c_custkey", cat(k, "/", F.coalesce(vendor, F.lit(""))).alias("id"), F.when(k % 4 == 0, none).when(k % 4 == 1, "").otherwise(cat("AA:", k)).alias("mac"), vendor.alias("vendor"), F.lit("guest").alias("role"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(cat("10.0.0.", k % 250), cat("fe80::", k), none)).alias("ips"), (k % 100).alias("packets_sent"), F.lit(7).alias("packets_received"), none.alias("first_seen"), none.alias("last_seen"), none.alias("observed_start"), none.alias("observed_end"))
    kinds, vantage = F.when(k % 3 == 0, F.array(F.lit("scan"), F.lit("capture"))), F.when((k % 3 == 1) & (k % 2 == 0), "capture-tap").when(k % 3 == 1, "scan")
    extra = B.read(spark, d, "customer").select("c_custkey", CD.is_supplement(kinds, vantage, "capture", "capture-").alias("supplement"))
    ids = F.transform(F.array_sort(F.transform("evidence", lambda e: F.struct(F.concat_ws("|", e["kind"], e["value"]).alias("v"), e["evidence_id"].alias("i")))), lambda x: x["i"])
    rows = CD.observed_devices(devices, keep=("c_custkey",)).join(extra, "c_custkey")
    return rows.select(F.col("c_custkey").alias("k"), "device_id", F.array_join(ids, ",").alias("evidence"), F.size("open_ports").cast("long").alias("n_ports"), "note", "supplement")


# what readers see


@query("""with p as (select page_id, url, '/' || array_to_string(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), '/') as path from pages)
select page_id, case when page_id % 3 = 0 then '/observations?' || page_id when page_id % 3 = 1 and not regexp_matches(url, '[^A-Za-z0-9._~:/?#@!$&()*+,;=%-]') then '/captures/' || url else '#' end as link,
  case when page_id % 2 = 0 then 'a/' || page_id || '.xml' else page_id || '.xml' end as path, page_id || case when page_id = 1 then ' page' else ' pages' end as n, case when page_id = 1 then 'was' else 'were' end as verb,
  case when page_id % 4 = 0 then 'Printer ' || page_id when page_id % 4 = 1 then 'h' || page_id end as name from p where page_id < 1000
union all select page_id, case when page_id % 3 = 0 then '/observations?' || page_id when page_id % 3 = 1 and not regexp_matches(url, '[^A-Za-z0-9._~:/?#@!$&()*+,;=%-]') then '/captures/' || url else '#' end,
  case when page_id % 2 = 0 then 'a/' || page_id || '.xml' else page_id || '.xml' end, format('{:,}', page_id) || ' pages', 'were', case when page_id % 4 = 0 then 'Printer ' || page_id when page_id % 4 = 1 then 'h' || page_id end from p where page_id >= 1000""")
def page_labels(spark, d):
    k, t = F.col("page_id"), F.col("page_id").cast("string")
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    link = F.when(k % 3 == 0, cat("/observations?", t)).when(k % 3 == 1, cat("/captures/", F.col("url"))).otherwise(F.col("url"))
    path = F.when(k % 2 == 0, cat("/srv//data/a/", t, ".xml")).otherwise(cat("/srv/data/../x/", t, ".xml"))
    device, hosts = F.when(k % 4 == 0, cat("  Printer ", t)), F.when(k % 4 == 1, cat("h", t, "; other")).when(k % 4 == 2, "")
    return B.read(spark, d, "pages").select("page_id", LB.safe_link(link).alias("link"), LB.client_path(path, "/srv/data").alias("path"), LB.count_noun("page_id", "page").alias("n"), LB.was_were("page_id").alias("verb"), LB.inventory_name(device, hosts).alias("name"))


@query(f"""with {B.PACKETS}, n as (select distinct src_ip as node from p union select 'broadcast' union select 'gone'),
dv as (select 's' || s_suppkey as id, case when s_suppkey % 3 = 0 then s_name else '' end as name, case when s_suppkey % 7 = 0 then 'gateway' else 'device' end as role, case when s_suppkey % 2 = 0 then 'aa:bb:cc:00:' || s_suppkey end as mac from supplier),
ep as (select 'p' || p_partkey as id, case when p_partkey % 4 = 0 then 'fe80::' || p_partkey else '198.51.' || p_partkey || '.9' end as ip, p_partkey % 97 = 0 as agg from part)
select node, case when node = 'broadcast' then 'Everyone (broadcast)' when dv.id is not null then coalesce(nullif(name, ''), case when role = 'gateway' then 'Router / Gateway' end, 'Device …' || mac[-5:], 'Unidentified device')
  when ep.id is not null then case when agg then 'Other internet endpoints ' || ip when ip like 'fe80%' then 'fe80:…' else '198.51.•.•' end else 'Unknown' end as label from n left join dv on dv.id = node left join ep on ep.id = node""")
def node_labels(spark, d):
    nodes = B.packets(spark, d).select(F.col("src_ip").alias("node")).unionByName(spark.createDataFrame([("broadcast",), ("gone",)], "node string")).distinct()
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    devices = B.read(spark, d, "supplier").select(cat("s", s).alias("id"), F.when(s % 3 == 0, F.col("s_name")).otherwise("").alias("name"), F.when(s % 7 == 0, "gateway").otherwise("device").alias("role"), F.when(s % 2 == 0, cat("aa:bb:cc:00:", s)).alias("mac"))
    ends = B.read(spark, d, "part").select(cat("p", p).alias("id"), F.when(p % 4 == 0, cat("fe80::", p)).otherwise(cat("198.51.", p, ".9")).alias("ip"), (p % 97 == 0).alias("is_aggregate"))
    return LB.node_labels(nodes, devices, ends)
