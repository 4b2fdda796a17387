"""Traffic analytics over packets.

packets: (ord, ts, orig_len, src_mac, dst_mac, protocol, src_ip, dst_ip,
src_port, dst_port, src_local, dst_local, dst_broadcast, dst_mac_broadcast,
dns_name, dns_kind); ord is the packet's place in its capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.scalar import domain_summary, size_class

# Keys that are tracked of each kind, addresses that a gateway's votes count, and rows that are shown.
MAX_VOTES = 10_000
MAX_FLOWS, MAX_HOSTS, MAX_ENDPOINTS, MAX_NAMES = 5000, 512, 2000, 500
TOP_FLOWS, TOP_ENDPOINTS, TOP_NAMES = 500, 200, 200


def totals(packets: DataFrame) -> DataFrame:
    """One row: packets, bytes, time range, counters by protocol."""
    p = F.col("protocol")
    return packets.agg(
        F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count_if(p == "arp").alias("arp_packets"), F.count_if(p.startswith("icmp")).alias("icmp_packets"),
        F.count_if(F.col("src_ip").contains(":") | F.col("dst_ip").contains(":")).alias("ipv6_packets"),
    )


def host_traffic(packets: DataFrame) -> DataFrame:
    """Per MAC: sent and received packets and bytes, times, local addresses, outside peers.

    A packet counts for its source, and for its destination unless that is a
    group address; both roles come from one pass over the packets.
    """
    outside = lambda ip, local: F.when(~local, ip)
    sent = F.struct(
        F.col("src_mac").alias("mac"), F.lit(1).alias("sent"), F.when(F.col("src_local"), F.col("src_ip")).alias("ip"),
        F.when(~F.col("dst_broadcast"), outside(F.col("dst_ip"), F.col("dst_local"))).alias("peer"), (F.col("ord") * 2).alias("seq"),
    )
    received = F.struct(
        F.col("dst_mac").alias("mac"), F.lit(0).alias("sent"), F.when(F.col("dst_local") & ~F.col("dst_broadcast"), F.col("dst_ip")).alias("ip"),
        F.when(~F.col("dst_broadcast"), outside(F.col("src_ip"), F.col("src_local"))).alias("peer"), (F.col("ord") * 2 + 1).alias("seq"),
    )
    both = F.when(F.col("dst_mac_broadcast"), F.array(sent)).otherwise(F.array(sent, received))
    roles = packets.select("ts", "orig_len", "protocol", "dns_name", F.explode(both).alias("r")).select("ts", "orig_len", "protocol", "dns_name", "r.*")
    s = F.col("sent") == 1
    return roles.groupBy("mac").agg(
        F.count_if(s).alias("packets_sent"), F.count_if(~s).alias("packets_received"),
        F.sum(F.when(s, F.col("orig_len")).otherwise(0)).alias("bytes_sent"), F.sum(F.when(~s, F.col("orig_len")).otherwise(0)).alias("bytes_received"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(s & (F.col("protocol") == "arp")).alias("arp_packets"),
        F.count_if(s & F.col("dns_name").isNotNull()).alias("dns_queries"),
        F.countDistinct("ip").alias("local_ips"), F.countDistinct("peer").alias("external_peers"), F.min("seq").alias("first_ord"),
    )


def gateway(packets: DataFrame) -> DataFrame:
    """(mac, votes): the MAC in front of most outside addresses; the first one seen of equals."""
    out = F.struct(F.col("dst_mac").alias("mac"), F.when(~F.col("dst_local") & ~F.col("dst_broadcast") & ~F.col("dst_mac_broadcast"), F.col("dst_ip")).alias("ip"), (F.col("ord") * 2).alias("seq"))
    back = F.struct(F.col("src_mac").alias("mac"), F.when(~F.col("src_local") & ~F.col("dst_broadcast"), F.col("src_ip")).alias("ip"), (F.col("ord") * 2 + 1).alias("seq"))
    votes = packets.select(F.explode(F.array(out, back)).alias("v")).select("v.*").filter(F.col("ip").isNotNull())
    return votes.groupBy("mac").agg(F.least(F.countDistinct("ip"), F.lit(MAX_VOTES)).alias("votes"), F.min("seq").alias("_seq")).orderBy(F.desc("votes"), "_seq").limit(1).drop("_seq")


def end_text(ip: str, mac: str, port: str) -> Column:
    """address#port, the MAC where there is no address."""
    return F.concat(F.coalesce(F.col(ip), F.col(mac)), F.lit("#"), F.coalesce(F.col(port).cast("string"), F.lit("")))


def flow_keys(packets: DataFrame) -> DataFrame:
    """packets with flow_key, the same for both directions; broadcasts keep theirs."""
    a = end_text("src_ip", "src_mac", "src_port")
    b = F.when(F.col("dst_broadcast"), F.concat(F.lit("broadcast#"), F.coalesce(F.col("dst_port").cast("string"), F.lit("")))).otherwise(end_text("dst_ip", "dst_mac", "dst_port"))
    low, high = F.when(F.col("dst_broadcast") | (a <= b), a).otherwise(b), F.when(F.col("dst_broadcast") | (a <= b), b).otherwise(a)
    return packets.withColumns({"_from": a, "_to": b}).withColumn("flow_key", F.concat_ws("|", "protocol", low, high))


def flows(packets: DataFrame) -> DataFrame:
    """(flow_key, protocol, ends of the first packet, packets, bytes, bytes_from_initiator, times, first_ord).

    Bytes of the end with the lesser text are summed beside all bytes; which of
    the two began is known with the first packet, so one aggregation and one
    shuffle do.
    """
    keyed = flow_keys(packets).withColumn("_lesser", F.coalesce("_from", F.lit("")) <= F.coalesce("_to", F.lit("")))
    first = F.min_by(F.struct("src_mac", "dst_mac", "src_ip", "dst_ip", "src_port", "dst_port", "src_local", "dst_local", "dst_broadcast", "_lesser"), "ord")
    whole = keyed.groupBy("flow_key", "protocol").agg(
        F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"), F.sum(F.when(F.col("_lesser"), F.col("orig_len"))).alias("_low"), F.sum(F.when(~F.col("_lesser"), F.col("orig_len"))).alias("_high"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("ord").alias("first_ord"), first.alias("first"),
    )
    return whole.select("flow_key", "protocol", "first.*", "packets", "bytes", F.when(F.col("first._lesser"), F.col("_low")).otherwise(F.col("_high")).alias("bytes_from_initiator"), "first_seen", "last_seen", "first_ord").drop("_lesser")


def keep_first_seen(rows: DataFrame, key: list[str], limit: int, order: str = "ord") -> DataFrame:
    """rows with kept: whether their key is among the first `limit` keys to appear.

    The first keys come from a bounded top-k over one row a key, so no window
    runs over all keys.
    """
    first = rows.groupBy(*key).agg(F.min(order).alias("_first")).orderBy("_first", *key).limit(limit).select(*key, F.lit(True).alias("_kept"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return rows.alias("l").join(first.alias("r"), on, "left").select("l.*", F.coalesce("_kept", F.lit(False)).alias("kept"))


def flow_cap(packets: DataFrame, limit: int = MAX_FLOWS) -> DataFrame:
    """One row: tracked flows and packets, packets of flows beyond the cap."""
    rows = keep_first_seen(flow_keys(packets), ["flow_key"], limit)
    return rows.agg(F.countDistinct(F.when(F.col("kept"), F.col("flow_key"))).alias("tracked_flows"), F.count_if("kept").alias("tracked_packets"), F.count_if(~F.col("kept")).alias("dropped_flow_packets"))


def services(rows: DataFrame, ports: DataFrame) -> DataFrame:
    """rows with category and service_port: arp and icmp by protocol, else the destination's port before the source's."""
    d = F.broadcast(ports.select("protocol", F.col("port").alias("dst_port"), F.col("category").alias("_d")))  # a dozen rows
    s = F.broadcast(ports.select("protocol", F.col("port").alias("src_port"), F.col("category").alias("_s")))
    out = rows.join(d, ["protocol", "dst_port"], "left").join(s, ["protocol", "src_port"], "left")
    short = F.when(F.col("protocol").isin("arp", "icmp"), F.col("protocol")).when(F.col("protocol") == "icmpv6", "icmp")
    port = F.when(short.isNull(), F.when(F.col("_d").isNotNull(), F.col("dst_port")).when(F.col("_s").isNotNull(), F.col("src_port")))
    return out.withColumn("category", F.coalesce(short, "_d", "_s", F.lit("other"))).withColumn("service_port", port).drop("_d", "_s")


def with_scope(rows: DataFrame) -> DataFrame:
    scope = F.when(F.col("dst_broadcast"), "broadcast").when(F.col("src_local") & F.col("dst_local"), "internal").otherwise("external")
    return rows.withColumn("scope", scope)


def category_bytes(rows: DataFrame) -> DataFrame:
    """(category, bytes, flows)."""
    return rows.groupBy("category").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_flows"))


def encrypted_share(rows: DataFrame) -> DataFrame:
    """One row: bytes, of them encrypted, per cent."""
    safe = F.sum(F.when(F.col("category").isin(*dims.ENCRYPTED), F.col("bytes")).otherwise(0))
    return rows.agg(F.sum("bytes").alias("bytes"), safe.alias("encrypted_bytes")).withColumn("encrypted_pct", F.when(F.col("bytes") > 0, F.floor((200 * F.col("encrypted_bytes") + F.col("bytes")) / (2 * F.col("bytes")))).otherwise(0).cast("long"))


def endpoints(packets: DataFrame) -> DataFrame:
    """(ip, packets, bytes, first_ord) of outside addresses; a packet may count for both ends."""
    a = F.struct(F.when(~F.col("src_local"), F.col("src_ip")).alias("ip"), (F.col("ord") * 2).alias("seq"))
    b = F.struct(F.when(~F.col("dst_local") & ~F.col("dst_broadcast"), F.col("dst_ip")).alias("ip"), (F.col("ord") * 2 + 1).alias("seq"))
    rows = packets.select("orig_len", F.explode(F.array(a, b)).alias("e")).select("orig_len", "e.*").filter(F.col("ip").isNotNull())
    return rows.groupBy("ip").agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"), F.min("seq").alias("first_ord"))


def top_with_overflow(rows: DataFrame, key: str, by: str, n: int, other: str = "other") -> DataFrame:
    """The first n rows by a sum, all others as one row: (key, packets, bytes, n_keys)."""
    top = rows.orderBy(F.desc(by), key).limit(n).select(key, F.lit(True).alias("_top"))
    label = F.when(F.col("_top"), F.col(key)).otherwise(F.lit(other))
    return rows.join(top, key, "left").groupBy(label.alias(key)).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.count("*").alias("n_keys"))


def dns_names(packets: DataFrame) -> DataFrame:
    """(dns_kind, dns_name, n)."""
    return packets.filter(F.col("dns_name").isNotNull()).groupBy("dns_kind", "dns_name").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def dns_domains(names: DataFrame, n: int = 12) -> DataFrame:
    """(domain, n): the most asked domains, names folded to their last two labels."""
    return names.groupBy(domain_summary("dns_name").alias("domain")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "domain").limit(n)


def flow_devices(rows: DataFrame) -> DataFrame:
    """rows with from_device and to_device, the MACs of the local ends; a broadcast has no second one."""
    return rows.withColumn("from_device", F.when(F.col("src_local"), F.col("src_mac"))).withColumn("to_device", F.when(F.col("dst_local") & ~F.col("dst_broadcast"), F.col("dst_mac")))


def outbound_bytes(rows: DataFrame) -> DataFrame:
    """(device, bytes): what each local device sent in outside flows, whoever began them."""
    ends = F.array(
        F.struct(F.col("from_device").alias("device"), F.col("bytes_from_initiator").alias("sent")),
        F.struct(F.col("to_device").alias("device"), (F.col("bytes") - F.col("bytes_from_initiator")).alias("sent")),
    )
    out = flow_devices(rows.filter(F.col("scope") == "external")).select(F.inline(ends))
    return out.filter(F.col("device").isNotNull()).groupBy("device").agg(F.sum("sent").alias("bytes"))


def numbered(rows: DataFrame, by: list[Column], name: str, prefix: str, most: int) -> DataFrame:
    """The first `most` rows in an order, numbered prefix-1, prefix-2, ...; the bound keeps the one window small."""
    top = rows.orderBy(*by).limit(most)
    return top.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(*by)).cast("string")))


def timeline(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events of each flow: 1 + floor(log2 packets) up to 8, evenly spaced over its part of the capture.

    start, end: the capture's range in seconds, as literals or columns.
    """
    span = F.greatest(F.lit(1.0), (end - start).cast("double"))
    at = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.unix_seconds(F.to_timestamp(c)) - start) / span))
    n = size_class("packets") + 1
    rows = rows.withColumn("_a", F.coalesce(at(F.col("first_seen")), F.lit(0.1))).withColumn("_b", F.coalesce(at(F.col("last_seen")), F.lit(0.9))).withColumn("_n", n)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("event"))
    t = F.when(F.col("_n") == 1, (F.col("_a") + F.col("_b")) / 2).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("event") / (F.col("_n") - 1))
    return rows.withColumn("t", t).drop("_a", "_b", "_n")


def _admin() -> Column:
    return F.col("category").isin("ssh", "rdp") | F.coalesce(F.col("service_port").isin(*dims.ADMIN_PORTS), F.lit(False))


def _critical() -> Column:
    return F.coalesce(F.col("service_port").isin(*dims.CRITICAL_PORTS), F.lit(False))


def watch_rules(devices: DataFrame, flow_rows: DataFrame, unique_names: DataFrame, limits: dict[str, int] | None = None, inventory: bool = True) -> DataFrame:
    """(rule, level, subject, n_devices, n_flows, value, flows): one alert a rule that fires, but one a device that sent much.

    devices: (device, role, is_known, dns_queries, external_peers,
    outbound_bytes), of which role "device" counts; flow_rows: with scope and
    service, a row a flow; unique_names: one row, n.  flows holds the first ten
    keys by bytes.  All port rules go through one pass.  An outside flow raises the port rules from review to watch.
    """
    most = {"outbound": dims.OUTBOUND_BYTES, "device_dns": dims.DEVICE_DNS, "unique_dns": dims.UNIQUE_DNS, "peers": dims.EXTERNAL_PEERS} | (limits or {})
    real = devices.filter(F.col("role") == "device")
    row = lambda rule, level, subject, n, value: [F.lit(rule).alias("rule"), F.lit(level).alias("level"), subject.alias("subject"), n.cast("long").alias("n_devices"), F.lit(0).cast("long").alias("n_flows"), value.cast("long").alias("value"), F.lit("").alias("flows")]
    counts = real.agg(
        F.count_if(~F.col("is_known")).alias("unknown"), F.count_if(F.col("dns_queries") > most["device_dns"]).alias("chatty"),
        F.count_if(F.col("external_peers") > most["peers"]).alias("fan"), F.max("external_peers").alias("peers"), F.max("dns_queries").alias("asked"),
    )
    none = F.lit("")
    out = real.filter(F.col("outbound_bytes") > most["outbound"]).select(*row("high-outbound-volume", "review", F.col("device"), F.lit(1), F.col("outbound_bytes")))
    if inventory:
        out = out.unionByName(counts.filter("unknown > 0").select(*row("unknown-device", "review", none, F.col("unknown"), F.col("unknown"))))
    out = out.unionByName(counts.filter("fan > 0").select(*row("many-external-endpoints", "review", none, F.col("fan"), F.col("peers"))))
    both = counts.select("chatty", "asked", F.lit(1).alias("_k")).join(unique_names.select("n", F.lit(1).alias("_k")), "_k")  # one row each
    fires = both.filter((F.col("chatty") > 0) | (F.col("n") > most["unique_dns"]))
    out = out.unionByName(fires.select(*row("many-dns-queries", "info", none, F.col("chatty"), F.when(F.col("chatty") > 0, F.col("asked")).otherwise(F.col("n")))))
    tests = (("admin-remote-ports", _admin(), True), ("critical-ports", _critical() & (F.col("category") != "ssh"), True), ("unencrypted-http", F.col("category") == "http", False))
    rules = F.array_compact(F.array(*[F.when(test, rule) for rule, test, _ in tests]))
    found = flow_devices(flow_rows).select("flow_key", "scope", "bytes", "first_ord", "from_device", "to_device", F.explode(rules).alias("rule"))
    # of a flow's two ends the first counts the flow
    ends = F.array(F.struct(F.col("from_device").alias("device"), F.lit(1).alias("one")), F.struct(F.col("to_device").alias("device"), F.lit(0).alias("one")))
    each = found.select("rule", "scope", F.inline(ends)).groupBy("rule", "device").agg(F.sum("one").alias("one"), F.bool_or(F.col("scope") == "external").alias("outside"))
    seen = each.groupBy("rule").agg(F.sum("one").alias("n_flows"), F.count("device").alias("n_devices"), F.coalesce(F.bool_or("outside"), F.lit(False)).alias("outside"))
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("bytes"), "first_ord"))).filter(F.col("_k") <= 10)
    first = first.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "flow_key"))), lambda x: x["flow_key"]), ",").alias("flows"))
    raised = F.col("rule").isin(*[rule for rule, _, up in tests if up])
    level = F.when(F.col("outside") & raised, "watch").otherwise("review")
    return out.unionByName(seen.join(first, "rule").select("rule", level.alias("level"), none.alias("subject"), "n_devices", "n_flows", F.col("n_flows").alias("value"), "flows"))


def alert_order(alerts: DataFrame) -> DataFrame:
    """Watch before review before info."""
    return alerts.orderBy(F.when(F.col("level") == "watch", 0).when(F.col("level") == "review", 1).otherwise(2), "rule", "subject")


def attention(rows: DataFrame) -> DataFrame:
    """rows with attention: unclassified, then review of plain web traffic, then watch or review by port, else routine."""
    by_scope = F.when(F.col("scope") == "external", "watch").otherwise("review")
    state = F.when(F.col("category") == "other", "unclassified").when(F.col("category") == "http", "review").when(_admin() | _critical(), by_scope).otherwise("routine")
    return rows.withColumn("attention", state)


def summary_stats(devices: DataFrame, flow_rows: DataFrame) -> DataFrame:
    """(stat, name, value): device counts, the three busiest categories, the busiest device (role "device")."""
    real = devices.filter(F.col("role") == "device")
    stat = lambda k, name, value: [F.lit(k).alias("stat"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("long").alias("value")]
    n = real.agg(F.count("*").alias("n"), F.count_if("is_known").alias("known"))
    out = n.select(*stat("devices", "", F.col("n"))).unionByName(n.select(*stat("known_devices", "", F.col("known"))))
    out = out.unionByName(n.select(*stat("unknown_devices", "", F.col("n") - F.col("known"))))
    top = category_bytes(flow_rows).filter("bytes > 0").orderBy(F.desc("bytes"), "category").limit(3)
    out = out.unionByName(top.select(*stat("top_category", F.col("category"), F.col("bytes"))))
    busiest = real.filter("total_bytes > 0").orderBy(F.desc("total_bytes"), "device").limit(1)
    return out.unionByName(busiest.select(*stat("busiest_device", F.col("device"), F.col("total_bytes"))))


def node_ids(hosts: DataFrame, gateway_row: DataFrame, limit: int = MAX_HOSTS) -> DataFrame:
    """(mac, node_id, role, total_bytes) of the first hosts to be seen: gateway, and dev-1, dev-2, ... by total bytes."""
    kept = hosts.orderBy("first_ord").limit(limit).withColumn("total_bytes", F.col("bytes_sent") + F.col("bytes_received"))
    kept = kept.join(F.broadcast(gateway_row.select("mac", F.lit(True).alias("_gw"))), "mac", "left").withColumn("_gw", F.coalesce("_gw", F.lit(False)))  # one row
    n = F.row_number().over(Window.partitionBy("_gw").orderBy(F.desc("total_bytes"), "first_ord"))
    return kept.select("mac", F.when(F.col("_gw"), "gateway").otherwise(F.concat(F.lit("dev-"), n.cast("string"))).alias("node_id"), F.when(F.col("_gw"), "gateway").otherwise("device").alias("role"), "total_bytes")


def endpoint_ids(ends: DataFrame, limit: int = MAX_ENDPOINTS, shown: int = TOP_ENDPOINTS) -> DataFrame:
    """(ip, node_id, bytes): ext-1, ext-2, ... by bytes of the first addresses to be seen; all beyond the shown ones share ext-other."""
    kept = ends.orderBy("first_ord").limit(limit)
    n = F.row_number().over(Window.orderBy(F.desc("bytes"), "first_ord"))  # at most `limit` rows
    return kept.select("ip", F.when(n <= shown, F.concat(F.lit("ext-"), n.cast("string"))).otherwise("ext-other").alias("node_id"), "bytes")


def flow_edges(rows: DataFrame, nodes: DataFrame, ends: DataFrame, shown: int = TOP_FLOWS) -> DataFrame:
    """(flow_id, from_id, to_id, category, service_port, scope, packets, bytes): the largest flows whose both ends have a node.

    A local end is the node of its MAC, an outside one that of its address.
    Flows without a node for an end take no number.
    """
    mac = lambda side: nodes.select(F.col("mac").alias(f"{side}_mac"), F.col("node_id").alias(f"_{side}_dev"))
    ip = lambda side: ends.select(F.col("ip").alias(f"{side}_ip"), F.col("node_id").alias(f"_{side}_ext"))
    # both tables hold a bounded number of rows
    out = rows
    for side in ("src", "dst"):
        out = out.join(F.broadcast(mac(side)), f"{side}_mac", "left").join(F.broadcast(ip(side)), f"{side}_ip", "left")
    from_id = F.when(F.col("src_local"), F.col("_src_dev")).otherwise(F.col("_src_ext"))
    to_id = F.when(F.col("dst_broadcast"), "broadcast").when(F.col("dst_local"), F.col("_dst_dev")).otherwise(F.col("_dst_ext"))
    found = out.withColumn("from_id", from_id).withColumn("to_id", to_id).filter(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    top = numbered(found, [F.desc("bytes"), F.col("first_ord")], "flow_id", "flow-", shown)
    return top.select("flow_id", "from_id", "to_id", "category", "service_port", "scope", "packets", "bytes")


def node_categories(edges: DataFrame) -> DataFrame:
    """(node_id, categories): distinct categories of each node's flows, by the number of their largest flow."""
    seq = F.substring_index("flow_id", "-", -1).cast("int")
    each = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id"), "category", seq.alias("seq")).groupBy("node_id", "category").agg(F.min("seq").alias("seq"))
    return each.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "category"))), lambda x: x["category"]).alias("categories"))


def flow_attention_reasons(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """(flow_key, attention, reasons): a flow's own state or that of its alerts, whichever is higher; alerts: (level, flows)."""
    rank = lambda c: F.when(c == "watch", 3).when(c == "review", 2).when(c == "unclassified", 1).otherwise(0)
    linked = alerts.filter(F.col("level").isin("watch", "review") & (F.col("flows") != "")).select("rule", "level", F.explode(F.split("flows", ",")).alias("flow_key"))
    linked = linked.groupBy("flow_key").agg(F.max(rank(F.col("level"))).alias("_linked"), F.sort_array(F.collect_set("rule")).alias("reasons"))
    # an alert names ten flows at most, so the flows themselves stay where they are
    out = attention(rows).join(F.broadcast(linked), "flow_key", "left").withColumn("_n", F.greatest(rank(F.col("attention")), F.coalesce("_linked", F.lit(0))))
    state = F.element_at(F.array(*[F.lit(x) for x in ("routine", "unclassified", "review", "watch")]), F.col("_n") + 1)
    return out.select("flow_key", state.alias("attention"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
