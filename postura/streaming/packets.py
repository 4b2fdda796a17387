"""Streaming extensions: the batch operators' keys over unbounded sources.

The analytics are batch by nature; these are the parts that also make sense
on a stream.  Caps by first-seen key are not among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traffic import MAX_VOTES, flow_keys


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """New capture files in a folder, as a stream of (path, content)."""
    return spark.readStream.format("binaryFile").load(path).select("path", "content")


def _windowed(packets: DataFrame, window: str, late: str) -> DataFrame:
    """packets with their window w; on a stream those later than the watermark are left out."""
    rows = packets.withWatermark("ts", late) if packets.isStreaming else packets
    return rows.withColumn("w", F.window("ts", window))


def _again(rows: DataFrame, window: str) -> Column:
    """The window of rows that an aggregation by window w has made, for another one on top of it."""
    return F.window(F.window_time("w"), window).alias("w")


def flow_windows(packets: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, flow_key, packets, bytes) by event time; rows later than the watermark are left out."""
    keyed = flow_keys(packets.withWatermark("ts", late))
    return keyed.groupBy(F.window("ts", window).alias("w"), "flow_key").agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes")).select(F.col("w.start").alias("start"), "flow_key", "packets", "bytes")


def total_windows(packets: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, packets, bytes, first_seen, last_seen, arp_packets, icmp_packets, ipv6_packets) of each window."""
    p = F.col("protocol")
    return _windowed(packets, window, late).groupBy("w").agg(
        F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(p == "arp").alias("arp_packets"),
        F.count_if(p.startswith("icmp")).alias("icmp_packets"), F.count_if(F.col("src_ip").contains(":") | F.col("dst_ip").contains(":")).alias("ipv6_packets"),
    ).select(F.col("w.start").alias("start"), "packets", "bytes", "first_seen", "last_seen", "arp_packets", "icmp_packets", "ipv6_packets")


def host_windows(packets: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, mac, packets_sent, packets_received, bytes_sent, bytes_received, arp_packets, dns_queries, local_ips, external_peers).

    Distinct addresses come from two chained aggregations: one row a window,
    host and address, then one a window and host; a stream's state holds
    addresses of open windows only.
    """
    n, sent = F.col("orig_len"), F.lit(True)
    role = lambda mac, out, ip, peer: F.struct(F.col(mac).alias("mac"), out.alias("sent"), ip.alias("ip"), peer.alias("peer"))
    there = lambda ip, local, want: F.when(F.col(local) == want, F.col(ip))
    ends = F.array(
        role("src_mac", sent, there("src_ip", "src_local", True), F.when(~F.col("dst_broadcast"), there("dst_ip", "dst_local", False))),
        role("dst_mac", ~sent, F.when(~F.col("dst_broadcast"), there("dst_ip", "dst_local", True)), F.when(~F.col("dst_broadcast"), there("src_ip", "src_local", False))),
    )
    ends = F.when(F.col("dst_mac_broadcast"), F.slice(ends, 1, 1)).otherwise(ends)
    roles = _windowed(packets, window, late).select("w", "orig_len", "protocol", "dns_name", F.explode(ends).alias("r")).select("w", "orig_len", "protocol", "dns_name", "r.*")
    # each role once for its sums, and once for each address it tells
    tells = F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value")), F.when(F.col("ip").isNotNull(), F.struct(F.lit("ip").alias("kind"), F.col("ip").alias("value"))), F.when(F.col("peer").isNotNull(), F.struct(F.lit("peer").alias("kind"), F.col("peer").alias("value"))))
    rows = roles.select("*", F.inline(F.filter(tells, lambda x: x.isNotNull())))
    s = F.col("sent")
    each = rows.groupBy("w", "mac", "kind", "value").agg(
        F.count_if(s).alias("packets_sent"), F.count_if(~s).alias("packets_received"), F.sum(F.when(s, n).otherwise(0)).alias("bytes_sent"), F.sum(F.when(~s, n).otherwise(0)).alias("bytes_received"),
        F.count_if(s & (F.col("protocol") == "arp")).alias("arp_packets"), F.count_if(s & F.col("dns_name").isNotNull()).alias("dns_queries"),
    )
    sums = ("packets_sent", "packets_received", "bytes_sent", "bytes_received", "arp_packets", "dns_queries")
    whole = each.groupBy(_again(each, window), "mac").agg(
        *[F.sum(F.when(F.col("kind") == "", F.col(c)).otherwise(0)).alias(c) for c in sums], F.count_if(F.col("kind") == "ip").alias("local_ips"), F.count_if(F.col("kind") == "peer").alias("external_peers"),
    )
    return whole.select(F.col("w.start").alias("start"), "mac", *sums, "local_ips", "external_peers")


def gateway_windows(packets: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, mac, votes): outside addresses that each MAC stands before."""
    out = F.struct(F.col("dst_mac").alias("mac"), F.when(~F.col("dst_local") & ~F.col("dst_broadcast") & ~F.col("dst_mac_broadcast"), F.col("dst_ip")).alias("ip"))
    back = F.struct(F.col("src_mac").alias("mac"), F.when(~F.col("src_local") & ~F.col("dst_broadcast"), F.col("src_ip")).alias("ip"))
    each = _windowed(packets, window, late).select("w", F.inline(F.array(out, back))).filter(F.col("ip").isNotNull()).groupBy("w", "mac", "ip").count()
    return each.groupBy(_again(each, window), "mac").agg(F.least(F.count("*"), F.lit(MAX_VOTES)).alias("votes")).select(F.col("w.start").alias("start"), "mac", "votes")


def initiator_windows(packets: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, flow_key, protocol, packets, bytes, bytes_from_initiator, first_ord): flows with what the end that began sent."""
    each = flow_keys(_windowed(packets, window, late)).groupBy("w", "flow_key", "protocol", "_from").agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"), F.min("ord").alias("ord"))
    whole = each.groupBy(_again(each, window), "flow_key", "protocol").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min_by("bytes", "ord").alias("bytes_from_initiator"), F.min("ord").alias("first_ord"))
    return whole.select(F.col("w.start").alias("start"), "flow_key", "protocol", "packets", "bytes", "bytes_from_initiator", "first_ord")


def endpoint_windows(packets: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, ip, packets, bytes) of outside addresses; a packet may count for both ends."""
    ends = F.array(F.when(~F.col("src_local"), F.col("src_ip")), F.when(~F.col("dst_local") & ~F.col("dst_broadcast"), F.col("dst_ip")))
    rows = _windowed(packets, window, late).select("w", "orig_len", F.explode(ends).alias("ip")).filter(F.col("ip").isNotNull())
    return rows.groupBy("w", "ip").agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes")).select(F.col("w.start").alias("start"), "ip", "packets", "bytes")


def name_windows(packets: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, dns_kind, dns_name, n)."""
    rows = _windowed(packets, window, late).filter(F.col("dns_name").isNotNull())
    return rows.groupBy("w", "dns_kind", "dns_name").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "dns_kind", "dns_name", "n")


def first_observations(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """First row of each content hash within the watermark."""
    return rows.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def fixed_windows(requests: DataFrame, most: int = 20, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """(identity, at, allowed): at most so many requests in a window that starts with an identity's first request.

    Requests later than the watermark are left out; an identity's state goes
    once the watermark has passed its window.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        for pdf in [pd.concat(list(batches)).sort_values("at", kind="stable")]:  # all of an identity's requests of a trigger
            allowed = []
            for at in pdf["at"]:
                at = int(at.timestamp() * 1000)
                if start is None or at >= start + seconds * 1000:
                    start, n = at, 0
                n += 1
                allowed.append(n <= most)
            yield pd.DataFrame({"identity": key[0], "at": pdf["at"].to_numpy(), "allowed": allowed})
        state.update((start, n))
        state.setTimeoutTimestamp(max(start + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return requests.withWatermark("at", late).groupBy("identity").applyInPandasWithState(count, "identity string, at timestamp, allowed boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)
