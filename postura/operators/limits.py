"""What a capture's parser tracks: the first packets, and the first keys of each kind.

packets: as in traffic, with capture; ord is a packet's place in its capture.
Packets of one place count as one step: all of them are in or out.  Keys that
first appear in one place go by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .places import placed
from .traffic import MAX_ENDPOINTS, MAX_FLOWS, MAX_HOSTS, MAX_NAMES, flow_keys

# Packets of a capture that are looked at, and keys of each kind that are tracked.
MAX_PACKETS = 200_000
LIMITS = {"flow": MAX_FLOWS, "host": MAX_HOSTS, "endpoint": MAX_ENDPOINTS, "name": MAX_NAMES}
#: Kinds whose dropped keys mark a capture as truncated; hosts are dropped without a word.
TOLD = ("flow", "endpoint", "name")


def first_packets(packets: DataFrame, most: int = MAX_PACKETS) -> DataFrame:
    """packets up to the most-th of each capture, of any number of captures and any length.

    Only captures with more are ranked, by places over range-dealt parts.  They
    and their ends, a row for `most` packets at the least, are sent to all, so
    no capture's packets meet in one task.
    """
    long = F.broadcast(packets.groupBy("capture").count().filter(F.col("count") > most).select("capture"))
    ranked = placed(packets.select("capture", "ord").join(long, "capture", "left_semi"), "capture", ["ord"])
    cut = ranked.filter(F.col("place") == most).select("capture", F.col("ord").alias("_cut"))
    return packets.join(F.broadcast(cut), "capture", "left").filter(F.col("_cut").isNull() | (F.col("ord") <= F.col("_cut"))).drop("_cut")


def key_uses(packets: DataFrame) -> DataFrame:
    """(capture, kind, k, seq): each use of a key by a packet, in the order of seq."""
    role = lambda kind, k, back: F.struct(F.lit(kind).alias("kind"), k.alias("k"), (F.col("ord") * 2 + back).alias("seq"))
    outside = lambda local, ip: F.when(~F.col(local), F.col(ip))
    uses = F.array(
        role("flow", F.col("flow_key"), 0), role("host", F.col("src_mac"), 0), role("host", F.when(~F.col("dst_mac_broadcast"), F.col("dst_mac")), 1),
        role("endpoint", outside("src_local", "src_ip"), 0), role("endpoint", F.when(~F.col("dst_broadcast"), outside("dst_local", "dst_ip")), 1), role("name", F.concat_ws("|", "dns_kind", F.when(F.col("dns_name").isNotNull(), F.col("dns_name"))), 0),
    )
    named = F.when(F.col("kind") != "name", F.col("k").isNotNull()).otherwise(F.col("dns_name").isNotNull())
    return flow_keys(packets).select("capture", "dns_name", F.inline(uses)).filter(named).select("capture", "kind", "k", "seq")


def tracked_keys(packets: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(capture, kind, k, uses, tracked): a row a key; tracked are the first to appear.

    All kinds go through one aggregation; a key's rank is only taken among the
    first of its kind, and what stands beyond is told by the last one's place,
    a row a kind of a capture with so many keys that is sent to all.
    """
    limits = LIMITS if limits is None else limits
    keys = key_uses(packets).groupBy("capture", "kind", "k").agg(F.min("seq").alias("first"), F.count("*").alias("uses"))
    most = F.create_map(*[x for kind, n in limits.items() for x in (F.lit(kind), F.lit(n))])
    ranked = keys.withColumn("place", F.row_number().over(Window.partitionBy("capture", "kind").orderBy("first", "k"))).filter(F.col("place") <= max(limits.values()))
    cut = ranked.filter(F.col("place") == F.try_element_at(most, F.col("kind"))).select("capture", "kind", F.struct("first", "k").alias("_cut"))
    return keys.join(F.broadcast(cut), ["capture", "kind"], "left").select("capture", "kind", "k", "uses", F.coalesce(F.struct("first", "k") <= F.col("_cut"), F.lit(True)).alias("tracked"))


def limit_counts(packets: DataFrame, most: int = MAX_PACKETS, limits: dict[str, int] | None = None) -> DataFrame:
    """(capture, kind, tracked, dropped, uses, dropped_uses, truncated): a row a kind of each capture, packets too.

    dropped_uses: uses of keys beyond the limit, every later one counted; a
    capture counts as truncated when its packets reach their limit.
    """
    keys = tracked_keys(first_packets(packets, most), limits)
    t = F.col("tracked")
    counts = keys.groupBy("capture", "kind").agg(F.count_if(t).alias("tracked"), F.count_if(~t).alias("dropped"), F.sum(F.when(t, F.col("uses")).otherwise(0)).alias("uses"), F.sum(F.when(~t, F.col("uses")).otherwise(0)).alias("dropped_uses"))
    counts = counts.withColumn("truncated", F.col("kind").isin(*TOLD) & (F.col("dropped") > 0))
    n = packets.groupBy("capture").agg(F.count("*").alias("n"))
    seen, past = F.least("n", F.lit(most)), F.greatest(F.col("n") - most, F.lit(0))
    return counts.unionByName(n.select("capture", F.lit("packet").alias("kind"), seen.alias("tracked"), past.alias("dropped"), seen.alias("uses"), past.alias("dropped_uses"), (F.col("n") >= most).alias("truncated")))
