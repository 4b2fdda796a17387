"""Matching devices of two observations, tier by tier, and merging records of one.

devices: (device_id, ...) with key columns; a tier is (name, key columns,
confirms): pairs that share a key are candidates, and a candidate is a match
if neither side has another one and the tier may confirm.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .pairs import sharing

#: (rule, confidence, whether a unique candidate is confirmed), strongest first.
TIERS = (
    ("persisted-device-id", "strongest", True),
    ("mac", "strong", True),
    ("hashed-mac", "strong", True),
    ("hostname-vendor", "medium", False),
    ("ip-continuity", "low", False),
)
#: Change events in order.
EVENT_RANK = {
    "identity-uncertain": 10, "new-device-observed": 20, "previously-observed-device-not-observed": 30,
    "service-or-port-opened": 40, "service-or-port-closed": 50, "important-device-metadata-changed": 60,
}


def _keyed(devices: DataFrame, keys: str, side: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(side_id, side_keys, keep): a row a device with a key; its keys distinct."""
    rows = devices.select("device_id", *keep, F.explode(keys).alias("k")).filter(F.col("k").isNotNull())
    return rows.groupBy(F.col("device_id").alias(f"{side}_id")).agg(F.collect_set("k").alias(f"{side}_keys"), *[F.min(c).alias(c) for c in keep])


def candidates(base: DataFrame, current: DataFrame, keys: str) -> DataFrame:
    """(base_id, current_id, shared): pairs with a key in common, keys sorted; one row a pair."""
    return sharing(_keyed(base, keys, "base"), _keyed(current, keys, "current"), "base_keys", "current_keys").select("base_id", "current_id", "shared")


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with n_base, n_current (candidates of either side) and unique."""
    out = pairs.withColumn("n_base", F.count("*").over(Window.partitionBy("base_id"))).withColumn("n_current", F.count("*").over(Window.partitionBy("current_id")))
    return out.withColumn("unique", (F.col("n_base") == 1) & (F.col("n_current") == 1))


class Tier(NamedTuple):
    """What one tier is about: the devices that stronger ones left, and what it tells of each."""

    rule: str
    confidence: str
    confirms: bool
    base: DataFrame
    current: DataFrame
    sides: DataFrame


def tier_sides(base: DataFrame, current: DataFrame, tiers: dict[str, str]) -> list[Tier]:
    """The tiers with sides: (side, device_id, rule, confidence, outcome, partner_id, n_links), as outcomes says.

    Work grows with the keys alone.  Tables of ids look small as Parquet, so
    they are joined by merging and never sent to all.
    """
    out: list[Tier] = []
    for rule, confidence, confirms in TIERS:
        if rule not in tiers:
            continue
        left, held = [], []
        for side, rows in (("base", base), ("current", current)):
            rows = rows.filter(F.col("device_id").isNotNull())
            for t in out:
                rows = rows.join(t.sides.filter(F.col("side") == side).select("device_id").hint("merge"), "device_id", "left_anti")
            left.append(rows)
            held.append(rows.select("device_id", F.explode(tiers[rule]).alias("k")).filter(F.col("k").isNotNull()).distinct())
        b, c = held
        count = lambda rows, side: rows.groupBy("k").agg(F.count("*").alias(f"n_{side}"), F.min("device_id").alias(f"one_{side}"))
        keys = count(b, "base").join(count(c, "current").hint("merge"), "k").hint("merge")
        alone = (F.col("n_base") == 1) & (F.col("n_current") == 1)

        def side_of(rows: DataFrame, name: str, other: str) -> DataFrame:
            each = rows.join(keys, "k").groupBy("device_id").agg(F.sum(f"n_{other}").alias("n_links"), F.min(f"one_{other}").alias("_least"), F.max(f"one_{other}").alias("_most"), F.min(alone).alias("_alone"))
            return each.select(F.lit(name).alias("side"), "device_id", "n_links", F.when(F.col("_alone") & (F.col("_least") == F.col("_most")), F.col("_least")).alias("partner_id"))

        rows = saved(side_of(b, "base", "current").unionByName(side_of(c, "current", "base")), "sides")
        other = rows.select(F.when(F.col("side") == "base", "current").otherwise("base").alias("side"), F.col("partner_id").alias("device_id"), F.col("device_id").alias("partner_id"), F.lit(True).alias("_both"))
        rows = rows.join(other.filter(F.col("device_id").isNotNull()).hint("merge"), ["side", "device_id", "partner_id"], "left")
        outcome = F.when(F.col("_both") & F.lit(confirms), "confirmed").otherwise("uncertain")
        rows = rows.select("side", "device_id", F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), outcome.alias("outcome"), F.when(F.col("_both"), F.col("partner_id")).alias("partner_id"), "n_links")
        out.append(Tier(rule, confidence, confirms, *left, saved(rows, "outcomes")))  # read by all weaker tiers, twice
    return out


def tier_pairs(found: list[Tier], tiers: dict[str, str], base_keep: tuple[str, ...] = (), current_keep: tuple[str, ...] = ()) -> DataFrame:
    """(base_id, current_id, rule, confidence, outcome, shared, what is kept): the pairs of the tiers.

    Only devices are written and shuffled; the pairs, of which there are as
    many as the contract asks for, are made last and go straight to the reader.
    """
    out: DataFrame | None = None
    for t in found:
        b, c = _keyed(t.base, tiers[t.rule], "base", base_keep), _keyed(t.current, tiers[t.rule], "current", current_keep)
        outcome = F.lit("uncertain")
        if t.confirms:
            sure = t.sides.filter((F.col("outcome") == "confirmed") & (F.col("side") == "base")).select(F.col("device_id").alias("base_id"), F.col("partner_id").alias("_partner"))
            b = b.join(sure.hint("merge"), "base_id", "left")
            outcome = F.when(F.col("_partner") == F.col("current_id"), "confirmed").otherwise("uncertain")
        pairs = sharing(b, c, "base_keys", "current_keys")
        rows = pairs.select("base_id", "current_id", F.lit(t.rule).alias("rule"), F.lit(t.confidence).alias("confidence"), outcome.alias("outcome"), "shared", *base_keep, *current_keep)
        out = rows if out is None else out.unionByName(rows)
    return out


def tier_askers(found: list[Tier], tiers: dict[str, str], base_keep: tuple[str, ...], current_id: str) -> tuple[DataFrame, DataFrame]:
    """The uncertain pairs of the tiers before they are pairs: (rule, confidence, _keys, what is kept), a row a base device, and (k, current_id).

    An uncertain device takes part in one tier alone and has no confirmed
    pair, so its pairs are all current devices that hold one of its keys.
    """
    asking, answering = [], []
    for t in found:
        prefix = F.lit(f"{t.rule}\u001e")
        unsure = t.sides.filter((F.col("side") == "base") & (F.col("outcome") == "uncertain")).select(F.col("device_id").alias("base_id"))
        b = _keyed(t.base, tiers[t.rule], "base", base_keep).join(unsure.hint("merge"), "base_id", "left_semi")
        asking.append(b.select(F.lit(t.rule).alias("rule"), F.lit(t.confidence).alias("confidence"), F.transform("base_keys", lambda k: F.concat(prefix, k)).alias("_keys"), *base_keep))
        answering.append(t.current.select(F.explode(tiers[t.rule]).alias("_k"), current_id).filter(F.col("_k").isNotNull()).select(F.concat(prefix, "_k").alias("k"), current_id))
    return reduce(DataFrame.unionByName, asking), reduce(DataFrame.unionByName, answering)


def tiered(base: DataFrame, current: DataFrame, tiers: dict[str, str]) -> DataFrame:
    """(base_id, current_id, rule, confidence, outcome, shared); tiers: rule -> column of keys.

    Devices that a tier matched, or left ambiguous, take no part in weaker
    tiers, nor do null ids in any.  Who they are is told device by device, as
    in outcomes; the pairs themselves are neither written nor shuffled.
    """
    return tier_pairs(tier_sides(base, current, tiers), tiers)


def outcomes(base: DataFrame, current: DataFrame, tiers: dict[str, str]) -> DataFrame:
    """(side, device_id, rule, confidence, outcome, partner_id, n_links): what tiered says, one row a device that found any.

    partner_id: the only candidate, where neither side has another; n_links:
    keys shared, counted with each device that has one.  A key that many
    devices of both sides hold gives counts, never its pairs, so work grows
    with the keys alone.  Null ids take no part.
    """
    return all_sides(tier_sides(base, current, tiers))


def all_sides(found: list[Tier]) -> DataFrame:
    """The sides of all tiers."""
    return reduce(DataFrame.unionByName, [t.sides for t in found])


def matched_ids(found: DataFrame) -> DataFrame:
    """(base_id, current_id): outcomes as unmatched takes them, one of both null."""
    own = lambda side: F.when(F.col("side") == side, F.col("device_id"))
    return found.select(own("base").alias("base_id"), own("current").alias("current_id"))


def unmatched(base: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """(event_type, device_id): devices on one side only."""
    new = current.select("device_id").join(matches.select(F.col("current_id").alias("device_id")).hint("merge"), "device_id", "left_anti")
    gone = base.select("device_id").join(matches.select(F.col("base_id").alias("device_id")).hint("merge"), "device_id", "left_anti")
    return new.select(F.lit("new-device-observed").alias("event_type"), "device_id").unionByName(gone.select(F.lit("previously-observed-device-not-observed").alias("event_type"), "device_id"))


def port_delta(pairs: DataFrame, base_ports: DataFrame, current_ports: DataFrame) -> DataFrame:
    """(base_id, current_id, change, protocol, port, service) of matched devices; protocol case is folded, the last row of a port wins.

    ports: (device_id, pos, protocol, port, service).
    """
    last = lambda rows: rows.groupBy("device_id", F.lower("protocol").alias("protocol"), "port").agg(F.max_by("service", "pos").alias("service"))
    b = pairs.select("base_id", "current_id").join(last(base_ports).withColumnRenamed("device_id", "base_id"), "base_id").withColumn("_in_base", F.lit(True))
    c = pairs.select("base_id", "current_id").join(last(current_ports).withColumnRenamed("device_id", "current_id"), "current_id").withColumnRenamed("service", "_service").withColumn("_in_current", F.lit(True))
    both = b.join(c, ["base_id", "current_id", "protocol", "port"], "full_outer").filter(F.col("_in_base").isNull() | F.col("_in_current").isNull())
    change = F.when(F.col("_in_base").isNull(), "service-or-port-opened").otherwise("service-or-port-closed")
    return both.select("base_id", "current_id", change.alias("change"), "protocol", "port", F.coalesce("_service", "service").alias("service"))


def metadata_changes(pairs: DataFrame, base: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(base_id, current_id, field, before, after) where a set of values differs; values sorted and comma-joined."""
    shape = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    b = base.select(F.col("device_id").alias("base_id"), *[shape(c).alias(f"_b_{c}") for c in columns])
    c = current.select(F.col("device_id").alias("current_id"), *[shape(c).alias(f"_c_{c}") for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"_b_{x}").alias("before"), F.col(f"_c_{x}").alias("after")) for x in columns]))
    return pairs.select("base_id", "current_id").join(b, "base_id").join(c, "current_id").select("base_id", "current_id", each.alias("m")).select("base_id", "current_id", "m.*").filter("before <> after")


def known(devices: DataFrame, inventory: DataFrame) -> DataFrame:
    """Devices in the inventory by MAC or, without that, by address: equi-joins, no OR; repeated devices stay."""
    macs = inventory.select(F.upper("mac").alias("_m")).filter(F.col("_m").isNotNull())
    by_mac = devices.join(macs, F.upper(devices["mac"]) == F.col("_m"), "left_semi")
    rest = devices.join(macs, F.upper(devices["mac"]) == F.col("_m"), "left_anti")
    by_ip = rest.join(inventory.select(F.col("ip").alias("_i")).filter(F.col("_i").isNotNull()), F.col("ip") == F.col("_i"), "left_semi")
    return by_mac.unionByName(by_ip)


def inventory_match(hosts: DataFrame, inventory: DataFrame) -> DataFrame:
    """hosts (mac, ips) with item: the first inventory row of the MAC, else the first of any of its addresses; hosts without a MAC keep theirs."""
    by_mac = inventory.groupBy(F.upper("mac").alias("_m")).agg(F.min_by("item", "ord").alias("_by_mac"))
    by_ip = inventory.filter(F.col("ip").isNotNull()).groupBy("ip").agg(F.min(F.struct("ord", "item")).alias("_hit"))
    ips = hosts.select(F.col("ips").alias("_ips")).distinct().select("_ips", F.explode("_ips").alias("ip")).join(by_ip, "ip").groupBy("_ips").agg(F.min("_hit").alias("_hit"))
    rows = hosts.join(by_mac, F.upper(hosts["mac"]) == F.col("_m"), "left").drop("_m").join(ips, F.col("ips") == F.col("_ips"), "left").drop("_ips")
    return rows.withColumn("item", F.coalesce("_by_mac", "_hit.item")).drop("_by_mac", "_hit")


def insert_absent(held: DataFrame, new: DataFrame) -> DataFrame:
    """held and those rows of new whose MAC and address it has not."""
    fresh = new.join(held.select(F.upper("mac").alias("_m")).filter(F.col("_m").isNotNull()), F.upper(new["mac"]) == F.col("_m"), "left_anti")
    fresh = fresh.join(held.select(F.col("ip").alias("_i")).filter(F.col("_i").isNotNull()), fresh["ip"] == F.col("_i"), "left_anti")
    return held.unionByName(fresh, allowMissingColumns=True)


def upsert(held: DataFrame, new: DataFrame, key: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Newest row a key; the columns in keep stay as they were first."""
    both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in held.columns if c not in key]
    out = both.groupBy(*key).agg(*[(F.min_by if c in keep else F.max_by)(c, F.struct("_new", order)).alias(c) for c in rest])
    return out.select(*held.columns)


def merged(records: DataFrame, prefix: str = "dev-") -> DataFrame:
    """(record_id, device_id): records that share a MAC or address, directly or through others, are one device.

    records: (record_id, macs, ips).  The device's id comes from its least
    MAC, else its least address, so it doesn't depend on the order of rows.
    """
    from .graph import connected

    marks = records.select("record_id", F.explode(F.concat(F.transform(F.coalesce("macs", F.array().cast("array<string>")), lambda m: F.concat(F.lit("0"), F.upper(m))), F.transform(F.coalesce("ips", F.array().cast("array<string>")), lambda i: F.concat(F.lit("1"), i)))).alias("mark"))
    ends = marks.select(F.concat(F.lit("r"), F.col("record_id").cast("string")).alias("a"), F.concat(F.lit("k"), "mark").alias("b"))
    comps = connected(ends)
    seeds = comps.filter(F.col("node").startswith("k")).groupBy("comp").agg(F.min("node").alias("seed"))
    ids = comps.filter(F.col("node").startswith("r")).join(seeds, "comp").select(F.expr("substring(node, 2)").alias("_r"), F.concat(F.lit(prefix), F.substring(F.sha2(F.expr("substring(seed, 3)"), 256), 1, 12)).alias("device_id"))
    own = F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit("record "), F.col("record_id").cast("string")), 256), 1, 12))
    return records.join(ids, records["record_id"].cast("string") == ids["_r"], "left").select("record_id", F.coalesce("device_id", own).alias("device_id"))
