"""Inventory of devices: ordered import by MAC, else by address.

An import is a sequence.  Each row looks its MAC up, then its address; a hit
takes the row's values but keeps its own id and time of entry, a miss enters
the inventory and answers later rows.  A hit does not make the row's other key
known.  So a new row enters if and only if no key of it is held, or was brought
by a row that entered before it; which rows enter is found round by round over
all keys at once, without a group of rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved
from .tables import KeyedTable

#: Fields of a device beside id, mac, ip and times, in the order of a saved inventory.
FIELDS = ("device", "vendor", "hostnames", "status", "notes", "security")
SCHEMA = "network string, id string, ord long, device string, mac string, vendor string, ip string, hostnames string, status string, notes string, security string, added_at timestamp, updated_at timestamp"
#: Rounds before what is left, long chains of rows that share keys by turns, is settled chain by chain.
ROUNDS = 12


def _key(c: str) -> Column:
    return F.nullif(F.upper(c) if c == "mac" else F.col(c), F.lit(""))


def keys_of(rows: DataFrame) -> DataFrame:
    """(network, kind, k, ord): a row a key."""
    each = F.array(*[F.struct(F.lit(c).alias("kind"), _key(c).alias("k")) for c in ("mac", "ip")])
    return rows.select("network", "ord", F.inline(each)).filter(F.col("k").isNotNull())


def entering(keys: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(network, ord) of the rows that enter; keys: (network, kind, k, ord) of rows none of whose keys is held.

    A row all of whose keys it is the first to bring enters; the rows that
    share a key with it don't.  Each round settles the first row of every
    group of rows that touch, so only chains need many.
    """
    key, found, left = ["network", "kind", "k"], [], saved(keys, "keys")
    for _ in range(rounds):
        if left.isEmpty():
            break
        first = left.groupBy(*key).agg(F.min("ord").alias("_first"))
        ranked = left.join(first, key).groupBy("network", "ord").agg(F.min(F.col("_first") == F.col("ord")).alias("_in"))
        entered = saved(ranked.filter("_in").select("network", "ord"), "entered")
        found.append(entered)
        shut = left.join(entered, ["network", "ord"], "left_semi").select(*key).distinct()
        out = left.join(shut, key, "left_semi").select("network", "ord").distinct()
        left = saved(left.join(out, ["network", "ord"], "left_anti"), "keys")
    if not left.isEmpty():
        found.append(_chains(left))
    return reduce(DataFrame.unionByName, found) if found else keys.select("network", "ord").limit(0)


def _chains(keys: DataFrame) -> DataFrame:
    """The same for what the rounds left, each component in its own order."""
    from .graph import connected

    row, mark = F.concat_ws("\x1f", F.lit("r"), "network", F.col("ord").cast("string")), F.concat_ws("\x1f", F.lit("k"), "network", "kind", "k")
    comps = connected(keys.select(row.alias("a"), mark.alias("b")))
    rows = keys.groupBy("network", "ord").agg(F.collect_list(mark).alias("marks")).join(comps.withColumnRenamed("node", "_n"), row == F.col("_n")).select("comp", "network", "ord", "marks")  # two marks a row at most

    def settled(pdf):
        held, keep = set(), []
        pdf = pdf.sort_values("ord")
        for marks in pdf["marks"]:
            keep.append(not held.intersection(marks))
            if keep[-1]:
                held.update(marks)
        return pdf.loc[keep, ["network", "ord"]]

    shape = ", ".join(f"{c} {keys.schema[c].dataType.simpleString()}" for c in ("network", "ord"))
    return rows.groupBy("comp").applyInPandas(settled, shape)


def imported(held: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """held after the rows of new, in their order of ord, have been taken in.

    held and new: SCHEMA, with one row an ord in a network; ids and times of entry of new count for rows that
    enter.  Of rows of held that share a key the last one answers for it; a row
    without MAC and address enters for itself and answers to nobody.  Nulls are
    taken as empty; rows of a null network stay apart, like any other network.
    """
    columns = [f.name for f in held.schema]
    new = saved(new.select(*columns).withColumn("network", F.coalesce("network", F.lit(""))), "incoming")
    held = held.withColumn("network", F.coalesce("network", F.lit("")))
    owners = keys_of(held.select("network", "mac", "ip", "ord")).groupBy("network", "kind", "k").agg(F.max("ord").alias("owner"))
    brought = keys_of(new)
    by_held = saved(brought.join(owners, ["network", "kind", "k"]).select("network", "ord", "kind", F.col("owner").alias("target"), F.lit(0).alias("side")), "held-hits")
    free = brought.join(by_held.select("network", "ord").distinct(), ["network", "ord"], "left_anti")
    entered = saved(entering(free), "entering")
    # a key that a row entered with answers for the rows after it
    opened = brought.join(entered, ["network", "ord"], "left_semi").withColumnRenamed("ord", "target")
    by_new = brought.join(opened, ["network", "kind", "k"]).filter("target < ord").select("network", "ord", "kind", "target", F.lit(1).alias("side"))
    hits = by_held.unionByName(by_new).groupBy("network", "ord").agg(F.max_by(F.struct("side", "target"), "kind").alias("hit"))  # "mac" comes before "ip"
    none = new.join(brought.select("network", "ord").distinct(), ["network", "ord"], "left_anti").select("network", "ord")
    entered = entered.unionByName(none)
    last = new.join(hits, ["network", "ord"]).groupBy("network", "hit").agg(F.max_by(F.struct("device", "mac", "ip", *FIELDS[1:]), "ord").alias("v"))
    base = held.withColumn("side", F.lit(0)).unionByName(new.join(entered, ["network", "ord"], "left_semi").withColumn("side", F.lit(1)))
    both = base.join(last.select("network", "hit.side", F.col("hit.target").alias("ord"), "v"), ["network", "side", "ord"], "left")
    change = lambda c: F.when(F.col("v").isNotNull(), F.col(f"v.{c}")).otherwise(F.col(c)).alias(c)
    # places count on from the inventory's last one, network by network, in the order of import
    most = held.groupBy("network").agg(F.max("ord").alias("_most"))
    least = new.groupBy("network").agg(F.min("ord").alias("_least"))
    both = both.join(most, "network", "left").join(least, "network", "left")
    place = F.when(F.col("side") == 0, F.col("ord")).otherwise(F.coalesce(F.col("_most") + 1, F.lit(0)) + F.col("ord") - F.col("_least"))
    out = both.select("network", "id", place.alias("ord"), *[change(c) for c in ("mac", "ip", *FIELDS)], "added_at", F.when(F.col("v").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"))
    return out.select(*columns)


class Inventory:
    """Inventories of all networks in one keyed table."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path, SCHEMA, ["network", "id"])

    def import_rows(self, rows: DataFrame, now: Column) -> None:
        """Rows of a list, with network, ord and the fields; ids come from network, list and place."""
        n, folder = self.table._newest()
        held = self.table._rows(folder)
        full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns if c not in ("id", "added_at", "updated_at")])
        made = F.concat(F.lit("dev_"), F.substring(F.sha2(F.concat_ws("\x1f", "network", F.lit(str(n)), F.col("ord").cast("string")), 256), 1, 12))
        self.table.write(imported(held, full.withColumns({"id": made, "added_at": now, "updated_at": now}), now), n)

    def devices(self, network: str) -> DataFrame:
        return self.table.read().filter(F.col("network") == network)

    def networks(self) -> DataFrame:
        """(network, devices, updated_at), in order of name."""
        return self.table.read().groupBy("network").agg(F.count("*").alias("devices"), F.max("updated_at").alias("updated_at")).orderBy("network")

    def by_address(self, network: str, ip: str) -> DataFrame:
        """The first device of an address."""
        return self.devices(network).filter(F.col("ip") == ip).orderBy("ord").limit(1)
