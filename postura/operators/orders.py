"""Orders by the rules of language, with a place for each row.

Texts are compared by Spark's UNICODE collation (root rules: letters before
case, accents after letters), and where that finds no difference by their
bytes, so places are the same in every run.  Binary order is what all other
operators use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import EVENT_RANK
from .places import placed

COLLATION = "UNICODE"


def event_key(kind: str = "event_type", parts: tuple[str, ...] = ("base_id", "current_id", "base_port", "current_port", "event_id")) -> Column:
    """Sort key of a change event: rank of its kind, its devices and ports, its id; a null part is empty."""
    rank = F.create_map(*[F.lit(x) for k, n in EVENT_RANK.items() for x in (k, n)])[F.when(F.col(kind).startswith("identity-uncertain"), "identity-uncertain").otherwise(F.col(kind))]
    return F.concat_ws("|", F.lpad(rank.cast("string"), 2, "0"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])


def candidate_key(rule: str = "rule", base: str = "base_id", current: str = "current_id", values: str = "shared") -> Column:
    """Sort key of a candidate: rule, devices, shared values in order."""
    return F.concat_ws("|", rule, base, current, F.array_join(F.array_sort(values), ","))


def in_order(rows: DataFrame, group: str, key: Column, name: str = "place") -> DataFrame:
    """rows with their place in group by key, from 1; groups of any size."""
    keyed = rows.withColumn("_key", key).withColumn("_language", F.collate("_key", COLLATION))
    return placed(keyed, group, ["_language", "_key"], name=name, dropped=("_language", "_key"))


def activity_order(rows: DataFrame, group: str, place: str = "place", priority: str = "priority", name: str = "activity_place") -> DataFrame:
    """rows with their place when what a user wants investigated comes first and all else keeps its order."""
    ranked = rows.withColumn("_rank", F.when(F.col(priority) == "user-investigate", 0).otherwise(1))
    return placed(ranked, group, ["_rank", place], name=name).drop("_rank")
