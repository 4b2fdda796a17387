"""Places and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved


def placed(rows: DataFrame, group: str, order: list[str], value: Column | None = None, name: str = "place", dropped: tuple[str, ...] = ()) -> DataFrame:
    """rows (without the columns dropped) with the running sum of value within group, up to and with each row; value is 1 if not given, so the place.

    Rows are range-dealt by group and order, so a group of any size is spread
    over parts; a window adds up within the rows of one group in one part, and
    a table of one row a part carries on the groups that go on from part to
    part.  Rows without a group are one group; nulls come first in order, and
    rows that tie follow each other anyhow.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_value", (F.lit(1) if value is None else value).cast("long")).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = saved(dealt.withColumn("_row", F.monotonically_increasing_id()).drop(*dropped), name).withColumn("_part", F.shiftright("_row", 33))
    ends = dealt.groupBy("_part").agg(F.min_by(group, "_row").alias("first"), F.max_by(group, "_row").alias("last"))
    # sums of the last group of each part: a row a part
    last = F.broadcast(ends.select("_part", F.col("last").alias("_last")))
    tails = dealt.join(last, "_part").filter(F.col(group).eqNullSafe(F.col("_last"))).groupBy("_part").agg(F.sum("_value").alias("total"))
    carried, held = [], (None, 0)
    for r in sorted(ends.join(tails, "_part").collect(), key=lambda r: r["_part"]):
        before = held[1] if r["first"] == held[0] else 0
        if before:
            carried.append((r["_part"], r["first"], before))
        held = (r["last"], r["total"] + (before if r["first"] == r["last"] else 0))
    local = F.sum("_value").over(Window.partitionBy("_part", group).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn(name, local)
    if carried:
        kind = rows.schema[group].dataType.simpleString()
        out = out.join(F.broadcast(spark.createDataFrame(carried, f"_part long, _group {kind}, _before long")), "_part", "left")
        goes_on = F.col("_before").isNotNull() & F.col(group).eqNullSafe(F.col("_group"))
        out = out.withColumn(name, F.col(name) + F.when(goes_on, F.col("_before")).otherwise(0))
    return out.select(*[c for c in rows.columns if c not in dropped], name)
