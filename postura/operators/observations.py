"""Observations over time: freshness, coverage, pairs, periods and registries.

observations: (registry_id, site, observed_at, partial, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def with_freshness(rows: DataFrame, evaluated_at: Column) -> DataFrame:
    """rows with freshness: partial overrides; fresh up to 30 days, aging up to 37, both inclusive; else stale."""
    at = F.col("observed_at")
    state = F.when(F.col("partial"), "partial").when(evaluated_at <= at + F.expr(f"INTERVAL {dims.FRESH_DAYS} DAYS"), "fresh")
    return rows.withColumn("freshness", state.when(evaluated_at <= at + F.expr(f"INTERVAL {dims.AGING_DAYS} DAYS"), "aging").otherwise("stale"))


def coverage(rows: DataFrame, present: str = "present") -> DataFrame:
    """rows with score, missing and status; present: the names of the sources that were parsed."""
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).cast("decimal(3,2)").alias("w")) for k, w in dims.COVERAGE_WEIGHTS.items()])
    found = F.filter(weights, lambda x: F.array_contains(F.col(present), x["k"]))
    score = F.aggregate(found, F.lit("0").cast("decimal(5,2)"), lambda a, x: (a + x["w"]).cast("decimal(5,2)")).cast("decimal(3,2)")
    missing = F.array_except(F.array(*[F.lit(k) for k in dims.COVERAGE_WEIGHTS]), F.col(present))
    rows = rows.withColumn("score", score).withColumn("missing", missing)
    status = F.when(F.col("score") < F.lit("0.35").cast("decimal(3,2)"), "minimal").when((F.size("missing") == 0) & (F.col("score") >= F.lit("0.85").cast("decimal(3,2)")), "complete")
    return rows.withColumn("status", status.otherwise("partial"))


def capture_coverage(rows: DataFrame) -> DataFrame:
    """rows (vantage, truncated, ignored_packets, has_times) with a score in 0 to 1."""
    base = F.lit(dims.VANTAGE_SCORES["unknown"]).cast("decimal(4,2)")
    for k, v in dims.VANTAGE_SCORES.items():
        base = F.when(F.col("vantage") == k, F.lit(v).cast("decimal(4,2)")).otherwise(base)
    less = lambda c, x: F.when(c, F.lit(x).cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)"))
    score = base - less(F.col("truncated"), "0.15") - less(F.col("ignored_packets") > 0, "0.05") - less(~F.col("has_times"), "0.10")
    return rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(1), score)).cast("decimal(3,2)"))


def adjacent_pairs(rows: DataFrame) -> DataFrame:
    """Each observation of a site with the one before: (site, registry_id, observed_at, previous_id, previous_at, days)."""
    w = Window.partitionBy(F.lower("site")).orderBy("observed_at", "registry_id")
    before = rows.withColumn("_b", F.lag(F.struct("registry_id", "observed_at")).over(w)).filter(F.col("_b").isNotNull())
    days = F.floor((F.unix_seconds(F.to_timestamp("observed_at")) - F.unix_seconds(F.to_timestamp("_b.observed_at"))) / 86400)
    return before.select("site", "registry_id", "observed_at", F.col("_b.registry_id").alias("previous_id"), F.col("_b.observed_at").alias("previous_at"), days.cast("long").alias("days"))


def latest_valid_pair(rows: DataFrame, valid: Column | None = None) -> DataFrame:
    """Per site the newest observation and its newest strictly earlier valid one, if it has any.

    One window: within a site, ordered by time, the last valid row of earlier
    times is carried along, so no pair is formed that isn't the answer.
    """
    ok = valid if valid is not None else F.lit(True)
    site = F.lower("site")
    # rows of one time are one step: the best valid row of each time, then the last earlier step
    steps = rows.filter(F.col("observed_at").isNotNull()).groupBy(site.alias("_site"), "observed_at").agg(
        F.min(F.struct("registry_id", "site")).alias("cur"), F.min(F.when(ok, F.col("registry_id"))).alias("good"),
    )
    w = Window.partitionBy("_site").orderBy("observed_at")
    prev = F.last(F.when(F.col("good").isNotNull(), F.struct(F.col("good").alias("id"), F.col("observed_at").alias("at"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    newest = steps.withColumn("prev", prev).withColumn("n", F.row_number().over(Window.partitionBy("_site").orderBy(F.desc("observed_at")))).filter((F.col("n") == 1) & F.col("prev").isNotNull())
    return newest.select(F.col("cur.site").alias("site"), F.col("cur.registry_id").alias("current_id"), F.col("observed_at").alias("current_at"), F.col("prev.id").alias("baseline_id"), F.col("prev.at").alias("baseline_at"))


def in_period(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Closed range."""
    return rows.filter(F.col("observed_at").between(start, end))


def day_range(first: str, last: str) -> tuple[Column, Column]:
    """Start of the first day and last millisecond of the last."""
    return F.to_timestamp(F.lit(f"{first} 00:00:00")), F.to_timestamp(F.lit(f"{last} 23:59:59.999"))


def site_options(rows: DataFrame) -> DataFrame:
    """(site, n, last_seen, last_id)."""
    return rows.groupBy("site").agg(F.count("*").alias("n"), F.max("observed_at").alias("last_seen"), F.max_by("registry_id", F.struct("observed_at", "registry_id")).alias("last_id"))


def registry_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.countDistinct("site").alias("sites"), F.count_if("partial").alias("partials"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def newest_site(rows: DataFrame) -> DataFrame:
    """Rows of the site that has the newest observation (least id of equals)."""
    top = rows.orderBy(F.desc("observed_at"), "registry_id").limit(1).select(F.lower("site").alias("_s"))
    return rows.join(top, F.lower(rows["site"]) == top["_s"], "left_semi")


def first_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedupe_ladder(new: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of new to append: first writer wins by content hash, then source run, then (no run on both) observation id.

    new: (ord, content_hash, source_run_uid, observation_id); held: the same without ord.
    """
    rows = first_by_key(new, ["content_hash"], ["ord"]).join(held.select("content_hash"), "content_hash", "left_anti")
    with_run = first_by_key(rows.filter(F.col("source_run_uid").isNotNull()), ["source_run_uid"], ["ord"]).join(held.select("source_run_uid").filter(F.col("source_run_uid").isNotNull()), "source_run_uid", "left_anti")
    no_run = first_by_key(rows.filter(F.col("source_run_uid").isNull()), ["observation_id"], ["ord"]).join(held.filter(F.col("source_run_uid").isNull()).select("observation_id"), "observation_id", "left_anti")
    return with_run.unionByName(no_run).select(*new.columns)


def validated_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (base, current: struct<site, id, at, ambiguous>) with error_code, null where they may be compared."""
    b, c = F.col("base"), F.col("current")
    code = F.when(F.lower(b["site"]) != F.lower(c["site"]), "different_sites").when(b["id"] == c["id"], "identical_observations")
    code = code.when(b["at"].isNull() | c["at"].isNull(), "missing_timestamp").when(c["at"] < b["at"], "reversed_chronology").when(c["at"] == b["at"], "ambiguous_comparison")
    return pairs.withColumn("error_code", code)


def weekly_support(rows: DataFrame, start: Column, end: Column, n_pairs: Column) -> DataFrame:
    """One row: whether a period may be called a week."""
    got = rows.agg(F.min("observed_at").alias("first"), F.max("observed_at").alias("last"))
    days = lambda a, b: (F.unix_seconds(F.to_timestamp(b)) - F.unix_seconds(F.to_timestamp(a))) / 86400.0
    ok = days(start, end).between(6, 8) & (days(start, F.col("first")) <= 1) & (days(F.col("last"), end) <= 1) & (days(F.col("first"), F.col("last")) >= 5) & (n_pairs >= 1)
    return got.select("first", "last", F.coalesce(ok, F.lit(False)).alias("weekly"))
