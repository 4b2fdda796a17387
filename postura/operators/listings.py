"""Lists and look-ups over registries: filters, orders, pages, picks of a few rows a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_network(rows: DataFrame, network: str | None, column: str = "network", every: bool = False) -> DataFrame:
    """Rows of a network, in any case; with every, those of "*" too; null: all."""
    if network is None:
        return rows
    own = F.lower(column) == network.lower()
    return rows.filter(own | (F.col(column) == "*") if every else own)


def with_text(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold a text in any of the columns, in any case; an empty query keeps all."""
    found = F.lit(not query.strip())
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(query.strip().lower()), F.lit(False))
    return rows.filter(found)


def networks(rows: DataFrame, column: str = "network") -> DataFrame:
    """Distinct networks but "*", ascending."""
    return rows.filter(F.col(column) != "*").select(F.lower(column).alias("network")).distinct().orderBy("network")


def rule_order(rules: DataFrame) -> DataFrame:
    """Rules for all networks first, then by network and port."""
    return rules.orderBy(F.col("network") != "*", "network", "port", "protocol")


def newest_first(rows: DataFrame, time: str, key: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of rows, newest first, those without a time last."""
    out = rows.orderBy(F.desc_nulls_last(time), key).offset(offset)
    return out if limit is None else out.limit(limit)


def first_of_each(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= n)


def default_run(runs: DataFrame, preferred: str) -> DataFrame:
    """One run: the newest of the preferred type, else the newest."""
    return runs.orderBy(F.coalesce(F.col("run_type") != preferred, F.lit(True)), F.desc_nulls_last("timestamp"), "run_uid").limit(1)


def default_pair(runs: DataFrame) -> DataFrame:
    """One row: the newest run and the newest other one."""
    two = first_of_each(newest_first(runs, "timestamp", "run_uid", limit=2).withColumn("_k", F.lit(1)), ["_k"], [F.desc_nulls_last("timestamp"), F.col("run_uid")], 2)  # two rows
    return two.groupBy("_k").agg(F.max(F.when(F.col("place") == 1, F.col("run_uid"))).alias("current_run"), F.max(F.when(F.col("place") == 2, F.col("run_uid"))).alias("baseline_run")).drop("_k")


def with_port_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """rows with the service name and action of their port; notes: dims.port_notes, or a table like it."""
    return rows.join(F.broadcast(notes), "port", "left")  # a few dozen ports


def shared_values(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with shared: values of both arrays, sorted."""
    return rows.withColumn("shared", F.array_sort(F.array_intersect(a, b)))


def label_set(rows: DataFrame, labels: str) -> DataFrame:
    """Distinct labels of an array column, ascending."""
    return rows.select(F.explode(labels).alias("label")).filter(F.col("label") != "").distinct().orderBy("label")


def priority_counts(rows: DataFrame) -> DataFrame:
    """(priority, n) of risky rows."""
    return rows.groupBy(F.col("risk").alias("priority")).agg(F.count("*").alias("n"))


def change_counts(hosts: DataFrame, opened: DataFrame, closed: DataFrame, levels: tuple[str, ...] = ("P0",)) -> DataFrame:
    """(part, n): the numbers of a summary of changes that are not 0."""
    h = hosts.groupBy(F.concat("change", F.lit("_hosts")).alias("part")).agg(F.count("*").alias("n"))
    o = opened.agg(F.count("*").alias("opened"), F.count_if(F.col("risk").isin(*levels)).alias("risky"))
    each = o.select(F.inline(F.array(F.struct(F.lit("ports_opened").alias("part"), F.col("opened").alias("n")), F.struct(F.lit("risky_exposures").alias("part"), F.col("risky").alias("n")))))
    return h.unionByName(each).unionByName(closed.agg(F.count("*").alias("n")).select(F.lit("ports_closed").alias("part"), "n")).filter("n > 0")


def network_of_path(path: Column) -> Column:
    """Network that a run folder's path tells: the nearest parent that is neither a run folder nor a known stage, without an extraction id; else unknown."""
    parts = F.split(path, r"[/\\]")
    parents = F.filter(F.reverse(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))), lambda p: ~p.isin("", "rawscans", "extracted", "data") & ~p.rlike(r"^\d{4}-\d{2}-\d{2}_\d{4}_.+$"))
    part = F.get(parents, F.lit(0))
    short = F.element_at(F.split(F.regexp_replace(part, "(?i)_[a-f0-9]{8}$", ""), "_"), 1)
    return F.coalesce(F.lower(F.when(part.rlike("(?i)_[a-f0-9]{8}$") & (short != ""), short).otherwise(part)), F.lit("unknown"))


def content_key(hashes: Column) -> Column:
    """Hash of a run's files: SHA-256 over their sorted SHA-256 values, joined by colons."""
    return F.sha2(F.array_join(F.array_sort(hashes), ":"), 256)


def register_runs(held: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (ord, run_uid, content_hash) whose content nobody has yet; the first of equal ones."""
    first = first_of_each(new, ["content_hash"], [F.col("ord")], 1).drop("place")
    return first.join(held.select("content_hash"), "content_hash", "left_anti").select(*new.columns)


def cache_stats(rows: DataFrame, now: Column) -> DataFrame:
    """One row: entries that are valid and that have expired."""
    return rows.agg(F.count_if(F.col("expires_at") >= now).alias("valid"), F.count_if(F.col("expires_at") < now).alias("expired"))
