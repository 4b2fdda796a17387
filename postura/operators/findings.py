"""Open-port findings: risk, scorecards and differences between two runs.

Findings have (run, ord, ip, hostname, protocol, port, state, service, ...);
ord is the place of a row in its source, and "first" always means least ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ip_order, level_rank
from .places import placed


def open_ports(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("state") == "open")


def normalised(findings: DataFrame) -> DataFrame:
    """Ports as integers, -1 where they are none."""
    return findings.withColumn("port", F.coalesce(F.col("port").try_cast("int"), F.lit(-1))).withColumn("ip", F.col("ip").cast("string")).withColumn("protocol", F.col("protocol").cast("string"))


def with_default_risk(rows: DataFrame, risks: DataFrame) -> DataFrame:
    """rows with risk by port; risks is a profile's table (dims.port_risk)."""
    return rows.join(F.broadcast(risks), "port", "left")  # a profile has a few dozen ports


def with_effective_risk(rows: DataFrame, risks: DataFrame, rules: DataFrame, network: Column) -> DataFrame:
    """risk after custom rules: the network's own rule, else the rule of "*", else the profile.

    A rule that is found ends the search even if it gives no level: whitelist,
    or override without one.  rules: (port, protocol, network, action,
    custom_risk), unique by its first three.
    """
    level = F.when(F.col("action") == "override", F.col("custom_risk"))
    rules = rules.select("port", "protocol", F.lower("network").alias("_net"), level.alias("_level"))
    own = rules.filter("_net <> '*'").select("port", "protocol", "_net", F.col("_level").alias("_own"), F.lit(True).alias("_has_own"))
    every = rules.filter("_net = '*'").select("port", "protocol", F.col("_level").alias("_all"), F.lit(True).alias("_has_all"))
    out = with_default_risk(rows, risks).withColumn("_net", F.lower(network))
    out = out.join(own, ["port", "protocol", "_net"], "left").join(every, ["port", "protocol"], "left")
    risk = F.when(F.col("_has_own"), F.col("_own")).when(F.col("_has_all"), F.col("_all")).otherwise(F.col("risk"))
    return out.withColumn("risk", risk).drop("_net", "_own", "_has_own", "_all", "_has_all")


def top_ports(findings: DataFrame, n: int = 25) -> DataFrame:
    """Ports by number of distinct hosts."""
    counts = findings.groupBy("protocol", "port", "service").agg(F.countDistinct("ip").alias("hosts"))
    return counts.orderBy(F.desc("hosts"), "port", "protocol", "service").limit(n)


def risk_groups(findings: DataFrame) -> DataFrame:
    """(protocol, port, risk, service, hosts_affected, hosts): service as first seen, hosts in order of appearance."""
    hosts = findings.groupBy("protocol", "port", "risk", "ip").agg(F.min("ord").alias("ord"), F.min_by("service", "ord").alias("service"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("ord", "ip"))), lambda x: x["ip"])
    return hosts.groupBy("protocol", "port", "risk").agg(F.min_by("service", "ord").alias("service"), F.count("*").alias("hosts_affected"), named.alias("hosts"))


def risk_group_counts(findings: DataFrame) -> DataFrame:
    """(protocol, port, risk, service, hosts_affected): risk groups of any size, their hosts counted but not listed."""
    hosts = findings.groupBy("protocol", "port", "risk", "ip").agg(F.min("ord").alias("ord"), F.min_by("service", "ord").alias("service"))
    return hosts.groupBy("protocol", "port", "risk").agg(F.min_by("service", "ord").alias("service"), F.count("*").alias("hosts_affected"), F.min_by("ip", "ord").alias("first_host"))


def risk_group_hosts(findings: DataFrame) -> DataFrame:
    """(protocol, port, risk, ip, ord): a row a host of a risk group, ord its first appearance; for groups of any size."""
    return findings.groupBy("protocol", "port", "risk", "ip").agg(F.min("ord").alias("ord"))


def device_counts(findings: DataFrame) -> DataFrame:
    """(ip, hostname, n_ports): devices with any number of ports, counted but not listed."""
    name = F.min_by("hostname", F.when(F.col("hostname") != "", F.col("ord")))
    return findings.groupBy("ip").agg(F.coalesce(name, F.lit("")).alias("hostname"), F.count("*").alias("n_ports"))


def device_ports(findings: DataFrame) -> DataFrame:
    """(ip, protocol, port, n): a row a port of a device; for devices with any number of them."""
    return findings.groupBy("ip", "protocol", "port").agg(F.count("*").alias("n"))


def risk_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(level_rank("risk"), F.desc("hosts_affected"), "port", "protocol")


def risk_buckets(groups: DataFrame) -> DataFrame:
    """(bucket, n_groups, n_hosts) by level, "unclassified" for the rest."""
    return groups.groupBy(F.coalesce("risk", F.lit("unclassified")).alias("bucket")).agg(F.count("*").alias("n_groups"), F.sum("hosts_affected").alias("n_hosts"))


def scorecard_counts(findings: DataFrame, hosts_up: int | None = None) -> DataFrame:
    """One row: hosts, services, open ports, risk groups at P0 or P1, hosts at P0."""
    at = F.when(F.col("risk").isin("P0", "P1"), F.struct("protocol", "port"))
    counts = findings.agg(
        F.countDistinct("ip").alias("total_hosts"), F.countDistinct(F.when(F.col("service") != "", F.col("service"))).alias("services"),
        F.count("*").alias("open_ports"), F.countDistinct(at).alias("risk_ports"), F.countDistinct(F.when(F.col("risk") == "P0", F.col("ip"))).alias("p0_hosts"),
    )
    return counts.withColumn("total_hosts", F.lit(hosts_up).cast("long")) if hosts_up else counts


def top_actions(findings: DataFrame, n: int = 3, levels: tuple[str, ...] = ("P0",)) -> DataFrame:
    """Exposures to act on first."""
    rows = findings.filter(F.col("risk").isin(*levels)).groupBy("protocol", "port").agg(F.countDistinct("ip").alias("hosts"))
    return rows.orderBy(F.desc("hosts"), "port", "protocol").limit(n)


def device_summary(findings: DataFrame) -> DataFrame:
    """(ip, hostname, n_ports, ports): first hostname that is not empty, ports ascending."""
    name = F.min_by("hostname", F.when(F.col("hostname") != "", F.col("ord")))
    return findings.groupBy("ip").agg(F.coalesce(name, F.lit("")).alias("hostname"), F.count("*").alias("n_ports"), F.sort_array(F.collect_set(F.struct("port", "protocol"))).alias("ports"))


def hosts_delta(base: DataFrame, current: DataFrame, key: str = "ip") -> DataFrame:
    """(change, key): hosts in one run only."""
    a, b = base.select(key).distinct(), current.select(key).distinct()
    new = b.join(a, key, "left_anti").select(F.lit("new").alias("change"), key)
    return new.unionByName(a.join(b, key, "left_anti").select(F.lit("removed").alias("change"), key))


PORT_KEY = ["ip", "protocol", "port"]


def ports_opened(base: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of current without their port in base; duplicate rows stay."""
    return current.join(base.select(PORT_KEY), PORT_KEY, "left_anti")


def ports_closed(base: DataFrame, current: DataFrame) -> DataFrame:
    return ports_opened(current, base)


def risky_rows(rows: DataFrame, levels: tuple[str, ...] = ("P0",)) -> DataFrame:
    """Exposures at the levels with a reason, the worst first."""
    found = rows.filter(F.col("risk").isin(*levels))
    reason = F.concat(F.col("risk"), F.lit(" exposure: "), F.concat_ws("/", "protocol", F.col("port").cast("string")), F.when(F.col("service") != "", F.concat(F.lit(" "), F.col("service"))).otherwise(""))
    return found.withColumn("reason", reason).orderBy(level_rank("risk"), "ip", "port", "ord")


def risk_flags(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows with a level as (priority, reason, place and the finding's columns): the reason is the port's note with service and product.

    notes: (port, note).  place: order by level, address and port.
    """
    told = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f" | {c}="), F.trim(c))).otherwise("")
    found = rows.filter(F.col("risk").isNotNull()).join(F.broadcast(notes), "port", "left")  # a row a known port
    reason = F.concat(F.coalesce("note", F.lit("Flagged port")), told("service"), told("product"))
    out = found.select(F.col("risk").alias("priority"), reason.alias("reason"), "ip", "protocol", "port", "service", "product", "version", "ord", F.lit(0).alias("_one"))
    return placed(out.withColumn("_level", level_rank("priority")), "_one", ["_level", "ip", "port", "ord"]).drop("_one", "_level")


def recommended(groups: DataFrame, notes: DataFrame, n: int = 3) -> DataFrame:
    """(place, action): what to do first, at most n: for the first groups at P0, then at P1; a single line if there are none.

    groups: as risk_group_counts; notes: (port, action).
    """
    worst = groups.filter(F.col("risk").isin("P0", "P1")).orderBy("risk", F.desc("hosts_affected"), "port", "protocol").limit(n)
    port = F.col("port").cast("string")
    hosts = F.concat(F.col("hosts_affected").cast("string"), F.lit(" hosts"))
    where = F.when(F.col("hosts_affected") == 1, F.col("first_host")).otherwise(hosts)
    p0 = F.coalesce(F.concat(F.col("action"), F.lit(" ("), port, F.lit("/"), F.col("protocol"), F.lit(" on "), where, F.lit(")")), F.concat(F.lit("Block port "), port, F.lit("/"), F.col("protocol"), F.lit(" at perimeter ("), hosts, F.lit(")")))
    p1 = F.concat(F.lit("Review and restrict "), F.coalesce(F.nullif("service", F.lit("")), F.concat(F.lit("port "), port)), F.lit(" access ("), hosts, F.lit(")"))
    rows = worst.join(F.broadcast(notes.select("port", "action")), "port", "left")
    order = Window.orderBy("risk", F.desc("hosts_affected"), "port", "protocol")  # n rows at most
    out = rows.select(F.row_number().over(order).alias("place"), F.when(F.col("risk") == "P0", p0).otherwise(p1).alias("action"))
    calm = groups.sparkSession.createDataFrame([(1, "No critical exposures detected - continue monitoring")], "place int, action string")
    return out.unionByName(calm.join(out.limit(1).select(F.lit(1).alias("place")), "place", "left_anti"))


def by_address(rows: DataFrame, ip: str = "ip") -> DataFrame:
    """Numeric order of addresses, others last."""
    return rows.orderBy(ip_order(ip), ip)


def diff_score(opened: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row: score 0 to 100 and its band, from opened ports (with risk) and the hosts' delta."""
    p = opened.agg(F.count_if(F.col("risk") == "P0").alias("p0"), F.count_if(F.col("risk") == "P1").alias("p1"), F.count("*").alias("opened"))
    h = hosts.agg(F.count_if(F.col("change") == "new").alias("new_hosts"))
    one = F.lit(1).alias("_k")  # one row each
    rows = p.select("*", one).join(h.select("*", one), "_k").drop("_k")
    score = 100 - 15 * F.col("p0") - 5 * F.col("p1") - 3 * F.col("new_hosts") - F.least("opened", F.lit(10))
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))
    band = F.when(F.col("score") >= 90, "Excellent").when(F.col("score") >= 70, "Good").when(F.col("score") >= 50, "Fair").when(F.col("score") >= 30, "Poor").otherwise("Critical")
    return rows.withColumn("band", band)


def same_minute_guard(runs: DataFrame) -> DataFrame:
    """Pairs of runs of one network that began in one minute: not to be compared."""
    keyed = runs.withColumn("_m", F.date_trunc("minute", "timestamp")).withColumn("_net", F.lower("network"))
    return keyed.groupBy("_net", "_m").agg(F.count("*").alias("n_runs"), F.min("run_uid").alias("first_run"), F.max("run_uid").alias("last_run")).filter("n_runs > 1").select(F.col("_net").alias("network"), "n_runs", "first_run", "last_run")


def newest_pair(runs: DataFrame) -> DataFrame:
    """Per network and type the newest run and the one before."""
    w = Window.partitionBy("network", "run_type").orderBy(F.desc_nulls_last("timestamp"), F.desc("run_uid"))
    rows = runs.withColumn("_n", F.row_number().over(w)).withColumn("previous_run", F.lead("run_uid").over(w))
    return rows.filter("_n = 1").select("network", "run_type", "run_uid", "previous_run")
