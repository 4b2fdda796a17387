"""From archives to the findings of their runs, as one chain of DataFrames.

members: (archive, name, content, error), as `scans.archive_members` gives
them; a member that can't be read is a row with an error and takes no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import folder_name
from ..operators.findings import open_ports
from ..storage import saved
from . import scans

#: Endings that make a folder outside rawscans a run.
SCAN_ENDINGS = (".xml", ".nmap", ".gnmap")


def extracted(spark: SparkSession, path: str, **limits) -> DataFrame:
    """members of all archives at a path, written to the shared folder once."""
    return saved(scans.archive_members(spark, path, **limits), "members")


def _folders(members: DataFrame) -> DataFrame:
    """(archive, run_path, folder, above, top, direct): the folders that hold each file, and whether it lies right in them."""
    parts = F.split("name", "/")
    each = F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("_k")
    rows = members.filter("error is null").select("archive", "name", parts.alias("_p")).filter(F.size("_p") > 1).select("archive", "name", "_p", each)
    return rows.select(
        "archive", "name", F.array_join(F.slice("_p", F.lit(1), F.col("_k")), "/").alias("run_path"), F.element_at("_p", F.col("_k")).alias("folder"),
        F.get("_p", F.col("_k") - 2).alias("above"), (F.col("_k") == F.size("_p") - 1).alias("direct"),
    )


def runs(members: DataFrame) -> DataFrame:
    """(archive, run_path, folder, timestamp, run_type, network): run folders, newest first in an archive; sort by archive, place.

    They are those right in a rawscans folder; an archive that has none gives
    the folders with a run's name that hold a scan file.  network: the first
    folder of the archive that holds rawscans.
    """
    rows = _folders(members).withColumn("n", folder_name("folder"))
    scan = F.lit(False)
    for end in SCAN_ENDINGS:
        scan = scan | F.col("name").endswith(end)
    named = rows.filter(F.col("n").isNotNull()).groupBy("archive", "run_path").agg(
        F.any_value("folder").alias("folder"), F.any_value("n").alias("n"), F.max(F.coalesce(F.col("above") == "rawscans", F.lit(False))).alias("_raw"), F.max(F.col("direct") & scan).alias("_scan"))
    known = named.groupBy("archive").agg(F.max("_raw").alias("_any"))
    network = F.split("name", "/")
    networks = members.filter("error is null").select("archive", network.alias("_p")).filter(F.get("_p", F.lit(1)) == "rawscans").filter(F.size("_p") > 2).groupBy("archive").agg(F.min(F.get("_p", F.lit(0))).alias("network"))
    kept = named.join(known, "archive").filter(F.when(F.col("_any"), F.col("_raw")).otherwise(F.col("_scan"))).join(networks, "archive", "left")
    return kept.select("archive", "run_path", "folder", "n.timestamp", "n.run_type", "network")


def _of_runs(members: DataFrame, found: DataFrame) -> DataFrame:
    """members that lie right in a run, with their file's name."""
    own = members.filter("error is null").select("archive", "name", "content", F.regexp_extract("name", "^(.*)/[^/]*$", 1).alias("run_path"), F.element_at(F.split("name", "/"), -1).alias("file"))
    return own.join(found.select("archive", "run_path"), ["archive", "run_path"])


def _label(file: Column) -> Column:
    hit = lambda p: file.startswith(p[:-1]) if p.endswith("*") else file == p
    return F.coalesce(*[F.when(hit(p), F.lit(k)) for k, p in scans.KEY_FILES])


def run_files(members: DataFrame, found: DataFrame) -> DataFrame:
    """(archive, run_path, label, files): key files of each run by label, in order of name."""
    rows = _of_runs(members, found).select("archive", "run_path", _label(F.col("file")).alias("label"), "file").filter("label is not null")
    return rows.groupBy("archive", "run_path", "label").agg(F.array_sort(F.collect_set("file")).alias("files"))


def ports_documents(members: DataFrame, found: DataFrame) -> DataFrame:
    """(archive, run_path, file, xml): the one report of each run: its first known ports file that is XML, else its first XML file."""
    rows = _of_runs(members, found)
    known = (_label(F.col("file")) == "ports") & F.lower("file").endswith(".xml")
    rows = rows.withColumn("_rank", F.when(known, 0).when(F.col("file").endswith(".xml"), 1)).filter(F.col("_rank").isNotNull())
    best = rows.groupBy("archive", "run_path").agg(F.min(F.struct("_rank", "file")).alias("b")).select("archive", "run_path", "b.file")
    return rows.join(best, ["archive", "run_path", "file"]).select("archive", "run_path", "file", F.col("content").cast("string").alias("xml"))


def run_findings(members: DataFrame, found: DataFrame) -> DataFrame:
    """(archive, run_path, report, ord, ip, hostname, protocol, port, state, service, product, version): open ports of each run."""
    docs = ports_documents(members, found).withColumn("_id", F.to_json(F.struct("archive", "run_path", "file")))
    rows = open_ports(scans.findings(docs.select(F.col("_id").alias("file"), "xml")))
    key = F.from_json("file", "archive string, run_path string, file string")
    return rows.withColumn("_k", key).select("_k.archive", "_k.run_path", F.col("_k.file").alias("report"), *[c for c in rows.columns if c != "file"])


def run_hosts(members: DataFrame, found: DataFrame, ports: DataFrame) -> DataFrame:
    """(archive, run_path, ip): addresses of each run's first host list, else of its open ports."""
    lists = _of_runs(members, found).filter("file = 'hosts_up.txt'")
    lines = lists.select("archive", "run_path", F.explode(F.split(F.col("content").cast("string"), r"\r\n|[\n\r]")).alias("ip")).select("archive", "run_path", F.trim("ip").alias("ip")).filter(r"ip rlike '^[0-9.]+$' and length(ip) - length(replace(ip, '.', '')) = 3")
    rest = ports.join(lists.select("archive", "run_path").distinct(), ["archive", "run_path"], "left_anti").select("archive", "run_path", "ip")
    return lines.unionByName(rest).distinct()


def ingest(spark: SparkSession, path: str, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, open ports, errors) of all archives at a path; errors: (archive, name, error) of archives and members that can't be read."""
    members = extracted(spark, path, **limits)
    found = saved(runs(members), "runs")
    return found, run_findings(members, found), members.filter("error is not null").select("archive", "name", "error")
