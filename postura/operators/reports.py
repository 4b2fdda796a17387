"""Reports of a difference between two runs: CSV sections and Markdown, a row a line.

A line has its section and its place there; (section, place) is the order of
the document, so a report of any length is written by a sorted write and never
put together in one task.  Nulls are empty texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import csv_field, markdown
from .places import placed

#: Sections of the CSV document: title, header, fields, line for nothing.
HOST_FIELDS = (("IP Address", "ip"), ("Hostname", "hostname"))
PORT_FIELDS = (("IP Address", "ip"), ("Port", "port"), ("Protocol", "protocol"), ("Service", "service"))
RISK_FIELDS = (*PORT_FIELDS, ("Risk Level", "risk"))
CSV_SECTIONS = (
    ("# NEW HOSTS", "new_hosts", HOST_FIELDS, "No new hosts detected"), ("# REMOVED HOSTS", "removed_hosts", HOST_FIELDS, "No hosts removed"), ("# PORTS OPENED", "opened", RISK_FIELDS, "No new ports opened"),
    ("# PORTS CLOSED", "closed", PORT_FIELDS, "No ports closed"), ("# RISKY EXPOSURES (P0/P1)", "risky", RISK_FIELDS, None),
)
WATCH_FIELDS, NO_EXPOSURES = (*RISK_FIELDS, ("Recommended Action", "action")), "No risky exposures detected"
#: What stands for an empty field.
INSTEAD = {"hostname": "N/A", "service": "unknown", "risk": "N/A"}
#: Rows of a Markdown table that are shown.
TABLE_ROWS = 200
NAMES = ("new_hosts", "removed_hosts", "opened", "closed", "risky")


def _value(name: str) -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.when(text == "", INSTEAD[name]).otherwise(text) if name in INSTEAD else text


def _lines(rows: DataFrame, line: Column, section: int, first: int) -> DataFrame:
    """Rows as lines in the order of ord, places counting on from first."""
    numbered = placed(rows.select(F.lit(0).alias("_one"), "ord", line.alias("line")), "_one", ["ord", "line"])
    return numbered.select(F.lit(section).alias("section"), (F.col("place") + first).alias("place"), "line")


def _fixed(rows: DataFrame, section: int, lines: list[tuple[int, str | Column]]) -> DataFrame:
    """Lines that are always there; rows: one row that the columns read."""
    each = F.array(*[F.struct(F.lit(p).cast("long").alias("place"), (F.lit(x) if isinstance(x, str) else x).alias("line")) for p, x in lines])
    return rows.select(F.lit(section).alias("section"), F.inline(each))


def _counts(parts: dict[str, DataFrame], spark) -> DataFrame:
    """One row with the number of rows of each part."""
    one = lambda name: parts[name].agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    return reduce(lambda a, b: a.join(b, "_k"), map(one, NAMES)).drop("_k")


def diff_csv(parts: dict[str, DataFrame], network: str, base_at: str, current_at: str) -> DataFrame:
    """(section, place, line) of the CSV document of a difference.

    parts: new_hosts, removed_hosts (ord, ip, hostname), opened, closed, risky
    (ord, ip, port, protocol, service, risk).
    """
    counts = _counts(parts, next(iter(parts.values())).sparkSession)
    row = lambda name, value: F.concat(F.lit(f"{name},"), csv_field(F.lit(value) if isinstance(value, str) else value.cast("string")))
    out = [_fixed(counts, 0, [(0, "# SUMMARY"), (1, "Metric,Value"), (2, row("Network", network)), (3, row("Baseline Scan", base_at)), (4, row("Current Scan", current_at)), (5, row("New Hosts", F.col("new_hosts"))), (6, row("Removed Hosts", F.col("removed_hosts"))),
                               (7, row("Ports Opened", F.col("opened"))), (8, row("Ports Closed", F.col("closed"))), (9, row("Risky Exposures", F.col("risky")))])]
    for k, (title, name, fields, nothing) in enumerate(CSV_SECTIONS, 1):
        head = ",".join(h for h, _ in fields)
        some, none = counts.filter(F.col(name) > 0), counts.filter(F.col(name) == 0)
        out += [_fixed(some, k, [(-1, ""), (0, title), (1, head)]), _lines(parts[name], F.concat_ws(",", *[csv_field(_value(c)) for _, c in fields]), k, 1)]
        if nothing:
            out.append(_fixed(none, k, [(-1, ""), (0, title), (1, nothing)]))
    return reduce(DataFrame.unionByName, out)


def watch_csv(risky: DataFrame) -> DataFrame:
    """(section, place, line): exposures (ord, ip, port, protocol, service, risk) with what to do about each."""
    rows = risky.withColumn("action", F.lit("Review and remediate"))
    count = risky.agg(F.count("*").alias("n"))
    head = F.when(F.col("n") > 0, ",".join(h for h, _ in WATCH_FIELDS)).otherwise(NO_EXPOSURES)
    return _fixed(count, 0, [(0, head)]).unionByName(_lines(rows, F.concat_ws(",", *[csv_field(_value(c)) for _, c in WATCH_FIELDS]), 0, 0))


def _table(rows: DataFrame, name: str, columns: tuple[str, ...], section: int, title: str, counts: DataFrame) -> list[DataFrame]:
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    some, none = counts.filter(F.col(name) > 0), counts.filter(F.col(name) == 0)
    bar = "|" + "---|" * len(columns)
    return [
        _fixed(some, section, [(0, f"## {title}"), (1, "| " + " | ".join(columns) + " |"), (2, bar)]), _lines(rows, line, section, 2).filter(F.col("place") <= 2 + TABLE_ROWS),
        _fixed(none, section, [(0, f"## {title}"), (1, "_(none)_")]), _fixed(counts, section, [(1 << 60, "")]),
    ]


def change_report(parts: dict[str, DataFrame], network: str, base_run: str, current_run: str) -> DataFrame:
    """(section, place, line) of a difference in Markdown; tables show the first TABLE_ROWS rows, counts all."""
    counts = _counts(parts, next(iter(parts.values())).sparkSession)
    told = lambda label, name: F.concat(F.lit(f"- {label}: **"), F.col(name).cast("string"), F.lit("**"))
    out = [
        _fixed(counts, 0, [(0, f"# CHANGES — {network}"), (1, ""), (2, f"**Run A (baseline):** `{base_run}`"), (3, f"**Run B (new):** `{current_run}`"), (4, "")]),
        _fixed(counts, 1, [(0, "## Summary"), (1, told("New hosts", "new_hosts")), (2, told("Removed hosts", "removed_hosts")), (3, told("Ports opened (new exposures)", "opened")), (4, told("Ports closed", "closed")), (5, told("New risky exposures flagged", "risky")), (6, "")]),
    ]
    for k, (title, name) in enumerate((("New hosts", "new_hosts"), ("Removed hosts", "removed_hosts")), 2):
        out += [_fixed(counts, k, [(0, f"## {title}"), (1 << 60, "")]), _lines(parts[name], F.concat(F.lit("- "), markdown("ip")), k, 0), _fixed(counts.filter(F.col(name) == 0), k, [(1, "- (none)")])]
    out += _table(parts["opened"], "opened", ("ip", "port", "protocol", "service"), 4, "Ports opened", counts) + _table(parts["closed"], "closed", ("ip", "port", "protocol", "service"), 5, "Ports closed", counts)
    out += _table(parts["risky"], "risky", ("risk", "ip", "port", "protocol", "service"), 6, "New risky exposures (P0/P1/P2)", counts)
    return reduce(DataFrame.unionByName, out)
