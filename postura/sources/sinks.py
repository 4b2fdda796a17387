"""Reports as text: CSV sections and Markdown, put together by Spark in order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import csv_field, markdown


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of each row, fields quoted where needed."""
    return rows.select(F.concat_ws(",", *[csv_field(c) for c in columns]).alias("line"))


def document(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row (text): titled sections of (ord, line) rows; a report has few lines."""
    parts = None
    for k, (title, rows) in enumerate(sections):
        head = rows.sparkSession.createDataFrame([(k, -1, title)], "section int, ord long, line string")
        own = head.unionByName(rows.select(F.lit(k).alias("section"), F.col("ord").cast("long").alias("ord"), "line"))
        parts = own if parts is None else parts.unionByName(own)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))), lambda x: x["line"])
    return parts.agg(F.array_join(lines, "\n").alias("text"))


def watch_list(rows: DataFrame) -> DataFrame:
    """(ord, line): Markdown bullets of exposures (ord, ip, protocol, port, risk, reason)."""
    text = F.concat(F.lit("- **"), F.col("risk"), F.lit("** "), F.col("ip"), F.lit(" "), F.col("protocol"), F.lit("/"), F.col("port").cast("string"), F.lit(": "), markdown("reason"))
    return rows.select("ord", text.alias("line"))
