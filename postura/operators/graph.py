"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def _star(edges: DataFrame) -> DataFrame:
    """Edges with m, the least neighbour of their a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least.hint("merge"), "a")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node with an edge to another; comp is its component's least node.

    Each step is a combinable minimum and an equi-join, written to the shared
    folder to cut the lineage, so a hub with very many edges is split like any
    skewed key; no table of nodes is sent to the driver.  The number of steps is logarithmic in the size of a component.
    Null ends and edges from a node to itself are left out.
    """
    edges = saved(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        large = _star(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _star(large)
        small = small.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).filter("a <> b")
        edges = saved(small.distinct(), "edges")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    pair = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("comp")), F.struct(F.col("b").alias("node"), F.col("b").alias("comp")))
    return edges.select(F.inline(pair)).distinct()
