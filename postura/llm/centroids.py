"""Centroid clustering of vectors with a vantage-point tree over the centroids.

Vectors become whole numbers, so every distance, mean and tie is exact.  A
round rebuilds the tree of its centroids on the driver (k points, k is a
parameter), broadcasts it, and each task searches it for the vectors of its
own rows: best first by lower bound, until no open branch can hold a centroid
as near as the best one.  The bound is inclusive, so equally near centroids are
all seen and the smaller number wins.  Only sums by cluster (k rows a task)
leave a task; the sums by cluster and component, k times the components, come
to the driver and make the next centroids.

Defined results: a vector that is null, has another number of components, or a
null or non-finite one is left out; components beyond 2**27 in size after
scaling are taken as that bound, so that a squared distance fits a long; equal
vectors go the same way, each row by itself; of rows with the same id the one
with the smaller components comes first as a starting centroid, and rows
without an id start nothing; fewer rows than k give fewer centroids; sums
beyond a long are given as the greatest long; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved, table, tidy

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
BOUND = 1 << 27
#: Centroids in a leaf of the tree.
LEAF = 2
LONG_MAX = (1 << 63) - 1
#: Vectors searched at once in a task.
BLOCK = 4096


@dataclass
class Node:
    """A branch: a vantage point and, of each child, the nearest and farthest member as seen from it; or a leaf: some centroids."""

    points: list[int]
    children: list[tuple[float, float, int]]


def tree_of(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """Vantage-point tree over the rows of centroids; node 0 is the root.

    The point that spreads the others most (largest sum of squared deviations
    of its distances) becomes the vantage point; the median distance parts them.
    """
    nodes: list[Node] = []

    def build(members: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(members, []))
        if len(members) <= leaf:
            return at
        apart = np.sqrt(((centroids[members][:, None, :] - centroids[members][None, :, :]) ** 2).sum(-1).astype(float))
        best = int(apart.var(axis=1).argmax())
        rest = sorted((d, m) for i, (d, m) in enumerate(zip(apart[best], members)) if i != best)
        half = (len(rest) + 1) // 2
        nodes[at] = Node([members[best]], [(part[0][0], part[-1][0], build([m for _, m in part])) for part in (rest[:half], rest[half:]) if part])
        return at

    if len(centroids):
        build(list(range(len(centroids))))
    return nodes


def nearest(vectors: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each vector.

    Branch and bound, best first: each vector opens its own open node of least
    bound; vectors that open the same node do so together.  Bounds are
    distances in floating point with an allowance for rounding; what decides is
    the squared distance in whole numbers.
    """
    n = len(vectors)
    number, distance = np.full(n, len(centroids), np.int64), np.full(n, LONG_MAX, np.int64)
    bound = np.full((n, len(nodes)), np.inf)
    bound[:, 0] = 0.0
    live = np.arange(n)
    while len(live):
        chosen = bound[live].argmin(axis=1)
        # inclusive: a branch whose bound equals the best distance may hold a tie
        reach = bound[live, chosen] * (1 - 1e-9) - 1e-6 <= np.sqrt(distance[live].astype(float))
        live, chosen = live[reach], chosen[reach]
        for at in np.unique(chosen):
            rows = live[chosen == at]
            own = vectors[rows]
            for c in nodes[at].points:
                gap = own - centroids[c]
                d = np.einsum("ij,ij->i", gap, gap)
                better = (d < distance[rows]) | ((d == distance[rows]) & (c < number[rows]))
                distance[rows[better]], number[rows[better]] = d[better], c
            if nodes[at].children:  # one point only, d is its distance
                seen = np.sqrt(d.astype(float))
                for near, far, child in nodes[at].children:
                    bound[rows, child] = np.maximum(np.maximum(near - seen, seen - far), bound[rows, at])
            bound[rows, at] = np.inf
    return number, distance


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): kept vectors as arrays of whole numbers."""
    x = F.col(vector_col).cast("array<double>")
    kept = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(F.greatest(F.lit(-4.0 * BOUND), F.least(F.lit(4.0 * BOUND), c * scale))))).cast("int")
    return rows.filter(kept).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("v"))


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the least hash, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.filter(F.col("vec_id").isNotNull()).select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def _matrix(batch: pa.RecordBatch, first: int, size: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v")).slice(first, size)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(size, -1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for first in range(0, batch.num_rows, BLOCK):
        size = min(BLOCK, batch.num_rows - first)
        yield first, size, _matrix(batch, first, size)


def means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floored means of what is nearest to each; one without a vector stays."""
    held = vectors.sparkSession.sparkContext.broadcast((centroids, tree_of(centroids)))
    k, dims = centroids.shape

    @tidy
    def summed(batches):
        points, nodes = held.value
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, _, own in _blocks(batch):
                number, _ = nearest(own, points, nodes)
                counts += np.bincount(number, minlength=k)
                for c in np.unique(number):
                    sums[c] += own[number == c].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": np.repeat(used, dims).astype(np.int32), "place": np.tile(np.arange(dims, dtype=np.int32), len(used)),
            "total": sums[used].ravel(), "n": np.repeat(counts[used], dims),
        })

    parts = vectors.select("v").mapInArrow(summed, "cluster int, place int, total long, n long")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    held.destroy()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    held = vectors.sparkSession.sparkContext.broadcast((centroids, tree_of(centroids)))

    @tidy
    def search(batches):
        points, nodes = held.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for first, size, own in _blocks(batch):
                number, distance = nearest(own, points, nodes)
                yield pa.RecordBatch.from_arrays([ids.slice(first, size), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(search, f"vec_id {kind}, cluster int, distance long")


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def clustered(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = rows.sparkSession
    with bounded_batches(spark):
        vectors = saved(whole_vectors(rows, id_col, vector_col, dims, scale), "vectors")
        centroids = seeds(vectors, k, seed)
        shape = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        if not len(centroids):  # no row with an id: nothing to start from
            return spark.createDataFrame([], shape).withColumnRenamed("vec_id", id_col)
        for _ in range(rounds):
            centroids = means(vectors, centroids)
        placed = saved(assigned(vectors, centroids), "placed")
    names = [(i, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    by_cluster = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    # one row a centroid, so k at most
    totals = by_cluster.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster").select(
        "cluster", _long(F.col("part")).alias("cluster_inertia"), _long(F.sum("part").over(Window.partitionBy(F.lit(0)))).alias("inertia"), "centroid_sha256"
    )
    return placed.join(F.broadcast(totals), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of every embedding after three rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL, a block of common table expressions a round."""
    out = [f"""with kept as (
  select vec_id, list_transform(embedding, lambda x: greatest(-{BOUND}, least({BOUND}, floor(greatest(-4.0 * {BOUND}, least(4.0 * {BOUND}, x::double * {scale})))::bigint))) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
rows as (select row_number() over () as rid, vec_id, v from kept),
c0 as (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as cluster, v as c from rows where vec_id is not null qualify cluster < {k}),
near0 as (select rid, arg_min(cluster, d * {k} + cluster) as cluster, min(d) as d from (
  select rid, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::hugeint as d from rows, c0) group by rid)"""]
    for r in range(1, rounds + 1):
        out.append(f"""sums{r} as (
  select cluster, list(m order by place) as c from (
    select cluster, place, ((s - ((s % n) + n) % n) // n)::bigint as m from (
      select cluster, place, sum(x)::hugeint as s, count(*)::hugeint as n from (
        select cluster, unnest(v) as x, unnest(range(1, {dims} + 1)) as place from near{r - 1} join rows using (rid)) group by all)) group by cluster),
c{r} as materialized (select cluster, coalesce(s.c, o.c) as c from c{r - 1} o left join sums{r} s using (cluster)),
near{r} as materialized (select rid, arg_min(cluster, d * {k} + cluster) as cluster, min(d) as d from (
  select rid, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::hugeint as d from rows, c{r}) group by rid)""")
    return ",\n".join(out) + f"""
select vec_id, n.cluster::int as cluster, d::bigint as distance, (sum(d) over (partition by n.cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from near{rounds} n join rows using (rid) join c{rounds} k on k.cluster = n.cluster"""


OP13_SQL = _sql()
