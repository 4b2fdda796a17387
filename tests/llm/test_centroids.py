import random
from hashlib import sha256

import numpy as np
import pytest

from postura.llm import centroids as C

SHAPE = "vec_id long, embedding array<double>, cluster string, v string"


def brute(rows, k, rounds, dims, scale):
    """The stated result, one vector at a time."""
    kept = [(i, [max(-C.BOUND, min(C.BOUND, int(np.floor(x * scale)))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    points = [v for _, v in sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda: [min((far(v, c), n) for n, c in enumerate(points)) for _, v in kept]
    for _ in range(rounds):
        at = place()
        for n in range(len(points)):
            if own := [v for (_, v), (_, m) in zip(kept, at) if m == n]:
                points[n] = [sum(x) // len(own) for x in zip(*own)]
    at = place()
    by = {n: sum(d for d, m in at if m == n) for n in range(len(points))}
    return sorted(((i if i is not None else -1), m, d, by[m], sum(by.values()), sha256(",".join(map(str, points[m])).encode()).hexdigest()) for (i, _), (d, m) in zip(kept, at))


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "x", "y") for i, e in rows], SHAPE)


def result(df):
    return sorted(((r.vec_id if r.vec_id is not None else -1), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_matches_brute_force(spark, k):
    rng = random.Random(k)
    # few values, so ties between centroids and equal vectors are common
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.1, 0.5]) for _ in range(4)]) for i in range(300)] + [(1000 + i, [0.1, 0.1, 0.1, 0.1]) for i in range(100)]
    rows += [(7, [0.3] * 4), (7, [0.3] * 4), (None, [0.2] * 4), (2000, None), (2001, [0.1] * 3), (2002, [0.1, None, 0.1, 0.1]), (2003, [float("nan")] * 4), (2004, [float("inf"), 0.0, 0.0, 0.0]), (2005, [1e300, -1e300, 0.0, 0.0]), (2006, [])]
    assert result(C.clustered(frame(spark, rows), k=k, dims=4)) == brute(rows, k, 3, 4, 64)


def test_fewer_rows_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [-0.5, 0.25])]
    assert result(C.clustered(frame(spark, rows), dims=2)) == brute(rows, 16, 3, 2, 64)
    assert C.clustered(frame(spark, []), dims=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert C.clustered(frame(spark, []), dims=2).count() == C.clustered(frame(spark, [(None, [0.1, 0.1])]), dims=2).count() == 0


def test_text_ids_stay(spark):
    df = spark.createDataFrame([(f"v{i}", [float(i % 3), 1.0]) for i in range(30)], "name string, e array<float>")
    got = C.clustered(df, "name", "e", k=3, dims=2)
    assert {r.name for r in got.collect()} == {f"v{i}" for i in range(30)}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40, 300])
def test_tree_search_is_exact_and_prunes(n):
    rng = np.random.default_rng(n)
    groups = rng.integers(-2000, 2000, (max(1, n // 8), 6))
    points = groups[rng.integers(0, len(groups), n)] + rng.integers(-3, 4, (n, 6))  # close groups, equal points among them
    vectors = np.concatenate([points[rng.integers(0, n, 500)] + rng.integers(-2, 3, (500, 6)), rng.integers(-2500, 2500, (100, 6))])
    number, distance = C.nearest(vectors, points, C.tree_of(points))
    want = ((vectors[:, None] - points[None]) ** 2).sum(-1)
    assert (number == want.argmin(1)).all() and (distance == want.min(1)).all()


def test_far_branches_are_not_opened():
    points = np.array([[x, 0] for x in range(0, 64_000, 1000)], np.int64)
    nodes = C.tree_of(points)
    opened = []
    real = [node.points for node in nodes]
    for node, p in zip(nodes, real):
        node.points = type("Seen", (list,), {"__iter__": lambda self: (opened.append(len(self)), list.__iter__(self))[1]})(p)
    C.nearest(np.array([[10, 0]], np.int64), points, nodes)
    assert sum(opened) < len(points) / 2
