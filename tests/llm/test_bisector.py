"""Clustering by bisectors against plain distances."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stalemark.llm import bisector

VECTORS = "vec_id long, embedding array<float>, label int"


def nearest(vector, centroids):
    return min((sum((a - b) ** 2 for a, b in zip(vector, c)), i) for i, c in enumerate(centroids))


def expected(rows, k, rounds):
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in rows[:k]]
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v, centroids)[1], []).append(v)
        for c, members in groups.items():
            centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    out = [(i, *nearest(v, centroids)[::-1]) for i, v in rows]
    own = {c: sum(d for _, n, d in out if n == c) for c in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, own[c], sum(own.values()), digest[c]) for i, c, d in out)


def found(frame):
    return sorted((str(r[0]), *r[1:]) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("spread, k, rounds", [(2, 16, 3), (50, 16, 3), (1, 5, 2), (50, 300, 1), (3, 1, 2), (9, 4, 0)])
def test_against_plain_distances(spark, spread, k, rounds):
    """Small spreads give many ties and equal vectors."""
    rng = random.Random(spread)
    rows = [(i, [rng.randrange(-spread, spread + 1) for _ in range(4)]) for i in range(250)]
    rows += [(3, [0, 0, 0, 0]), (3, [1, 0, 0, 0]), (None, [2, 2, 2, 2]), *rows[:9]]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3)
    assert found(bisector.cluster_vectors(df, k, rounds)) == expected(rows, k, rounds)


def test_which_vectors_take_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.26], 0), (2, [1e-9, -1e-9], 1), (None, [0.25, 3.0], 2)]
    bad = [(4, None, 0), (5, [], 0), (6, [1.0], 0), (7, [1.0, None], 0), (8, [nan, 1.0], 0), (9, [1.0, -inf], 0), (10, [1.0] * 3, 0)]
    df = spark.createDataFrame(good + bad, VECTORS).withColumns({n: F.lit("mine") for n in ("cluster", "vector", "distance")})
    kept = bisector.whole_vectors(df, width=2)
    rows = [(1, [32, -17]), (2, [0, -1]), (None, [16, 192])]
    assert sorted((str(r.vec_id), r.vector) for r in kept.collect()) == sorted((str(i), v) for i, v in rows)
    assert found(bisector.cluster_vectors(kept, 2, 3)) == expected(rows, 2, 3)
    assert bisector.cluster_vectors(bisector.whole_vectors(df.where("label > 5"))).collect() == []


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [2.0**20, 0.0], 0)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        bisector.whole_vectors(df, width=2).collect()


def test_bisectors_settle_ties_for_the_smaller_number():
    centroids = np.array([[0, 2], [2, 0], [0, 0], [2, 2], [0, 2]])
    grid = np.array([[x, y] for x in range(-1, 4) for y in range(-1, 4)])
    got = bisector.Bisectors(centroids).nearest(grid)
    assert got.tolist() == [nearest(v, centroids.tolist())[1] for v in grid.tolist()]
