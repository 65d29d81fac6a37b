"""Centroid clustering of integer vectors, each vector dealt to its nearest centroid by a tournament of bisectors.

For centroids a and b the points as far from one as from the other form a plane, 2x(a - b) = |a|² - |b|². Normals and
thresholds of all pairs are integers and made once a round; k - 1 sign tests, the winner so far against the next centroid,
leave the nearest one. On the plane the smaller number wins, so ties go to it. Only the winner's distance is computed.

A round is one pass over the vectors: every task adds up its own clusters, and k rows per task are summed. The driver holds
k centroids and nothing else.

Edge cases: vectors that are null, of another width, or hold null or non-finite components take no part; a null id takes
part, as text it is ''; of repeated ids, equal vectors are equal in everything, others are told apart by their components
when the first centroids are chosen; fewer vectors than k make as many centroids; an empty table gives no rows; other
columns are not looked at, whatever their names. A component of ``LARGEST`` or more after scaling is an error, since
64-bit distances would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stalemark.llm.frames import write_through

K, ROUNDS, SCALE, WIDTH = 16, 3, 64, 64
LARGEST = 1 << 26


def whole_vectors(df: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """(vec_id, vector): the components times ``scale``, rounded down, of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    scaled = F.transform(x, lambda v: v.cast("double") * scale)
    large = F.exists(scaled, lambda v: F.abs(v) >= LARGEST)
    whole = F.when(large, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<long>"))
    whole = whole.otherwise(F.transform(scaled, lambda v: F.floor(v).cast("long")))
    return df.where(x.isNotNull() & (F.size(x) == width)).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


class Bisectors:
    """Normals and thresholds of all pairs of centroids: between i < j, i is nearer or as near where normal . x >= threshold."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        square = (centroids**2).sum(axis=1)
        self.normals = 2 * (centroids[:, None, :] - centroids[None, :, :])
        self.thresholds = square[:, None] - square[None, :]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        winner = np.zeros(len(vectors), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", vectors, self.normals[winner, j]) - self.thresholds[winner, j]
            winner[side < 0] = j
        return winner

    def distances(self, vectors: np.ndarray, number: np.ndarray) -> np.ndarray:
        return ((vectors - self.centroids[number]) ** 2).sum(axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch["vector"]
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _sums(df: DataFrame, planes: Bisectors) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact component sums of each cluster that has any."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = planes.centroids.shape
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch)
                number = planes.nearest(vectors)
                np.add.at(sums, number, vectors)
                counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    parts = df.select("vector").mapInArrow(add_up, "cluster long, n long, sums array<long>")
    # Sums of a task fit 64 bits; over all tasks they are added as decimals.
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    sums = sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for row in sums.collect():  # k * width numbers
        out.setdefault(row.cluster, (row.n, {}))[1][row.at] = int(row.total)
    return {c: (n, [totals[i] for i in range(len(totals))]) for c, (n, totals) in out.items()}


def _first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k smallest hashes of ``1:<vec_id>``."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(hashed.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of (vec_id, vector), integer vectors of one width."""
    vectors = write_through(vectors, "vectors")
    centroids = _first_centroids(vectors, k)
    result = "vec_id long, cluster int, distance long"
    if not len(centroids):
        columns = f"{result}, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], columns)
    for _ in range(rounds):
        for number, (n, sums) in _sums(vectors, Bisectors(centroids)).items():
            centroids[number] = [total // n for total in sums]
    planes = Bisectors(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch)
                number = planes.nearest(matrix)
                found = [batch["vec_id"], pa.array(number.astype(np.int32)), pa.array(planes.distances(matrix, number))]
                yield pa.RecordBatch.from_arrays(found, ["vec_id", "cluster", "distance"])

    assigned = write_through(vectors.mapInArrow(assign, result), "clusters")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("own"))
    totals = {r.cluster: r.own for r in sums.collect()}  # at most k rows
    facts = [
        F.struct(
            F.lit(totals.get(c, 0)).cast("long").alias("cluster_inertia"),
            F.lit(sum(totals.values())).cast("long").alias("inertia"),
            F.lit(hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()).alias("centroid_sha256"),
        )
        for c, centroid in enumerate(centroids)
    ]
    known = F.element_at(F.array(*facts), F.col("cluster") + 1)
    return assigned.withColumn("_known", known).select("vec_id", "cluster", "distance", "_known.*")
