"""Exact top-k search by inner product: a ball tree per shard, branch and bound, a shared k-th score.

Vectors are dealt into shards and queries into blocks, and each (shard, block) is one bounded task. A task builds a ball
tree over its shard and opens nodes in the order of the most that a query's inner product can be inside the ball. The
first shard is searched alone; its k-th score of each query is where every other shard starts, so they prune at once.

Edge cases: vectors that are null or hold null or non-finite components take no part; vectors meet only those of their
own length, and empty vectors score 0 with each other; a null id takes no part; ties go to the smaller id; many equal
vectors form one leaf of which the k smallest ids but the query's own are looked at; a score beyond 64 bits is set to the end of the range.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stalemark.llm.frames import partitions, write_through

K = 5
SCALE = 256
LEAF = 64
ROWS_PER_SHARD = 65_536
LEAST_ROWS = 1_024
QUERIES_PER_BLOCK = 2_048
HITS = "query_id long, vec_id long, score long"


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, vector): components times ``scale``, rounded down, as doubles that hold integers."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    # A double from 2**52 on is an integer already, and floor() to a long could overflow.
    scaled = F.transform(x, lambda v: F.when(F.abs(v.cast("double")) * scale < 2.0**52, F.floor(v.cast("double") * scale).cast("double")).otherwise(v.cast("double") * scale))
    return df.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("id"), scaled.alias("vector"))


class BallTree:
    """Balls around the rows of ``vectors``, which are in the order of their ids."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, self.leaf = vectors, leaf
        self.centres, self.radii, self.children, self.rows, self.same = [], [], [], [], []
        if len(vectors):
            self._grow(np.arange(len(vectors)))
        self.centres, self.radii = np.array(self.centres).reshape(len(self.centres), vectors.shape[1]), np.array(self.radii)

    def _grow(self, rows: np.ndarray) -> int:
        points = self.vectors[rows]
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        equal = bool((points == points[0]).all())
        node = len(self.centres)
        self.centres.append(points[0] if equal else centre)
        self.radii.append(0.0 if equal else float(away.max()))
        self.children.append(())
        self.rows.append(rows)
        self.same.append(equal)
        if len(rows) > self.leaf and not equal:
            far = points[int(away.argmax())]
            other = points[int(((points - far) ** 2).sum(axis=1).argmax())]
            along = points @ (far - other)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            self.rows[node] = None
            self.children[node] = (self._grow(np.sort(rows[order[:half]])), self._grow(np.sort(rows[order[half:]])))
        return node

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float, exact: bool) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) of this tree but for the id ``own``; those below ``floor`` may be left out."""
        if not len(self.radii):
            return []
        norm = float(np.sqrt(query @ query))
        most = self.centres @ query + self.radii * norm
        most += 1e-9 * (np.abs(most) + norm * np.sqrt((self.centres**2).sum(axis=1)) + self.radii * norm) + 1e-6
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        queue = [(-most[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if -bound < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if most[child] >= least:
                        heapq.heappush(queue, (-most[child], child))
                continue
            rows = self.rows[node]
            if self.same[node]:
                rows = rows[ids[rows] != own][:k]
            if exact:
                scores = self.vectors[rows] @ query
                keep = np.flatnonzero(scores >= least)
            else:  # integers of any size
                scores = [sum(int(a) * int(b) for a, b in zip(self.vectors[r], query, strict=True)) for r in rows]
                scores = [min(max(s, -(2**63)), 2**63 - 1) for s in scores]
                keep = range(len(rows))
            for i in keep:
                one = int(ids[rows[i]])
                hit = (int(scores[i]), -one)
                if one == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
        return [(score, -negative) for score, negative in best]


def search_shard(shard: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The hits of a block of queries (id, vector, floor) in a shard (id, vector)."""
    found: list[tuple[int, int, int]] = []
    by_length: dict[int, tuple[list, list]] = {}
    for side, table in enumerate((shard, queries)):
        lengths = pc.list_value_length(table.column("vector")).to_numpy()
        for n in np.unique(lengths):
            by_length.setdefault(int(n), ([], []))[side].extend(np.flatnonzero(lengths == n).tolist())
    for n, (rows, asked) in by_length.items():
        if not rows or not asked:
            continue
        own = shard.take(pa.array(rows)).sort_by("id")
        ids = own.column("id").to_numpy()
        vectors = own.column("vector").combine_chunks().flatten().to_numpy().reshape(len(rows), n)
        some = queries.take(pa.array(asked))
        points = some.column("vector").combine_chunks().flatten().to_numpy().reshape(len(asked), n)
        largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(points).max(initial=0)) * max(n, 1)
        tree = BallTree(vectors)
        for q, point, floor in zip(some.column("id").to_pylist(), points, some.column("floor").to_pylist(), strict=True):
            low = float("-inf") if floor is None else float(floor)
            low = low if largest < 2.0**53 else float("-inf")
            found += [(q, one, score) for score, one in tree.search(point, ids, q, k, low, largest < 2.0**53)]
    columns = list(zip(*found, strict=True)) or [[], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = K, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The ``k`` best of ``vectors`` (id, vector) for each of ``queries`` (id, vector), itself left out:
    (query_id, rank from 1, vec_id, score).
    """
    rows, asked = vectors.count(), queries.count()
    shards = max(1, -(-rows // rows_per_shard), min(partitions(vectors), rows // LEAST_ROWS))
    blocks = max(1, -(-asked // QUERIES_PER_BLOCK))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = queries.select(F.col("id").alias("id"), F.col("vector").alias("vector"))  # columns of their own beside those of ``vectors``
    asking = asking.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def hits(shard: DataFrame, query: DataFrame) -> DataFrame:
        pair = ("shard", "block")
        return shard.groupBy(*pair).cogroup(query.groupBy(*pair)).applyInArrow(lambda a, b: search_shard(a, b, k), HITS)

    none = F.lit(None).cast("long").alias("floor")
    first = hits(dealt.where("shard = 0"), asking.select("*", F.lit(0).alias("shard"), none))
    if shards > 1:
        first = write_through(first, "hits")
        floors = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("score") >= k, F.min("score")).alias("floor"))
        later = asking.join(floors, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
        first = first.union(hits(dealt.where("shard > 0"), later))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
