"""Exact ranks and running sums of large groups, without a task that holds a whole group.

Rows are ordered by a 64-bit key that is spread evenly (a hash). The top bits of the key cut a group into buckets, so a
window runs over one bucket; a small table of sums per bucket adds what the buckets before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4_000


def bits_for(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Bits of the key that make buckets of at most about ``per_bucket`` rows."""
    return max(0, (max(rows, 1) // per_bucket).bit_length())


def bucket_of(key: str, bits: int) -> Column:
    """The top bits of a signed key, in the order of the key."""
    return F.shiftright(F.col(key), 64 - bits) if bits else F.lit(0).cast("long")


def add_running(df: DataFrame, group: list[str], order: list[str], bits: int, sums: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``sums``, the total of its column over the group's rows that come before.

    ``order`` starts with the spread key. Rows equal in all of ``order`` may stand in any order among themselves.
    """
    df = df.withColumn("_bucket", bucket_of(order[0], bits))
    in_bucket = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "_bucket").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    offsets = totals.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
        F.col("_bucket").alias("_b"),
        *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums),
    )
    inside = df.select("*", *(F.coalesce(F.sum(c).over(in_bucket), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()))
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return inside.join(offsets, same).select(
        *(c for c in df.columns if c != "_bucket"), *((F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums)
    )
