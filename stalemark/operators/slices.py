"""Time slices for hot data items.

A scan in time order over one data item is a window, and a window runs a whole item in one task. Items with more rows
than a task should take are cut into time slices; a scan then runs per slice and adds what the earlier slices
contribute (see ``scans``). All others keep slice 0.

The cuts are a table with one row per hot item, made by aggregation, written once and joined by item, so every branch of
a plan and every retried task slices alike, and nothing about the items passes through the driver. An item gets as many
slices as its rows ask for: up to ``FAN`` by the first table; each of those is cut again by a second table if it still
holds more rows than a slice should.

Slices only decide where the work runs. Results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stalemark.schemas import ITEM
from stalemark.session import write_through

ROWS_PER_SLICE = 2_000_000
FAN = 1024
CUTS_PER_BLOCK = 32


@dataclass(frozen=True)
class TimeSlices:
    """Cuts of hot items: ``coarse`` per item, ``fine`` per item and coarse slice; None where there is nothing to cut.

    Both hold rising cuts in blocks of ``CUTS_PER_BLOCK``, and the first cut of each block. ``levels`` are the classes of
    interval lengths that were measured along with the rows, rising (see ``length_level``); none if unknown.
    """

    coarse: DataFrame | None = None
    fine: DataFrame | None = None
    levels: tuple[int, ...] = ()

    def __bool__(self) -> bool:
        return self.coarse is not None

    def assign(self, df: DataFrame, time: Column, keys: Sequence[str] = ITEM) -> DataFrame:
        """Add ``slice`` (it never falls as ``time`` rises) and ``hot`` (has cuts at all)."""
        if self.coarse is None:
            return df.withColumns({"slice": F.lit(0), "hot": F.lit(False)})
        found = _placed(df, self.coarse, time, [*keys]).withColumn("hot", F.col("_place").isNotNull())
        found = found.withColumn("slice", F.coalesce("_place", F.lit(0))).drop("_place")
        if self.fine is None:
            return found
        found = _placed(found, self.fine, time, [*keys, "slice"])
        return found.withColumn("slice", F.col("slice") * FAN + F.coalesce("_place", F.lit(0))).drop("_place")


NO_SLICES = TimeSlices()
MAX_LEVEL = 60  # widths must fit a BIGINT; longer intervals take a few buckets more


def length_level(start: Column, end: Column) -> Column:
    """The length of an interval as an exponent of 2, rounded up to a multiple of 4 and at most ``MAX_LEVEL``."""
    length = F.try_add(F.try_subtract(end, start), F.lit(1)).cast("double")
    return F.coalesce(F.least(F.ceil(F.log2(length) / 4) * 4, F.lit(MAX_LEVEL)), F.lit(MAX_LEVEL)).cast("int")


def _placed(df: DataFrame, cuts: DataFrame, time: Column, keys: Sequence[str]) -> DataFrame:
    """Add ``_place``, the number of the key's cuts at or before ``time``; null if the key has none."""
    # Two short searches instead of one long one: first the block of cuts, then the place in it.
    blocks = F.size(F.filter("_heads", lambda c: c <= time))
    inside = F.size(F.filter(F.element_at("_blocks", blocks), lambda c: c <= time))
    place = F.when(F.col("_heads").isNull(), None).when(blocks > 0, (blocks - 1) * CUTS_PER_BLOCK + inside).otherwise(0)
    return df.join(cuts, list(keys), "left").withColumn("_place", place).drop("_heads", "_blocks")


def _cut(times: DataFrame, keys: Sequence[str], rows_per_slice: int) -> DataFrame:
    """Cuts of ``times`` (keys, t, n_rows) that split each key's ``n_rows`` about evenly, up to ``FAN`` ways."""
    marks = times.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"), F.percentile_approx("t", [i / FAN for i in range(1, FAN)], 16 * FAN).alias("_all")
    )
    wanted = F.least(F.lit(FAN), F.greatest(F.lit(2), F.ceil(F.col("n_rows") / rows_per_slice))).cast("int")
    picked = F.transform(
        F.sequence(F.lit(1), wanted - 1),
        lambda i: F.element_at("_all", F.greatest(F.lit(1), F.round(i * FAN / wanted).cast("int")).cast("int")),
    )
    marks = marks.withColumn("_cuts", F.array_sort(F.array_distinct(picked)))
    starts = F.sequence(F.lit(1), F.size("_cuts"), F.lit(CUTS_PER_BLOCK))
    return marks.select(
        *keys,
        F.transform(starts, lambda i: F.element_at("_cuts", i)).alias("_heads"),
        F.transform(starts, lambda i: F.slice("_cuts", i, CUTS_PER_BLOCK)).alias("_blocks"),
    )


def measure_slices(
    frames: Sequence[DataFrame],
    time: str = "start_ns",
    keys: Sequence[str] = ITEM,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> TimeSlices:
    """Find the hot items of the frames and cut points that split their rows about evenly.

    One counting job over the key columns and intervals; others only if there are hot items, over their rows alone.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.call_function("div", length_level(F.col(time), F.col("end_ns")), F.lit(4)).cast("int"))

    def narrow(frame: DataFrame) -> DataFrame:
        # An end before its start has no length; such rows take no part in what the levels are for.
        level = F.when(F.col("end_ns") >= F.col(time), bit) if "end_ns" in frame.columns else F.lit(None)
        return frame.select(*keys, F.col(time).alias("t"), level.cast("int").alias("bit"))

    times = narrow(frames[0])
    for frame in frames[1:]:
        times = times.unionByName(narrow(frame))
    counted = times.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.bit_or("bit").alias("bits"))
    most, bits = counted.agg(F.max("n_rows"), F.bit_or("bits")).first()
    levels = tuple(4 * i for i in range(MAX_LEVEL // 4 + 1) if (bits or 0) >> i & 1)
    if most is None or most <= rows_per_slice:
        return TimeSlices(levels=levels)
    times, counted = times.drop("bit"), counted.drop("bits").where(F.col("n_rows") > rows_per_slice)
    hot = write_through(counted, "hot-items")
    coarse = write_through(_cut(times.join(hot, list(keys)), keys, rows_per_slice), "cuts")
    if most <= FAN * rows_per_slice:
        return TimeSlices(coarse, levels=levels)
    placed = _placed(times.join(hot.select(*keys), list(keys)), coarse, F.col("t"), keys).withColumnRenamed("_place", "slice")
    inner = [*keys, "slice"]
    full = placed.groupBy(*inner).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > rows_per_slice)
    fine = write_through(_cut(placed.join(write_through(full, "full-slices"), inner), inner, rows_per_slice), "cuts")
    return TimeSlices(coarse, fine, levels)
