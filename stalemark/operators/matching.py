"""Matching intervals against intervals: pairs, existence, exact lookup, and the latest update before a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stalemark.functions.columns import floor_div, holds_point, overlaps, power_of_two
from stalemark.operators.scans import scan
from stalemark.operators.slices import NO_SLICES, TimeSlices, length_level
from stalemark.operators.states import cell_values
from stalemark.schemas import ITEM

INTERVAL = (*ITEM, "start_ns", "end_ns")


# ------------------------------------------------------------------------ pairs


# Two intervals meet, besides the key, on a time bucket about as wide as one of them. An interval is rounded up to a
# power of 16 and falls into at most two buckets of that width; a point looks into one bucket per width that occurs (a
# few). So rows are compared only with rows near them, whatever mix of lengths there is and however many rows an item
# has, and a hot item spreads over its buckets.
#
# A very long interval has a very wide bucket, which may hold most points of its item. In hot items a bucket is therefore
# divided by time slice as well: a point is in one slice, and an interval is copied to every slice it reaches into. Only
# where an interval covers whole slices does that make more than two copies, and then it pairs with all that is in them.


def _levels(intervals: DataFrame, start: str, end: str, slices: TimeSlices) -> Column:
    """The levels to look into, an array of at most 16 numbers: those measured with the slices, or a scalar subquery."""
    if slices.levels:
        return F.array(*map(F.lit, slices.levels))
    return intervals.agg(F.collect_set(length_level(F.col(start), F.col(end)))).scalar()


def _level_of(start: str, end: str, slices: TimeSlices) -> Column:
    """The level of an interval: of the measured ones the least that is wide enough, or else the widest."""
    own = length_level(F.col(start), F.col(end))
    if not slices.levels:
        return own
    chosen = F.lit(slices.levels[-1])
    for level in slices.levels[-2::-1]:
        chosen = F.when(own <= level, level).otherwise(chosen)
    return chosen


def _as_interval(role: str, start: str, end: str, slices: TimeSlices) -> Column:
    level = _level_of(start, end, slices)
    width = power_of_two(level)
    buckets = F.sequence(floor_div(F.col(start), width), floor_div(F.col(end), width))
    return F.transform(buckets, lambda b: F.struct(F.lit(role).alias("role"), level.alias("level"), b.alias("bucket")))


def _as_point(role: str, point: str) -> Column:
    at = F.col(point)
    return F.transform(
        "_levels",
        lambda n: F.struct(F.lit(role).alias("role"), n.alias("level"), floor_div(at, power_of_two(n)).alias("bucket")),
    )


def _placed(
    df: DataFrame,
    places: Column,
    span: tuple[str, str],
    interval_role: str | None,
    slices: TimeSlices,
    keys: Sequence[str],
    levels: Column | None = None,
    outer: bool = False,
) -> DataFrame:
    """One row per place, with the columns of ``PLACE``; points look into the given ``levels``.

    In ``interval_role`` the row stands for its whole span, otherwise for the span's start. With ``outer`` a row without a
    span stays, in no place.
    """
    ready = df if levels is None else df.withColumn("_levels", levels)
    slice_of = F.lit(0)
    if slices:
        ready = slices.assign(ready, F.col(span[0]), keys).withColumnRenamed("slice", "_first").drop("hot")
        ready = slices.assign(ready, F.col(span[1]), keys).withColumnRenamed("slice", "_last").drop("hot")
        last = F.when(F.col("_place.role") == interval_role, F.col("_last")).otherwise(F.col("_first"))
        slice_of = (F.explode_outer if outer else F.explode)(F.sequence("_first", last))
    return ready.withColumn("_place", (F.explode_outer if outer else F.explode)(places)).select(
        *df.columns,
        F.col("_place.role").alias("_role"),
        F.col("_place.level").alias("_level"),
        F.col("_place.bucket").alias("_bucket"),
        slice_of.alias("_slice"),
    )


PLACE = ["_role", "_level", "_bucket", "_slice"]


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    closed: bool,
    keys: Sequence[str] = ITEM,
    prefix: str = "update_",
    slices: TimeSlices = NO_SLICES,
    span: tuple[str, str] = ("start_ns", "end_ns"),
    keep_left: bool = False,
) -> DataFrame:
    """Pairs of left and right rows of the same key whose intervals overlap, each pair once.

    Right columns other than the keys get the prefix; ``span`` names the left interval. Two intervals overlap exactly if
    the right one starts inside the left one ("in_left") or the left one starts strictly inside the right one ("in_right");
    never both. With ``keep_left`` every left row appears at least once more without a partner, in one or several copies.
    """
    right = right.select(*keys, *[F.col(c).alias(prefix + c) for c in right.columns if c not in keys])
    (l_start, l_end), r_start, r_end = span, f"{prefix}start_ns", f"{prefix}end_ns"
    if not closed:  # an empty half-open interval overlaps nothing
        if not keep_left:
            left = left.where(F.col(l_start) < F.col(l_end))
        right = right.where(F.col(r_start) < F.col(r_end))
    in_left = F.col(r_start) >= F.col(l_start)
    in_left &= F.col(r_start) <= F.col(l_end) if closed else F.col(r_start) < F.col(l_end)
    in_right = F.col(l_start) > F.col(r_start)
    in_right &= F.col(l_start) <= F.col(r_end) if closed else F.col(l_start) < F.col(r_end)

    as_left = F.concat(_as_interval("in_left", l_start, l_end, slices), _as_point("in_right", l_start))
    as_right = F.concat(_as_point("in_left", r_start), _as_interval("in_right", r_start, r_end, slices))
    lefts = _placed(left, as_left, span, "in_left", slices, keys, _levels(right, r_start, r_end, slices), outer=keep_left)
    rights = _placed(right, as_right, (r_start, r_end), "in_right", slices, keys, _levels(left, l_start, l_end, slices))
    met = ((F.col("_role") == "in_left") & in_left) | ((F.col("_role") == "in_right") & in_right)
    if not keep_left:
        return lefts.join(rights, [*keys, *PLACE]).where(met).drop(*PLACE)
    if not closed:
        met = met & (F.col(l_start) < F.col(l_end))
    theirs = {name: f"_their_{name}" for name in (*keys, *PLACE)}
    for name, other in theirs.items():
        met = (F.col(name) == F.col(other)) & met
    return lefts.join(rights.withColumnsRenamed(theirs), met, "left").drop(*PLACE, *theirs.values())


def contains_point(
    points: DataFrame, point: str, intervals: DataFrame, keys: Sequence[str] = ITEM, slices: TimeSlices = NO_SLICES
) -> DataFrame:
    """Pairs of a point and a closed interval (``start_ns``, ``end_ns``) of the same key that holds it."""
    span = ("start_ns", "end_ns")
    asked = _placed(points, _as_point("at", point), (point, point), None, slices, keys, _levels(intervals, *span, slices))
    stored = _placed(intervals, _as_interval("at", *span, slices), span, "at", slices, keys)
    held = holds_point(F.col("start_ns"), F.col("end_ns"), F.col(point))
    return asked.join(stored, [*keys, *PLACE]).where(held).drop(*PLACE)


# -------------------------------------------------------------------- existence


def mark_overlapped(
    probes: DataFrame,
    intervals: DataFrame,
    slices: TimeSlices,
    closed: bool,
    keys: Sequence[str],
    span: tuple[str, str] = ("start_ns", "end_ns"),
    witness: bool = False,
) -> DataFrame:
    """Probes with ``hit``: does any interval of the same key overlap the probe's ``span``?

    No pairs are made. Of the intervals that start before a probe ends, one overlaps it exactly if the one with the
    greatest end does, and that is a running maximum in time order. ``keys`` must include the data item. With
    ``witness`` that interval is returned too, as ``found_start`` and ``found_end`` (null without a hit).
    """
    start, end = span
    marks = intervals if closed else intervals.where(F.col("start_ns") < F.col("end_ns"))
    marks = marks.select(*keys, F.col("start_ns").alias(start), F.col("end_ns").alias(end))
    asks = probes.withColumn("_asks", F.lit(True))
    both = asks.unionByName(marks.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    swept = sweep_overlaps(both, slices, closed, keys, span, "_asks", witness)
    found = ["found_start", "found_end"] if witness else []
    return swept.select(*probes.columns, "hit", *found)


def sweep_overlaps(
    rows: DataFrame,
    slices: TimeSlices,
    closed: bool,
    keys: Sequence[str],
    span: tuple[str, str],
    asks: str,
    witness: bool = False,
) -> DataFrame:
    """The rows whose column ``asks`` is true, with ``hit``: does the span of any other row of the same key overlap theirs?

    See ``mark_overlapped``. Rows of both kinds have their interval in ``span``; those that don't ask hold no empty ones if
    intervals are half-open.
    """
    start, end = F.col(span[0]), F.col(span[1])
    # Of equal ends, the later start is the witness.
    reach = F.struct(end.alias("end"), start.alias("start")) if witness else end
    timeline = rows.withColumns(
        {"_time": F.when(F.col(asks), end).otherwise(start), "_reach": F.when(~F.col(asks), reach)}
    )
    # At equal times a closed probe comes after the starts, a half-open one ahead of them.
    timeline = timeline.withColumn("_tie", F.col(asks) if closed else ~F.col(asks))
    timeline = slices.assign(timeline, F.col("_time"))
    swept = scan(
        timeline, slices, order=["_time", "_tie"], running={"_far": ("max", F.col("_reach"))}, keys=keys
    ).where(F.col(asks))
    far = F.col("_far.end") if witness else F.col("_far")
    reached = far >= start if closed else (far > start) & (start < end)
    found = [F.when(F.col("hit"), F.col(f"_far.{c}")).alias(f"found_{c}") for c in ("start", "end")] if witness else []
    return swept.withColumn("hit", F.coalesce(reached, F.lit(False))).select(*rows.columns, "hit", *found)


def any_overlap(reads: DataFrame, intervals: DataFrame, closed: bool, slices: TimeSlices = NO_SLICES) -> DataFrame:
    """Reads that overlap at least one interval of their item."""
    spans = reads.select(*INTERVAL).distinct()
    hits = mark_overlapped(spans, intervals.select(*INTERVAL), slices, closed, ITEM).where("hit").drop("hit")
    return reads.join(hits, list(INTERVAL), "left_semi")


def search_overlap(reads: DataFrame, intervals: DataFrame, closed: bool, slices: TimeSlices = NO_SLICES) -> DataFrame:
    """Per distinct read span one interval that overlaps it (the one that ends last), or null."""
    spans = reads.select(*INTERVAL).distinct()
    marked = mark_overlapped(spans, intervals.select(*INTERVAL), slices, closed, ITEM, witness=True)
    return marked.drop("hit")


# ----------------------------------------------------------------- exact lookup


def interval_lookup(wanted: DataFrame, states: DataFrame, value: str = "value") -> DataFrame:
    """The value stored for exactly the wanted interval, or null."""
    return wanted.join(states.select(*INTERVAL, value), list(INTERVAL), "left")


def interval_delete(states: DataFrame, gone: DataFrame) -> DataFrame:
    """States without the given intervals."""
    return states.join(gone.select(*INTERVAL), list(INTERVAL), "left_anti")


def dedup_interval_last(rows: DataFrame, order: str = "seq_id") -> DataFrame:
    """One row per interval: of several, the last."""
    rest = [c for c in rows.columns if c not in INTERVAL]
    return (
        rows.groupBy(*INTERVAL)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
        .select(*INTERVAL, "last.*")
    )


def interval_bounds(states: DataFrame) -> DataFrame:
    """Per item: the lowest interval (least start, then least end) and the highest (greatest end, then greatest start)."""
    return (
        states.groupBy(*ITEM)
        .agg(F.min(F.struct("start_ns", "end_ns")).alias("low"), F.max(F.struct("end_ns", "start_ns")).alias("high"))
        .select(
            *ITEM,
            F.col("low.start_ns").alias("lowest_start_ns"),
            F.col("low.end_ns").alias("lowest_end_ns"),
            F.col("high.start_ns").alias("highest_start_ns"),
            F.col("high.end_ns").alias("highest_end_ns"),
        )
    )


def interval_count(states: DataFrame) -> DataFrame:
    """Number of distinct intervals per item."""
    return states.select(*INTERVAL).distinct().groupBy(*ITEM).agg(F.count("*").alias("n_intervals"))


def sort_intervals(states: DataFrame, slices: TimeSlices = NO_SLICES) -> DataFrame:
    """Distinct intervals with their position in the item's (start, end) order, and the greatest end up to there."""
    rows = slices.assign(states.select(*INTERVAL).distinct(), F.col("start_ns"))
    ranked = scan(
        rows,
        slices,
        order=["start_ns", "end_ns"],
        running={"position": ("sum", F.lit(1).cast("bigint")), "max_end": ("max", F.col("end_ns"))},
    )
    return ranked.select(*INTERVAL, "position", "max_end")


# ----------------------------------------------------------------- before a read


def anchor_running(reads: DataFrame, states: DataFrame, slices: TimeSlices, carry: Sequence[str] = ()) -> DataFrame:
    """For ``running_value``: reads with the interval the state before them is taken from.

    That is the last update, in (start, end) order, of the longest run of updates that had all ended by the read's start.
    The greatest end so far never falls, so it serves as the time of an update, and the run's last update is the
    greatest (start, end) at or before the read. Adds ``anchor_*`` (null if no such update), and the item's
    ``lowest_start`` and ``highest_*`` interval. With ``carry``, the states stay among the rows, with these columns of
    theirs; ``is_read`` tells them apart.
    """
    marks = states.select(
        *ITEM, F.col("max_end").alias("_time"), F.lit(0).alias("_tie"), F.struct("start_ns", "end_ns").alias("_mark"), *carry
    )
    swept = _sweep(
        reads,
        marks,
        slices,
        probe_tie=1,
        whole={
            "lowest_start": ("min", F.col("_mark.start_ns")),
            "_highest": ("max", F.struct("_mark.end_ns", "_mark.start_ns")),
        },
        stay=bool(carry),
    )
    known = F.col("lowest_start").isNotNull()
    return swept.select(
        *_own(reads, carry),
        F.col("_last.start_ns").alias("anchor_start"),
        F.col("_last.end_ns").alias("anchor_end"),
        "lowest_start",
        F.when(known, F.col("_highest.start_ns")).alias("highest_start"),
        F.when(known, F.col("_highest.end_ns")).alias("highest_end"),
    )


def anchor_possible(
    reads: DataFrame, states: DataFrame, slices: TimeSlices, whole: dict | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """For ``possible_set``: reads with the span the state before them is taken from.

    The latest end strictly before the read counts, with all updates that share it. They all overlap what the longest of
    them overlaps, so the span from the earliest of their starts to that end stands for all. Ends up to 1 do not count:
    the search for earlier updates begins at time 1. Such updates have no mark, but ``whole`` covers them. ``carry`` as in
    ``anchor_running``.
    """
    mark = F.struct("end_ns", (-F.col("start_ns")).alias("minus_start"))
    marks = states.select(
        *ITEM,
        F.col("end_ns").alias("_time"),
        F.lit(1).alias("_tie"),
        F.when(F.col("end_ns") > 1, mark).alias("_mark"),
        *carry,
    )
    swept = _sweep(reads, marks, slices, probe_tie=0, whole=whole or {}, stay=bool(carry))
    return swept.select(
        *_own(reads, carry),
        (-F.col("_last.minus_start")).alias("anchor_start"),
        F.col("_last.end_ns").alias("anchor_end"),
        *(whole or {}),
    )


def _own(reads: DataFrame, carry: Sequence[str]) -> list[str]:
    return [*reads.columns, *(c for c in carry if c not in reads.columns), *(["is_read"] if carry else [])]


def _sweep(reads: DataFrame, marks: DataFrame, slices: TimeSlices, probe_tie: int, whole: dict, stay: bool) -> DataFrame:
    """Reads with ``_last``, the greatest mark of their item at or before their start (ties as given); marks may stay."""
    asks = reads.withColumns({"_time": F.col("start_ns"), "_tie": F.lit(probe_tie), "is_read": F.lit(True)})
    timeline = asks.unionByName(marks.withColumn("is_read", F.lit(False)), allowMissingColumns=True)
    swept = scan(
        slices.assign(timeline, F.col("_time")),
        slices,
        order=["_time", "_tie"],
        running={"_last": ("max", F.col("_mark"))},
        whole=whole,
    )
    return swept if stay else swept.where("is_read")


# ----------------------------------------------------------------- values at a span


def values_at(spans: DataFrame, cells: DataFrame, slices: TimeSlices, closed: bool) -> DataFrame:
    """Distinct spans (item, start, end) with ``possible``, the values of all intervals that overlap them, rising.

    ``cells`` are states as cells. Before pairing, overlapping intervals of the same cell are merged into one: which
    interval gave a value does not matter here, and where many updates run at once this removes most of them.
    """
    spans = spans.select(*INTERVAL).distinct()
    pairs = overlap_join(spans, merge_runs(cells, slices), closed, slices=slices)
    held = pairs.groupBy(*INTERVAL).agg(found_cells().alias("held"))
    return held.select(*INTERVAL, F.array_sort(F.array_distinct(values_in("held"))).alias("possible"))


def found_cells() -> Column:
    """The set of cells that an overlap join found for a group."""
    cell = F.struct(F.col("update_level").alias("level"), F.col("update_cell").alias("cell"))
    return F.collect_set(F.when(F.col("update_cell").isNotNull(), cell))


def values_in(cells: str) -> Column:
    return F.flatten(F.transform(cells, lambda c: cell_values(c["level"], c["cell"])))


def merge_runs(cells: DataFrame, slices: TimeSlices) -> DataFrame:
    """Intervals of one item and cell that overlap or touch, merged. A run does not cross a time slice."""
    group = [*ITEM, "level", "cell"]
    rows = slices.assign(cells.select(*INTERVAL, "level", "cell"), F.col("start_ns")).drop("hot")
    apart = [*group, "slice"] if slices else group
    order = Window.partitionBy(*apart).orderBy("start_ns", "end_ns")
    reach = F.max("end_ns").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start_ns") > F.col("_reach"), F.lit(True)).cast("int")
    return (
        rows.withColumn("_reach", reach)
        .withColumn("_run", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*apart, "_run")
        .agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
        .drop("slice", "_run")
    )


def overlapping(a: str, b: str, closed: bool) -> Column:
    """Do the intervals ``a_start_ns..a_end_ns`` and ``b_start_ns..b_end_ns`` of a row overlap?"""
    return overlaps(F.col(f"{a}start_ns"), F.col(f"{a}end_ns"), F.col(f"{b}start_ns"), F.col(f"{b}end_ns"), closed)
