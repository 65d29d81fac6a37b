"""The value, or the set of possible values, of every data item over time.

Two semantics. ``running_value``: updates in start order move one number by +1 or -1. ``possible_set``: updates with the
same interval are alternatives, so the value is a set; it never falls below 0.

A set here is never an array. Each step maps v to v+1, to max(v-1, 0), or to both. Starting from one number, the values
of one parity then always form an unbroken run of every second number, and the lowest of the even and of the odd run
differ by 1. So (lowest value, highest even value, highest odd value) is the whole set, however many members it has.

For matching against reads, states are handed on as *cells*. A cell (level, cell) stands for 2**level consecutive values
of one parity; a single value v is the cell (0, v). A run of n values splits into at most 2*log2(n) aligned cells, and a
value is in one of them exactly if its own cell of that level is among them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from stalemark.functions.columns import copies, floor_div, is_collapsed, power_of_two, starting_value
from stalemark.operators.scans import scan
from stalemark.operators.slices import TimeSlices
from stalemark.schemas import INITIAL, ITEM

INTERVAL = (*ITEM, "start_ns", "end_ns")


# ---------------------------------------------------------------- running_value


def net_updates(updates: DataFrame) -> DataFrame:
    """One row per distinct interval with its net step.

    In (start, end) order updates of one interval are neighbours, and the interval keeps the value after the last of
    them, so their sum is enough; copies collapse before the shuffle.
    """
    step = F.when(F.col("op") == "I", 1).when(F.col("op") == "D", -1).otherwise(0)
    return _by_interval(updates).agg(F.sum(step * copies(updates)).cast("bigint").alias("step"))


def _by_interval(updates: DataFrame) -> GroupedData:
    """Grouped by interval. Where copies are collapsed already, rows are dealt by item at once, as all later steps want."""
    return (updates.repartition(*ITEM) if is_collapsed(updates) else updates).groupBy(*INTERVAL)


def running_value(
    updates: DataFrame, slices: TimeSlices, initial: Mapping[str, int] = INITIAL
) -> DataFrame:
    """Each distinct update interval with the item's ``value`` after it and the greatest end so far (``max_end``)."""
    rows = slices.assign(net_updates(updates), F.col("start_ns"))
    rows = scan(
        rows,
        slices,
        order=["start_ns", "end_ns"],
        running={"moved": ("sum", F.col("step")), "max_end": ("max", F.col("end_ns"))},
    )
    value = starting_value(F.col("attribute"), initial, 0) + F.col("moved")
    return rows.select(*INTERVAL, value.alias("value"), "max_end")


# ----------------------------------------------------------------- possible_set


def match_attributes(updates: DataFrame, initial: Mapping[str, int] = INITIAL) -> DataFrame:
    """Updates under each validated attribute whose name their own attribute contains."""
    known = F.array(*[F.lit(name) for name in initial])
    own = F.col("attribute")
    return updates.withColumn("attribute", F.explode(F.filter(known, lambda name: own.contains(name))))


def merge_same_interval(updates: DataFrame) -> DataFrame:
    """One row per distinct interval: does it hold an insert (``inc``), does it hold anything else (``dec``), how many."""
    insert = F.coalesce(F.col("op") == "I", F.lit(False))
    return _by_interval(updates).agg(
        F.bool_or(insert).alias("inc"), F.bool_or(~insert).alias("dec"), F.sum(copies(updates)).alias("n_updates")
    )


def possible_set_states(
    updates: DataFrame, slices: TimeSlices, initial: Mapping[str, int] = INITIAL
) -> DataFrame:
    """Each distinct update interval with the possible values after it, as ``lowest``, ``top_even``, ``top_odd``.

    A top is null where the set has no value of that parity.
    """
    merged = merge_same_interval(match_attributes(updates, initial))
    rows = slices.assign(merged, F.col("start_ns"))
    start = starting_value(F.col("attribute"), initial)

    # The lowest value walks down whenever it can, and stops at 0. A walk with a floor is the free walk minus the
    # deepest point the free walk reached below 0. The highest values walk up whenever they can; ``level`` is that walk
    # without a floor, ``turn`` counts its steps.
    low_step, high_step = F.when(F.col("dec"), -1).otherwise(1), F.when(F.col("inc"), 1).otherwise(-1)
    order = ["start_ns", "end_ns"]
    one = F.lit(1).cast("bigint")
    rows = scan(
        rows,
        slices,
        order=order,
        running={"fell": ("sum", low_step.cast("bigint")), "rose": ("sum", high_step.cast("bigint")), "turn": ("sum", one)},
    )
    rows = rows.withColumns({"free": start + F.col("fell"), "level": start + F.col("rose")})
    rows = scan(
        rows, slices, order=order, before={"dip": ("min", F.col("free"))}, running={"deepest": ("min", F.col("level"))}
    )
    lowest_before = F.col("free") - low_step - F.least(F.lit(0), F.col("dip"))
    rows = rows.select(
        *INTERVAL, "slice", "hot", "turn", "level", "deepest",
        F.greatest(lowest_before + low_step, F.lit(0)).alias("lowest"),
        (F.col("dec") & (lowest_before == 0)).alias("stick"),
    )
    return _with_tops(rows, slices)


def _with_tops(rows: DataFrame, slices: TimeSlices) -> DataFrame:
    """The highest even and odd value of each row.

    A step moves every value by +1 or -1, and so to the other parity; but where 0 may be decremented it also stays
    (``stick``). From each such birth a value follows ``level`` in parallel, at a distance that never changes, until the
    walk falls below the level of its birth; then it is gone. Levels of births tell the two parities apart for good. Of the
    values alive at once with one parity, the highest is the one born first, for a birth at a lower level outlives it.

    So: the death of a birth is the next visit of the walk to the level below it, a minimum over the rows of that level.
    A birth counts if the births of its parity before it are all dead, a running maximum; the last one that counts gives
    the top while it lives. The starting value is a birth at level 0.
    """
    order, level, turn = ["start_ns", "end_ns"], F.col("level"), F.col("turn")
    visit = F.struct(level.alias("place"), F.lit(False).alias("asks"))
    ask = F.struct((level - 1).alias("place"), F.lit(True).alias("asks"))
    events = rows.withColumn("_e", F.explode(F.when(F.col("stick"), F.array(visit, ask)).otherwise(F.array(visit))))
    events = events.select(*rows.columns, "_e.place", "_e.asks").withColumns({"slice": -F.col("slice"), "_late": -turn})
    events = scan(  # from the end backwards
        events,
        slices,
        order=["_late"],
        before={"_next": ("min", F.when(~F.col("asks"), turn))},
        keys=[*ITEM, "place"],
    )
    never = F.lit((1 << 63) - 1)
    death = F.when(F.col("asks"), F.coalesce("_next", never))
    births = events.where(F.col("asks") | ~F.col("stick")).select(
        *(c for c in rows.columns if c != "slice"), (-F.col("slice")).alias("slice"), death.alias("death")
    )
    even = level % 2 == 0
    kinds = {"even": even, "odd": ~even}
    births = scan(
        births, slices, order=order, before={f"_until_{k}": ("max", F.when(own, F.col("death"))) for k, own in kinds.items()}
    )

    def counts(kind: str) -> Column:
        until = F.col(f"_until_{kind}")
        return F.col("stick") & kinds[kind] & (until.isNull() | (until <= turn))

    born = F.struct("turn", "level", "death")
    found = scan(births, slices, order=order, running={f"_{k}": ("max", F.when(counts(k), born)) for k in kinds})
    tops = {k: F.when(F.col(f"_{k}.death") > turn, level - F.col(f"_{k}.level")) for k in kinds}
    tops["even"] = F.when(F.col("deepest") >= 0, level).otherwise(tops["even"])
    return found.select(
        *INTERVAL,
        "lowest",
        F.when(even, tops["even"]).otherwise(tops["odd"]).alias("top_even"),
        F.when(even, tops["odd"]).otherwise(tops["even"]).alias("top_odd"),
    )


def state_values() -> Column:
    """The members of a possible set, rising."""

    def run(parity: int, top: str) -> Column:
        bottom = F.col("lowest") + F.when(F.col("lowest") % 2 == parity, 0).otherwise(1)
        return F.when(F.col(top) >= bottom, F.sequence(bottom, F.col(top), F.lit(2).cast("bigint")))

    none = F.array().cast("array<bigint>")
    return F.array_sort(
        F.concat(F.coalesce(run(0, "top_even"), none), F.coalesce(run(1, "top_odd"), none))
    )


# ------------------------------------------------------------------------ cells


def cells_of(closed: bool) -> Column:
    """The cells of a state as an array of structs: one for ``running_value``, those of both runs for ``possible_set``."""
    if closed:
        return F.array(F.struct(F.lit(0).alias("level"), F.col("value").alias("cell")))
    single = "coalesce(top_even, -1L) + coalesce(top_odd, -1L) = lowest - 1"
    return F.expr(
        f"CASE WHEN {single} THEN array(struct(0 AS level, lowest AS cell)) "
        f"ELSE concat({_run_cells(0, 'top_even')}, {_run_cells(1, 'top_odd')}) END"
    )


def value_cells(states: DataFrame) -> DataFrame:
    """States of ``running_value`` as cells: one each."""
    return states.withColumns({"level": F.lit(0), "cell": F.col("value")})


def set_cells(states: DataFrame) -> DataFrame:
    """States of ``possible_set_states`` as cells, one row per cell."""
    return states.withColumn("c", F.explode(cells_of(closed=False))).select("*", "c.level", "c.cell").drop("c")


def spread_level() -> Column:
    """An upper bound on the level of any cell of a possible set; 0 for a single value."""
    reach = F.greatest("top_even", "top_odd") - F.col("lowest")
    return F.floor(F.log2((floor_div(reach, F.lit(2).cast("bigint")) + 1).cast("double"))).cast("int")


def _run_cells(parity: int, top: str) -> str:
    """SQL for the aligned cells that cover every second value from the lowest one of that parity up to ``top``.

    Values of one parity are numbered first .. stop-1. On each level at most the outermost block on the left and on the
    right is not part of a larger aligned block inside the run; those blocks are the cells.
    """
    first = f"((lowest + IF(lowest % 2 = {parity}, 0, 1) - {parity}) div 2)"
    stop = f"(({top} - {parity}) div 2 + 1)"
    left = f"shiftright({first} + shiftleft(1L, n) - 1, n)"
    right = f"shiftright({stop}, n)"
    ends = f"array(IF({left} % 2 = 1, {left}, NULL), IF({right} % 2 = 1, {right} - 1, NULL))"
    blocks = f"IF({left} < {right}, array_compact({ends}), array())"
    levels = f"sequence(0, CAST(ceil(log2({stop} - {first} + 1)) AS INT))"
    cells = f"transform({levels}, n -> transform({blocks}, i -> struct(n AS level, i * 2 + {parity} AS cell)))"
    return f"IF({stop} > {first}, flatten({cells}), CAST(array() AS ARRAY<STRUCT<level: INT, cell: BIGINT>>))"


def cell_of(value: Column, level: Column) -> Column:
    """The cell of that level a value belongs to."""
    two = F.lit(2).cast("bigint")
    half = floor_div(value, two)
    return F.when(level == 0, value).otherwise(F.call_function("shiftright", half, level) * 2 + value % 2)


def cell_values(level: Column, cell: Column) -> Column:
    """All values of a cell."""
    two = F.lit(2).cast("bigint")
    parity = cell % 2
    index = floor_div(cell - parity, two)
    width = power_of_two(level)
    bottom = index * width * 2 + parity
    return F.when(level == 0, F.array(cell)).otherwise(F.sequence(bottom, bottom + (width - 1) * 2, two))


# ------------------------------------------------------------- run-encoded sets
#
# A set of values as an array of runs (low, high), each of every second value from low to high: the even runs and the odd
# runs, rising within each parity, none touching the next. So a set has one form, and its size does not show in it.


def block_of(level: Column, cell: Column) -> Column:
    """A cell as a run: its lowest and its highest value."""
    two = F.lit(2).cast("bigint")
    parity = cell % 2
    width = power_of_two(level)
    bottom = floor_div(cell - parity, two) * width * 2 + parity
    low = F.when(level == 0, cell).otherwise(bottom)
    high = F.when(level == 0, cell).otherwise(bottom + (width - 1) * 2)
    return F.struct(low.alias("low"), high.alias("high"))


def runs_of(blocks: Column | str) -> Column:
    """Any runs of one parity each, in any order, overlapping or not, as the one form of their union."""
    keyed = F.transform(
        blocks,
        lambda r: F.struct(F.pmod(r["low"], F.lit(2).cast("bigint")).alias("odd"), r["low"].alias("low"), r["high"].alias("high")),
    )
    none = F.array().cast("array<struct<odd: bigint, low: bigint, high: bigint>>")

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (last["odd"] == r["odd"]) & (r["low"] <= last["high"] + 2)
        longer = F.struct(last["odd"].alias("odd"), last["low"].alias("low"), F.greatest(last["high"], r["high"]).alias("high"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & joins, grown).otherwise(F.concat(done, F.array(r)))

    merged = F.aggregate(F.array_sort(keyed), none, add)
    return F.transform(merged, lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high")))


def run_union(first: Column | str, second: Column | str) -> Column:
    return runs_of(F.concat(first, second))


def run_holds(runs: Column | str, value: Column) -> Column:
    """Is the value a member?"""
    return F.exists(runs, lambda r: (r["low"] <= value) & (value <= r["high"]) & ((value - r["low"]) % 2 == 0))


def run_size(runs: Column | str) -> Column:
    """The number of members."""
    two = F.lit(2).cast("bigint")
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + floor_div(r["high"] - r["low"], two) + 1)


def run_values(runs: Column | str) -> Column:
    """The members, rising; the array is as long as the set."""
    return F.array_sort(F.flatten(F.transform(runs, lambda r: F.sequence(r["low"], r["high"], F.lit(2).cast("bigint")))))
