"""Running aggregates in time order within a key, split by time slice for hot items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stalemark.operators.slices import TimeSlices
from stalemark.schemas import ITEM

# How a running value is built, and how that of earlier slices joins it. All ignore nulls.
_BUILD = {"sum": F.sum, "max": F.max, "min": F.min}
_JOIN = {
    "sum": lambda own, earlier: F.coalesce(own + earlier, own, earlier),
    "max": F.greatest,
    "min": F.least,
}


def scan(
    df: DataFrame,
    slices: TimeSlices,
    *,
    order: Sequence[str],
    running: Mapping[str, tuple[str, Column]] | None = None,
    before: Mapping[str, tuple[str, Column]] | None = None,
    whole: Mapping[str, tuple[str, Column]] | None = None,
    keys: Sequence[str] = ITEM,
) -> DataFrame:
    """Add running aggregates to ``df``, which carries the ``slice`` and ``hot`` columns of ``slices.assign``.

    ``running`` covers the rows up to and including the own one, ``before`` those ahead of it, ``whole`` all rows of the
    key (for item keys only). Each is ``name -> (sum | max | min, column)``. The slice must not fall along ``order``.
    """
    running, before, whole = dict(running or {}), dict(before or {}), dict(whole or {})
    group = [*keys, "slice"] if slices else list(keys)  # a constant among the keys would cost an exchange of its own
    by_order = Window.partitionBy(*group).orderBy(*order)
    upto = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by_order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)

    local = df.withColumns(
        {name: _BUILD[how](col).over(upto) for name, (how, col) in running.items()}
        | {name: _BUILD[how](col).over(ahead) for name, (how, col) in before.items()}
    )
    if whole:
        local = local.withColumns({name: _BUILD[how](col).over(everything) for name, (how, col) in whole.items()})
    if not slices:
        return local

    hot_rows = df.where("hot")
    carried = {**running, **before}
    if carried:
        totals = hot_rows.groupBy(*group).agg(*[_BUILD[how](col).alias(name) for name, (how, col) in carried.items()])
        earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *group, *[_BUILD[how](F.col(name)).over(earlier).alias(f"carry_{name}") for name, (how, _) in carried.items()]
        )
        local = local.join(carry, group, "left")  # one row per hot key and slice; Spark picks the join by its size
        local = local.withColumns(
            {name: _JOIN[how](F.col(name), F.col(f"carry_{name}")) for name, (how, _) in carried.items()}
        ).drop(*[f"carry_{name}" for name in carried])
    if whole:
        totals = hot_rows.groupBy(*keys).agg(*[_BUILD[how](col).alias(f"all_{name}") for name, (how, col) in whole.items()])
        local = local.join(totals, list(keys), "left")
        local = local.withColumns(
            {name: F.coalesce(F.col(f"all_{name}"), F.col(name)) for name in whole}
        ).drop(*[f"all_{name}" for name in whole])
    return local
