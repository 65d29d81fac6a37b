"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, closed: bool) -> Column:
    """Do two intervals share a point? Closed ones touch at an end; an empty half-open one shares nothing."""
    if closed:
        return (a_start <= b_end) & (b_start <= a_end)
    return (a_start < b_end) & (b_start < a_end) & (a_start < a_end) & (b_start < b_end)


def holds_point(start: Column, end: Column, point: Column) -> Column:
    """Does the closed interval contain the point?"""
    return point.between(start, end)


def key_type(attribute: Column) -> Column:
    """The kind of key an attribute is counted under."""
    return F.when(attribute == "POSTCOMMENT", F.lit("resourceID")).otherwise(F.lit("userID"))


def is_user_key(kind: Column) -> Column:
    return kind.contains("user")


def is_resource_key(kind: Column) -> Column:
    return kind.contains("resource")


def starting_value(attribute: Column, initial: Mapping[str, int], default: int | None = None) -> Column:
    """The value an attribute has before any update; null (or ``default``) for attributes without one."""
    chosen = F.lit(default).cast("bigint")
    for name, value in initial.items():
        chosen = F.when(attribute == name, F.lit(value).cast("bigint")).otherwise(chosen)
    return chosen


def power_of_two(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent.cast("int"))


def floor_div(value: Column, width: Column) -> Column:
    """Integer quotient; never decreases as the value grows, which is all that bucketing needs."""
    return F.call_function("div", value, width)


COPIES = "n_copies"


def is_collapsed(rows: DataFrame) -> bool:
    """Do the rows stand for several equal ones each, by a column ``n_copies``?"""
    return COPIES in rows.columns


def copies(rows: DataFrame) -> Column:
    """How many log rows a row stands for."""
    return F.col(COPIES) if is_collapsed(rows) else F.lit(1).cast("bigint")
