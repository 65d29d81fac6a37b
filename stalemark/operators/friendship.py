"""Applying a log of friendship operations to the edge table, and lists as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stalemark.operators.scans import scan
from stalemark.operators.slices import TimeSlices, measure_slices
from stalemark.operators.social import CONFIRMED, PENDING

EDGE = ("owner", "other", "kind")
LONGEST = 100_000
# What each operation does, as (list's owner is, kind of list, entry is set or cleared). The entry is the
# other of the two.
EFFECTS = {
    "invite": [("invitee", PENDING, True)],
    "accept": [
        ("inviter", CONFIRMED, True),
        ("invitee", CONFIRMED, True),
        ("inviter", PENDING, False),
        ("invitee", PENDING, False),
    ],
    "reject": [("invitee", PENDING, False)],
    "thaw": [("inviter", CONFIRMED, False), ("invitee", CONFIRMED, False)],
}
# Operations refused for negative ids. An invitation is not checked.
GUARDED = ("accept", "reject", "thaw")


def _effects() -> Column:
    other = {"inviter": "invitee", "invitee": "inviter"}
    chosen = None
    for op, effects in EFFECTS.items():
        facts = F.array(
            *[
                F.struct(
                    F.col(owner).alias("owner"),
                    F.col(other[owner]).alias("other"),
                    F.lit(kind).alias("kind"),
                    F.lit(on).alias("on"),
                )
                for owner, kind, on in effects
            ]
        )
        chosen = F.when(F.col("op") == op, facts) if chosen is None else chosen.when(F.col("op") == op, facts)
    return chosen


def accepted_ops(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations that run, and those refused: status ERROR for a negative id, SELF for a pair of one user, UNKNOWN for an
    operation there is not.
    """
    negative = F.coalesce((F.col("inviter") < 0) | (F.col("invitee") < 0), F.lit(False))
    known = F.coalesce(F.col("op").isin(*EFFECTS), F.lit(False))
    status = F.when(~known, "UNKNOWN").when(F.col("op").isin(*GUARDED) & negative, "ERROR")
    status = status.when(F.col("inviter") == F.col("invitee"), "SELF")
    return ops.where(status.isNull()), ops.withColumn("status", status).where(F.col("status").isNotNull())


def edge_facts(ops: DataFrame) -> DataFrame:
    """Each operation as the list entries it sets or clears: (op_seq, owner, other, kind, on)."""
    ok, _ = accepted_ops(ops)
    return ok.select("op_seq", F.explode(_effects()).alias("e")).select("op_seq", "e.*")


def apply_friendship_ops(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """The edges after all operations, in ``op_seq`` order.

    Lists are sets here: every operation states what an entry is from then on, so the last one to touch it decides. That
    is one aggregation, with the deciding operation picked ahead of the shuffle.
    """
    before = edges.select(F.lit(-1).cast("bigint").alias("op_seq"), *EDGE, F.lit(True).alias("on"))
    facts = before.unionByName(edge_facts(ops))
    last = facts.groupBy(*EDGE).agg(F.max_by("on", "op_seq").alias("on"))
    return last.where("on").drop("on")


def count_friendship_ops(edges: DataFrame, ops: DataFrame, slices: TimeSlices | None = None) -> DataFrame:
    """Like ``apply_friendship_ops`` with lists as bags: ``n`` is how often the entry is on the list.

    Setting an entry adds one, clearing it takes one away if there is one. That is a walk of +1 and -1 with a floor at 0,
    and where it ends is the free walk's end minus its deepest point below 0.
    """
    facts = edge_facts(ops).select("op_seq", *EDGE, F.when(F.col("on"), 1).otherwise(-1).cast("bigint").alias("step"))
    before = edges.groupBy(*EDGE).agg(F.count("*").alias("step"))
    facts = before.select(F.lit(-1).cast("bigint").alias("op_seq"), *EDGE, "step").unionByName(facts)
    if slices is None:
        slices = measure_slices([facts], time="op_seq", keys=EDGE)
    walk = scan(
        slices.assign(facts, F.col("op_seq"), EDGE),
        slices,
        order=["op_seq"],
        running={"at": ("sum", F.col("step"))},
        keys=EDGE,
    )
    ended = walk.groupBy(*EDGE).agg(F.max_by("at", "op_seq").alias("end"), F.min("at").alias("dip"))
    return ended.select(*EDGE, (F.col("end") - F.least(F.lit(0), F.col("dip"))).alias("n")).where("n > 0")


def friend_lists(edges: DataFrame, longest: int = LONGEST, slices: TimeSlices | None = None) -> DataFrame:
    """Edges as arrays: ``ConfFriends`` and ``PendFriends`` per owner and ``part``, rising.

    Part 0 holds the first ``longest`` entries of either list, part 1 the next, and so on, whatever the length.
    """
    return ordered_lists(
        edges,
        ["owner"],
        ["kind"],
        ["other"],
        longest,
        {
            "ConfFriends": F.when(F.col("kind") == CONFIRMED, F.col("other")),
            "PendFriends": F.when(F.col("kind") == PENDING, F.col("other")),
        },
        slices,
    )


def ordered_lists(
    df: DataFrame,
    keys: Sequence[str],
    kinds: Sequence[str],
    order: Sequence[str],
    longest: int,
    lists: dict[str, Column],
    slices: TimeSlices | None = None,
) -> DataFrame:
    """Sorted lists per key, cut after every ``longest`` rows of a kind in ``order``; ``part`` counts the cuts.

    Positions come from a scan, which slices long lists by the first column of ``order``, so no task holds one whole.
    """
    group = [*keys, *kinds]
    if slices is None:
        slices = measure_slices([df], time=order[0], keys=group)
    ranked = scan(
        slices.assign(df, F.col(order[0]), group),
        slices,
        order=order,
        running={"_position": ("sum", F.lit(1).cast("bigint"))},
        keys=group,
    )
    placed = ranked.withColumn("part", F.floor((F.col("_position") - 1) / longest).cast("int"))
    return placed.groupBy(*keys, "part").agg(
        *[F.array_sort(F.collect_list(column)).alias(name) for name, column in lists.items()]
    )


def group_by_item(
    rows: DataFrame, keys: Sequence[str], entry: Sequence[str], longest: int = LONGEST, slices: TimeSlices | None = None
) -> DataFrame:
    """All log entries of an item as sorted lists of structs; ``part`` 0 holds the first ``longest``, and so on."""
    return ordered_lists(rows, keys, [], entry, longest, {"entries": F.struct(*entry)}, slices)
