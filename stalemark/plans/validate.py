"""Which reads returned a value they could legally have returned?

``validate_reads`` gives a verdict per read, ``judge_spans`` one per distinct (item, interval, value) with the number of
reads that share it, and ``possible_values`` the values themselves. Copies of a read collapse before any shuffle by item.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stalemark.functions.columns import COPIES, copies, is_collapsed, starting_value
from stalemark.operators import matching, states
from stalemark.operators.slices import TimeSlices, measure_slices
from stalemark.schemas import INITIAL, ITEM
from stalemark.session import write_through
from stalemark.sources import logs

INTERVAL = (*ITEM, "start_ns", "end_ns")
SEMANTICS = ("possible_set", "running_value")


def filter_validatable(reads: DataFrame, initial: Mapping[str, int] = INITIAL) -> DataFrame:
    """Reads of the validated counters, by a name contained in the attribute."""
    wanted = F.lit(False)
    for name in initial:
        wanted = wanted | F.col("attribute").contains(name)
    return reads.where(wanted)


def filter_attribute(updates: DataFrame, attribute: str) -> DataFrame:
    """Updates whose attribute contains the given name."""
    return updates.where(F.col("attribute").contains(attribute))


def project_intervals(rows: DataFrame, payload: str) -> DataFrame:
    """Only what validation needs: item, interval, and ``op`` or ``value``."""
    return rows.select(*INTERVAL, payload)


def usable(closed: bool) -> Column:
    """Does the convention allow the interval? Never null."""
    there = F.col("key").isNotNull() & F.col("attribute").isNotNull()
    order = F.col("start_ns") <= F.col("end_ns") if closed else F.col("start_ns") < F.col("end_ns")
    return there & F.coalesce(order, F.lit(False))


def split_intervals(rows: DataFrame, closed: bool) -> tuple[DataFrame, DataFrame]:
    """Logs whose interval the convention allows, and the rejected rest with a reason."""
    missing = F.lit(False)
    for name in INTERVAL:
        missing = missing | F.col(name).isNull()
    backwards = F.col("start_ns") > F.col("end_ns")
    reason = F.when(missing, "missing_field").when(backwards, "start_after_end").otherwise("empty_interval")
    return rows.where(usable(closed)), rows.where(~usable(closed)).withColumn("reason", reason)


def split_reads(
    reads: DataFrame, semantics: str, initial: Mapping[str, int] = INITIAL
) -> tuple[DataFrame, DataFrame]:
    """Reads that get a verdict, and the refused rest with a reason: the interval, no value, or an unknown attribute."""
    ok, refused = split_intervals(reads, closed=True)
    return ok.where(_judged(semantics, initial)), refused.unionByName(_without_verdict(ok, semantics, initial))


def _judged(semantics: str, initial: Mapping[str, int]) -> Column:
    """Does a read with a usable interval get a verdict?"""
    has_value = F.col("value").isNotNull()
    return has_value if _closed(semantics) else has_value & F.col("attribute").isin(*initial)


def _without_verdict(ok: DataFrame, semantics: str, initial: Mapping[str, int]) -> DataFrame:
    reason = F.when(F.col("value").isNull(), "no_value")
    if not _closed(semantics):
        reason = reason.when(~F.col("attribute").isin(*initial), "unknown_attribute")
    return ok.withColumn("reason", reason).where(reason.isNotNull())


def collapse_logs(reads: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What validation needs of both logs, equal rows as one with their number in ``n_copies``, written once.

    Logs may be text that is costly to parse, and every question scans them again: how many rows an item has, what is
    valid, how many updates there were. The functions of this module take the collapsed logs in place of the logs.
    Rows without a usable interval stay, so counts and rejects are the same.
    """
    none = F.lit(None)
    both = reads.select(*INTERVAL, F.lit(True).alias("is_read"), F.col("value").cast("bigint").alias("value"), none.cast("string").alias("op"))
    both = both.unionByName(updates.select(*INTERVAL, F.lit(False).alias("is_read"), none.cast("bigint").alias("value"), "op"))
    table = write_through(both.groupBy(*both.columns).agg(F.count("*").alias(COPIES)), "collapsed-logs")
    return (
        table.where("is_read").select(*INTERVAL, "value", COPIES),
        table.where("NOT is_read").select(*INTERVAL, "op", COPIES),
    )


def _closed(semantics: str) -> bool:
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}, not {semantics!r}")
    return semantics == "running_value"


def _inputs(
    reads: DataFrame, updates: DataFrame, semantics: str, initial: Mapping[str, int], slices: TimeSlices | None
) -> tuple[DataFrame, DataFrame, TimeSlices]:
    """Usable reads and updates. ``possible_set`` knows only attributes with a starting value; reads may be empty."""
    closed = _closed(semantics)
    reads, updates = reads.where(usable(closed=True)), updates.where(usable(closed))
    if not closed:
        reads = reads.where(F.col("attribute").isin(*initial))
        updates = filter_validatable(updates, initial)
    if slices is None:
        slices = measure_slices([reads, updates])
    return reads, updates, slices


def _start(semantics: str, initial: Mapping[str, int]) -> Column:
    return starting_value(F.col("attribute"), initial, 0 if _closed(semantics) else None)


def update_states(updates: DataFrame, semantics: str, slices: TimeSlices, initial: Mapping[str, int]) -> DataFrame:
    """The states of an item after each distinct update interval, under either semantics."""
    make = states.running_value if _closed(semantics) else states.possible_set_states
    return make(updates, slices, initial)


def _probes(semantics: str) -> Column:
    """The spans whose updates a read may see, as structs: its own, the one before it, and past the end the highest one."""
    own = F.struct(F.col("start_ns").alias("from"), F.col("end_ns").alias("to"))
    anchor = F.when(
        F.col("anchor_end").isNotNull(), F.struct(F.col("anchor_start").alias("from"), F.col("anchor_end").alias("to"))
    )
    spans = [own, anchor]
    if semantics == "running_value":
        late = F.col("start_ns") > F.col("highest_end")
        spans.append(F.when(late, F.struct(F.col("highest_start").alias("from"), F.col("highest_end").alias("to"))))
    return F.array_distinct(F.array_compact(F.array(*spans)))


def _sees_start(semantics: str) -> Column:
    """May the read see the starting value? If nothing ended before it or, under running_value, nothing began before it."""
    none_before = F.col("anchor_end").isNull()
    if semantics == "possible_set":
        return none_before
    return none_before | (F.col("start_ns") <= F.col("lowest_start"))


def judge_spans(
    reads: DataFrame,
    updates: DataFrame,
    semantics: str,
    initial: Mapping[str, int] = INITIAL,
    slices: TimeSlices | None = None,
) -> DataFrame:
    """A verdict per distinct (item, interval, value read): ``valid``, ``n_reads``, ``has_updates``.

    Candidates are never listed. A read is valid if some update whose state holds the value overlaps one of its spans, and
    that is decided by running maxima per item and cell, so the work stays linear however many updates run at once.
    """
    reads, updates, slices = _inputs(reads, updates, semantics, initial, slices)
    closed = _closed(semantics)
    reads = reads.where(F.col("value").isNotNull())
    value = F.col("value").cast("bigint").alias("value")
    if is_collapsed(reads):
        distinct = reads.select(*INTERVAL, value, F.col(COPIES).alias("n_reads"))
    else:
        distinct = reads.groupBy(*INTERVAL, value).agg(F.count("*").alias("n_reads"))
    after = update_states(updates, semantics, slices, initial).withColumn("cells", states.cells_of(closed))
    # One timeline of reads and states per item, dealt by item once; every step below keeps the rows where they are.
    distinct = distinct.repartition(*ITEM)
    carry = ["start_ns", "end_ns", "cells"]
    if closed:
        timeline = matching.anchor_running(distinct, after, slices, carry).withColumn("top_level", F.lit(0))
        has_updates = F.col("lowest_start").isNotNull()
    else:
        timeline = matching.anchor_possible(
            distinct,
            after.withColumn("spread", states.spread_level()),
            slices,
            whole={"top_level": ("max", F.col("spread")), "known": ("max", ~F.col("is_read"))},
            carry=[*carry, "spread"],
        )
        has_updates = F.col("known")
    from_start = _sees_start(semantics) & (F.col("value") == _start(semantics, initial))
    rows = timeline.select(
        *INTERVAL, "value", "n_reads", "is_read", from_start.alias("from_start"), has_updates.alias("has_updates"),
        F.explode(F.when(F.col("is_read"), _asked_cells(semantics)).otherwise(_held_cells(closed))).alias("e"),
    ).select("*", "e.*")
    swept = matching.sweep_overlaps(rows, slices, closed, (*ITEM, "level", "cell"), ("from", "to"), "is_read")
    return swept.groupBy(*INTERVAL, "value").agg(
        F.bool_or(F.col("hit") | F.col("from_start")).alias("valid"),
        F.max("n_reads").alias("n_reads"),
        F.bool_or("has_updates").alias("has_updates"),
    )


def _asked_cells(semantics: str) -> Column:
    """Per span that a read may see and per level, the cell its value lies in, as (from, to, level, cell)."""
    levels = F.sequence(F.lit(0), F.coalesce(F.col("top_level"), F.lit(0)))

    def asked(span: Column) -> Column:
        return F.transform(
            levels,
            lambda n: F.struct(
                span["from"].alias("from"), span["to"].alias("to"), n.alias("level"),
                states.cell_of(F.col("value"), n).alias("cell"),
            ),
        )

    return F.flatten(F.transform(_probes(semantics), asked))


def _held_cells(closed: bool) -> Column:
    """The cells of a state with its interval, in the same shape; an empty half-open interval is seen by nothing."""
    held = F.transform(
        "cells",
        lambda c: F.struct(
            F.col("start_ns").alias("from"), F.col("end_ns").alias("to"), c["level"].alias("level"), c["cell"].alias("cell")
        ),
    )
    return held if closed else F.filter(held, lambda c: c["from"] < c["to"])


def possible_values(
    reads: DataFrame,
    updates: DataFrame,
    semantics: str,
    initial: Mapping[str, int] = INITIAL,
    slices: TimeSlices | None = None,
) -> DataFrame:
    """Per distinct (item, interval) of the reads, the rising array of values such a read may return."""
    runs = possible_runs(reads, updates, semantics, initial, slices)
    return runs.select(*INTERVAL, states.run_values("runs").alias("possible_values"))


def possible_runs(
    reads: DataFrame,
    updates: DataFrame,
    semantics: str,
    initial: Mapping[str, int] = INITIAL,
    slices: TimeSlices | None = None,
) -> DataFrame:
    """The same sets as ``runs``, whose length does not grow with the number of values: see ``states.runs_of``."""
    reads, updates, slices = _inputs(reads, updates, semantics, initial, slices)
    return _runs_of(reads.select(*INTERVAL).distinct(), updates, semantics, initial, slices, own=True)


def state_before(
    reads: DataFrame,
    updates: DataFrame,
    semantics: str,
    initial: Mapping[str, int] = INITIAL,
    slices: TimeSlices | None = None,
) -> DataFrame:
    """Per distinct (item, interval) of the reads, only the values that come from before the read."""
    reads, updates, slices = _inputs(reads, updates, semantics, initial, slices)
    runs = _runs_of(reads.select(*INTERVAL).distinct(), updates, semantics, initial, slices, own=False)
    return runs.select(*INTERVAL, states.run_values("runs").alias("possible_values"))


def anchored(distinct: DataFrame, after: DataFrame, semantics: str, slices: TimeSlices) -> DataFrame:
    """Reads with the span that the state before them is taken from."""
    anchor = matching.anchor_running if _closed(semantics) else matching.anchor_possible
    return anchor(distinct, after, slices)


def _runs_of(
    distinct: DataFrame, updates: DataFrame, semantics: str, initial: Mapping[str, int], slices: TimeSlices, own: bool
) -> DataFrame:
    closed = _closed(semantics)
    after = update_states(updates, semantics, slices, initial)
    cells = states.value_cells(after) if closed else states.set_cells(after)
    placed = anchored(distinct.repartition(*ITEM), after, semantics, slices)
    if own:
        spans, sees_start = _probes(semantics), _sees_start(semantics)
    else:
        before = F.struct(F.col("anchor_start").alias("from"), F.col("anchor_end").alias("to"))
        sees_start = F.col("anchor_end").isNull()
        # A read without an anchor keeps a span of its own so that its row survives; nothing is looked up for it.
        spans = F.array(F.when(~sees_start, before))
    asked = placed.select(*INTERVAL, sees_start.alias("sees_start"), F.explode(spans).alias("span")).select(
        *INTERVAL, "sees_start", F.col("span.from").alias("from"), F.col("span.to").alias("to")
    )
    # Meeting the spans with merged runs of updates costs no more than the cells that make the result.
    runs = matching.merge_runs(cells, slices)
    found = matching.overlap_join(asked, runs, closed, slices=slices, span=("from", "to"), keep_left=True)
    start = _start(semantics, initial)
    block = states.block_of(F.col("update_level"), F.col("update_cell"))
    held = found.groupBy(*INTERVAL).agg(
        F.collect_set(F.when(F.col("update_cell").isNotNull(), block)).alias("held"), F.bool_or("sees_start").alias("sees_start")
    )
    own_start = F.when(F.col("sees_start"), F.array(F.struct(start.alias("low"), start.alias("high"))))
    blocks = F.concat("held", F.coalesce(own_start, F.array().cast("array<struct<low: bigint, high: bigint>>")))
    return held.select(*INTERVAL, states.runs_of(blocks).alias("runs"))


def validate_reads(
    reads: DataFrame,
    updates: DataFrame,
    semantics: str,
    initial: Mapping[str, int] = INITIAL,
    slices: TimeSlices | None = None,
    with_values: bool = False,
) -> DataFrame:
    """Reads with ``valid``, and on request the ``possible_values`` it was judged by.

    Reads without a verdict (interval missing or backwards, no value, an attribute without a starting value) are left out
    in either form; ``split_reads`` gives them with a reason.
    """
    reads = reads.where(usable(closed=True) & _judged(semantics, initial))
    if with_values:
        runs = possible_runs(reads, updates, semantics, initial, slices)
        judged = reads.join(runs, list(INTERVAL)).withColumn("valid", states.run_holds("runs", F.col("value").cast("bigint")))
        return judged.withColumn("possible_values", states.run_values("runs")).select(*reads.columns, "possible_values", "valid")
    verdicts = judge_spans(reads, updates, semantics, initial, slices).drop("n_reads").withColumnRenamed("value", "_value")
    return reads.withColumn("_value", F.col("value").cast("bigint")).join(verdicts, [*INTERVAL, "_value"]).drop("_value")


def valid_only(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("valid")


def stale_only(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("not valid")


# ----------------------------------------------------------------------- report


def update_counts(reads: DataFrame, updates: DataFrame) -> DataFrame:
    """One row: all updates, and the updates of items that were read."""
    both = updates.select(*ITEM, copies(updates).alias("n"), F.lit(False).alias("was_read")).unionByName(
        reads.select(*ITEM, F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("was_read"))
    )
    known = F.col("key").isNotNull() & F.col("attribute").isNotNull()  # no name, no item
    counted = both.groupBy(*ITEM).agg(F.sum("n").alias("n"), F.bool_or(F.col("was_read") & known).alias("was_read"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_updates"),
        F.coalesce(F.sum(F.when(F.col("was_read"), F.col("n"))), F.lit(0)).alias("processed_updates"),
    )


def staleness_report(verdicts: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of counts and fractions from ``judge_spans`` and ``update_counts``; fractions are null without reads."""
    n = F.col("n_reads")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    sums = verdicts.agg(
        total(F.lit(True)).alias("total_reads"),
        total(F.col("valid")).alias("correct_reads"),
        total(~F.col("valid")).alias("stale_reads"),
        total(~F.col("valid") & F.col("has_updates")).alias("stale_reads_with_updates"),
    )
    both = sums.unionByName(counts, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    correct = F.try_divide(F.col("correct_reads").cast("double"), F.col("total_reads"))
    stale = F.try_divide(F.col("stale_reads").cast("double"), F.col("total_reads"))
    return both.select(
        "total_reads",
        "total_updates",
        "processed_updates",
        "correct_reads",
        "stale_reads",
        "stale_reads_with_updates",
        correct.alias("correct_fraction"),
        stale.alias("stale_fraction"),
        (correct * 100.0).alias("correct_percent"),
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The report as lines of text, one per figure, ready for a text sink."""
    figures = [(i, name) for i, name in enumerate(report.columns, 1)]
    kinds = dict(report.dtypes)
    lines = [
        F.struct(
            F.lit(i).alias("line"),
            F.lit(name).alias("figure"),
            (F.format_string("%.6f", name) if kinds[name] == "double" else F.col(name).cast("string")).alias("amount"),
        )
        for i, name in figures
    ]
    return report.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def write_report(report: DataFrame, path: str) -> None:
    """The report as text at ``path``, one "figure: amount" per line; the previous one there is replaced."""
    lines = report_lines(report).select(F.concat_ws(": ", "figure", F.coalesce("amount", F.lit("none"))))
    lines.write.mode("overwrite").text(path)


def report_of(reads: DataFrame, updates: DataFrame, semantics: str, initial: Mapping[str, int] = INITIAL) -> DataFrame:
    """Verdicts and counts of reads and updates as one report. Both logs are read once."""
    if not (is_collapsed(reads) and is_collapsed(updates)):
        reads, updates = collapse_logs(reads, updates)
    return staleness_report(judge_spans(reads, updates, semantics, initial), update_counts(reads, updates))


def report_directory(
    spark: SparkSession, path: str, semantics: str, initial: Mapping[str, int] = INITIAL, with_rejects: bool = False
) -> DataFrame:
    """The report of a directory of read and update logs: scan, parse, validate.

    With ``with_rejects`` it also says how many lines of either log are none (``rejected_reads``, ``rejected_updates``);
    ``logs.parse_logs`` gives the lines themselves with a reason.
    """
    reads, bad_reads = logs.parse_logs(logs.scan_logs(spark, path, "read"))
    updates, bad_updates = logs.parse_logs(logs.scan_logs(spark, path, "update"))
    report = report_of(reads, updates, semantics, initial)
    if not with_rejects:
        return report
    bad = bad_reads.select(F.lit(True).alias("read")).unionByName(bad_updates.select(F.lit(False).alias("read")))
    counts = bad.agg(F.count_if("read").alias("rejected_reads"), F.count_if(~F.col("read")).alias("rejected_updates"))
    both = report.unionByName(counts, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# ---------------------------------------------------------------------- by item


def attach_updates(reads: DataFrame, updates: DataFrame) -> DataFrame:
    """All reads, each with the number of updates of its item (0 if none). Pairs are made by the overlap join only."""
    per_item = updates.groupBy(*ITEM).agg(F.count("*").alias("n"))
    joined = reads.join(per_item, list(ITEM), "left")
    return joined.withColumn("n_updates", F.coalesce("n", F.lit(0))).drop("n")
