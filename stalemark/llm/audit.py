"""How filters interact: what each of them removes alone, after others, and on average over all orders.

A byte transducer reads each text once. Two tables, by state and byte, give the next state and what to do: begin or end a
word, count a capital, a code point, a symbol. The spans of the words go into a hash table whose entries are compared byte
by byte, which counts the distinct ones. Batches of documents run through the tables together.

After that a document is a bit mask of the filters it fails, and all orders of the filters are read off the counts per
mask. Whether a text stands under a smaller id is settled per digest of the text (SHA-256) by minima that add up in any
order, so equal texts need not meet in one task.

Edge cases: a null text is an empty one, an empty text has no words and fails only what counts too few, and may be a copy
of another empty one; a null id is no smaller and no larger than any other, so its row neither is nor makes a copy; rows
repeated in full are no copies of each other (their id is not smaller), each counts; labels that repeat an id count if any
of them is 1; a null part is ''; texts of any length are read whole by one task; an empty table gives no rows; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stalemark.llm.frames import map_batches, text_of
from stalemark.llm.spans import Spans, first_equal
from stalemark.llm.texts import SPACE, Slice, slices

SYMBOLS = b"#$%&*|"
OUTSIDE, INSIDE = 0, 1
BEGIN, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
MEASURES = "n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long"
COPY = "copy"  # the column that says whether the text stands under a smaller id

#: What each filter fails, over the columns of ``MEASURES`` and ``COPY``.
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "n_symbols > 0",
    "E": COPY,
}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the actions, by state and byte."""
    step, act = np.zeros((2, 256), np.uint8), np.zeros((2, 256), np.uint8)
    for byte in range(256):
        always = (CAPITAL if 65 <= byte <= 90 else 0) | (SYMBOL if byte in SYMBOLS else 0)
        always |= 0 if 0x80 <= byte < 0xC0 else POINT  # continuation bytes of UTF-8 begin no code point
        for state in (OUTSIDE, INSIDE):
            step[state, byte] = OUTSIDE if SPACE[byte] else INSIDE
            turn = {(OUTSIDE, INSIDE): BEGIN, (INSIDE, OUTSIDE): END}.get((state, int(step[state, byte])), 0)
            act[state, byte] = always | turn
    return step, act


STEP, ACT = _tables()


def transduce(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The actions of each byte, and where words begin and end, over documents that each begin outside of a word.

    Both rows of ``STEP`` are equal: a byte alone decides the state after it. So the state before each byte is one lookup
    of its neighbour, and a batch runs through the tables without a loop over its bytes.
    """
    size = len(part.data)
    state = np.full(size, OUTSIDE, np.uint8)
    state[1:] = STEP[OUTSIDE, part.data[:-1]]
    first = part.bounds[:-1]
    state[first[first < size]] = OUTSIDE
    acts = ACT[state, part.data]
    ends = (acts & END) != 0
    last = part.bounds[1:][part.bounds[1:] > part.bounds[:-1]]  # a document that ends inside a word ends it
    cut = np.zeros(size + 1, bool)
    cut[:size] = ends
    cut[last[STEP[OUTSIDE, part.data[last - 1]] == INSIDE]] = True
    return acts, np.flatnonzero(acts & BEGIN), np.flatnonzero(cut)


def measures(part: Slice) -> list[np.ndarray]:
    """The columns of ``MEASURES`` for the documents of a slice."""
    acts, begins, ends = transduce(part)

    def per_document(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, part.bounds))

    spans = Spans(part.data, begins, ends)
    owners = np.searchsorted(part.bounds, begins, "right") - 1
    own = first_equal(spans, owners, spans.hashes(13)) == np.arange(len(spans))
    points = np.zeros(part.n, np.int64)
    full = np.flatnonzero(part.bounds[1:] > part.bounds[:-1])
    if len(full):
        points[full] = np.add.reduceat((acts & POINT) != 0, part.bounds[:-1][full], dtype=np.int64)
    return [
        per_document(begins),
        np.bincount(owners[own], minlength=part.n),
        per_document(np.flatnonzero(acts & CAPITAL)),
        points,
        per_document(np.flatnonzero(acts & SYMBOL)),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in MEASURES.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [measures(part) for part in slices(batch["text"])]
        columns = [np.concatenate(column).astype(np.int64) for column in zip(*parts)]
        yield pa.RecordBatch.from_arrays([batch["_row"], *map(pa.array, columns)], ["_row", *names])


def measured(docs: DataFrame, kept: Mapping[str, Column]) -> DataFrame:
    """The columns ``kept`` and those of ``MEASURES``, one row per document."""
    rows = docs.select(F.struct(*(column.alias(name) for name, column in kept.items())).alias("_row"), F.col("text"))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, {MEASURES}"
    return map_batches(rows, _measured, schema).select("_row.*", *(m.split()[0] for m in MEASURES.split(", ")))


def mask_of(filters: Mapping[str, str]) -> Column:
    """The filters that a row fails, as bits in their order."""
    bits = [F.when(F.expr(fails), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    return sum(bits[1:], bits[0]).cast("int")


def failed_masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """(part, mask): ``n`` documents that fail exactly the filters of the mask, ``n_good`` and ``n_toxic`` of them.

    ``labels`` has doc_id, quality, toxic. Rows are counted by id before labels join them, and by text before copies are
    told apart, so that an id or a text of very many rows stays small.
    """
    kept = {
        "doc_id": F.col("doc_id"),
        "part": F.coalesce(F.col(f"`{part}`"), F.lit("")),
        "digest": F.unhex(F.sha2(text_of(F.col("text")).cast("binary"), 256)),
    }
    rows = measured(docs, kept)
    both = rows.withColumn(COPY, F.lit(False)).withColumn("first", mask_of(filters))
    both = both.withColumn(COPY, F.lit(True)).withColumn("again", mask_of(filters))
    each = both.select("doc_id", "part", "digest", "first", "again")
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    by_id = each.groupBy("doc_id", "part", "digest", "first", "again").agg(F.count("*").alias("n"))
    by_id = by_id.join(marked, "doc_id", "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "part", "first", "again", "good", "toxic"]
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_no_id"),
        F.min("doc_id").alias("least"),
        F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), "doc_id").alias("n_least"),
    )
    # A digest has a row per part, and per kind of label.
    original = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    firsts = F.col("n_no_id") + F.when(original, F.col("n_least")).otherwise(0)
    told = by_text.withColumn("n_first", firsts).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("first").alias("mask"), F.col("n_first").alias("n")),
            F.struct(F.col("again").alias("mask"), (F.col("n") - F.col("n_first")).alias("n")),
        )),
    )
    return told.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
    )


def orders_of(masks: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step) with what the step's filter does there, out of the counts per mask.

    The Shapley value of a filter is what it removes over all orders. Of the filters that a document fails, each comes
    first in an equal share of the orders, and the first one removes it.
    """
    orders = list(permutations(range(len(names))))
    steps = [
        F.struct(
            F.lit("".join(names[i] for i in order)).alias("filter_order"),
            F.lit(at + 1).alias("step"),
            F.lit(1 << f).alias("own"),
            F.lit(sum(1 << e for e in order[:at])).alias("earlier"),
        )
        for order in orders
        for at, f in enumerate(order)
    ]
    mask = F.col("mask")
    there = mask.bitwiseAND(F.col("earlier")) == 0
    fails = mask.bitwiseAND(F.col("own")) != 0

    def total(condition: Column, of: Column = F.col("n")) -> Column:
        return F.coalesce(F.sum(F.when(condition, of)), F.lit(0)).cast("long")

    share = F.col("n") * F.call_function("div", F.lit(len(orders)), F.greatest(F.bit_count(mask), F.lit(1)))
    return (
        masks.select("*", F.inline(F.array(*steps)))
        .groupBy("part", "filter_order", "step")
        .agg(
            total(there & ~fails).alias("kept"),
            total(there & fails).alias("removed"),
            total(~there & fails).alias("redundant"),
            total(mask == F.col("own")).alias("unique_fails"),
            total(there & fails, F.col("n_good")).alias("good_lost"),
            total(there & fails, F.col("n_toxic")).alias("toxic_lost"),
            total(fails, share).alias("shapley"),
        )
    )


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: documents kept, removed, redundantly failing, lost."""
    return orders_of(failed_masks(docs, labels, filters, part), "".join(filters))
