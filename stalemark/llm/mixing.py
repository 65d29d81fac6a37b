"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source is a circle of its words, documents in a seeded order. Blocks of ``BLOCK_WORDS`` words go to sources by the
highest quotients target / (2k + 1), for every shard in turn, so each source has an integer quota of blocks per shard.
A source's blocks are then one run along its circle from a seeded place; a run longer than the circle repeats it.
Which words of which document are taken is arithmetic on the document's place, so no block becomes a row.

Edge cases: a null text has no words and is never taken; a null source is a source of its own, ordered last; repeated
rows are documents of their own; an empty table gives an empty result. A column of the input that is called as an output
column is replaced by it. Rows equal in doc_id and text may swap places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stalemark.llm.frames import WORD, text_of, unwrapped, wrapped, write_through
from stalemark.llm.ranks import add_running, bits_for

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 16
SHARDS = 8
SEED = 20


def source_targets(sizes: DataFrame, weights: Sequence[float], most_repeats: float, share: float) -> DataFrame:
    """Add ``rank`` and ``target`` to (source, source_size): ``share`` of all words by weight, none above its cap.

    Sources at their cap keep it and the rest is shared again by weight. With sources in the order of cap by weight, the
    capped ones come first, so one running sum finds where they end. The table has one row per source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(rest))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = level.withColumn("shared", F.max(F.when(fits, F.struct(-F.col("cap") / F.col("weight"), -F.col("rank"), "level"))).over(everything)["level"])
    capped = F.col("shared").isNull() | (F.col("shared") * F.col("weight") > F.col("cap"))
    return level.select(
        "source", "source_size", "rank", F.when(capped, F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target")
    )


def block_quotas(targets: DataFrame, block_words: int, shards: int) -> DataFrame:
    """Add ``cuts``: blocks of the source in the first 0, 1, ... ``shards`` shards, by highest quotients.

    A larger house never takes a seat from anyone, so the differences are the quotas of each shard. Seats that a slightly
    too large divisor already grants need no ranking; the quotients of the few seats above are ranked.
    """
    everything = Window.partitionBy()
    n, total = F.count(F.lit(1)).over(everything), F.sum("target").over(everything)
    houses = targets.select("*", n.alias("n"), total.alias("total"), F.floor(total / block_words).alias("seats"))
    houses = houses.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    houses = houses.withColumn("house", F.floor(F.col("seats") * F.col("shard") / shards))
    sure = F.col("house") - F.col("n") / 2
    exact = F.when((sure > 0) & (F.col("total") > 0), F.col("target") / F.col("total") * sure).otherwise(0.0)
    houses = houses.withColumn("base", F.floor(exact + 0.5))
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    more = F.least(F.col("house"), F.ceil(share * (F.col("n") * 1.5 + 1)) + 1).cast("int")
    # Seats 0 .. more - 1 above the base; a source without words asks for none.
    seats = houses.withColumn("k", F.explode_outer(F.when((more > 0) & (F.col("target") > 0), F.sequence(F.lit(0), more - 1))))
    quotient = F.col("target") / (2 * (F.col("base") + F.col("k")) + 1)
    by_house = Window.partitionBy("shard")
    place = F.row_number().over(by_house.orderBy(quotient.desc_nulls_last(), "rank"))
    base = F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, F.col("base"))).over(by_house)
    seats = seats.withColumn("won", F.col("k").isNotNull() & (place <= F.col("house") - base))
    quotas = seats.groupBy("source", "source_size", "rank", "target", "shard").agg(
        (F.max("base") + F.sum(F.col("won").cast("long"))).alias("quota")
    )
    by_shard = F.sort_array(F.collect_list(F.struct("shard", "quota")))
    return quotas.groupBy("source", "source_size", "rank", "target").agg(
        F.concat(F.array(F.lit(0).cast("long")), F.transform(by_shard, lambda x: x["quota"].cast("long"))).alias("cuts")
    )


def taken_spans(begin: Column, size: Column, circle: Column, start: Column, cuts: Column, block_words: int, most_repeats: int, shards: int) -> Column:
    """Spans of a document's words that the source's run covers: (shard, first word, word after the last)."""
    parts = []
    for turn in range(most_repeats + 1):
        for shard in range(shards):
            low, high = (F.least(cuts[s] * block_words, circle * most_repeats) + start for s in (shard, shard + 1))
            here = begin + circle * turn
            parts.append(F.struct(F.lit(shard).alias("shard"), (F.greatest(low, here) - here).alias("first"), (F.least(high, here + size) - here).alias("last")))
    return F.filter(F.array(*parts), lambda x: x["first"] < x["last"])


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """Add to documents (doc_id, text, source): ``size`` in words, ``source_size``, the source's ``target``, ``taken``
    words with repeats, and ``spans``, the taken words as (shard, first, last).

    Sources in code point order, null last, weigh ``weights`` in turn. ``share`` is that of all words to take.
    """
    row = F.col("_row")
    size = F.regexp_count(text_of(row["text"]), F.lit(WORD)).cast("long")
    key = F.xxhash64(F.lit(seed), row["doc_id"], row["text"])
    sized = wrapped(docs).select("_row", row["source"].alias("_source"), size.alias("_size"), key.alias("_key"), row["doc_id"].alias("_id"))
    sizes = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    quotas = write_through(block_quotas(source_targets(sizes, weights, most_repeats, share), block_words, shards), "quotas")
    placed = add_running(sized, ["_source"], ["_key", "_id"], bits_for(docs.count()), {"_begin": F.col("_size")})
    joined = placed.join(quotas, F.col("_source").eqNullSafe(F.col("source")), "left")
    start = F.when(F.col("source_size") > 0, F.pmod(F.xxhash64(F.lit(seed + 1), "source"), F.col("source_size"))).otherwise(F.lit(0))
    spans = taken_spans(F.col("_begin"), F.col("_size"), F.col("source_size"), start, F.col("cuts"), block_words, most_repeats, shards)
    joined = joined.withColumn("_spans", spans)
    taken = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return unwrapped(
        joined,
        {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken, "spans": F.col("_spans")},
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per taken span, its text cut to the span's words.

    A span that covers the whole document keeps its text as it is; a part has its words joined by one space.
    """
    mixed = mix_sources(wrapped(docs).select("_row", "_row.doc_id", "_row.text", "_row.source"), **options)
    mixed = mixed.withColumn("_span", F.explode("spans"))
    first, last = F.col("_span.first"), F.col("_span.last")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(words, (first + 1).cast("int"), (last - first).cast("int")), " ")
    text = F.when((first == 0) & (last == F.col("size")), F.col("text")).otherwise(part)
    made = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return unwrapped(mixed, made).select(docs.columns)
