"""Small DataFrame helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stalemark import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CODEC = "spark.sql.parquet.compression.codec"
BATCH_BYTES = "8m"
BITS_A_KEY, MOST_BITS = 8, 26
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def wrapped(df: DataFrame) -> DataFrame:
    """All columns in one struct ``_row``, so that columns of any name can travel through a plan."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def unwrapped(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns of ``_row`` and ``columns``; a new column takes the place of an old one of its name."""
    old = df.schema["_row"].dataType.names
    return df.select(
        *(F.col("_row")[c].alias(c) for c in old if c not in columns), *(v.alias(k) for k, v in columns.items())
    )


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES``, set for the session, so that long texts stay few in memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def write_through(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder; the shuffle files that made it go at once."""
    conf = df.sparkSession.conf
    wanted = {CLEANUP: "true"} | ({CODEC: codec} if codec else {})
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        return session.write_through(df, purpose)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def marked_by(df: DataFrame, keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Add ``name``: whether a row may have a partner in ``keys`` with the same ``columns``, which hold no nulls.

    A bitmap of ``BITS_A_KEY`` bits or more a row of ``keys``, a table that is written already, so counting it costs little.
    The bitmap has at most 2**``MOST_BITS`` bits, 1,048,576 rows of 64, so it may be broadcast. Rows without a partner that
    share a bit with one are marked too. With more keys than the bitmap has room for, it would mark about every row, so every
    row is marked without one: the join that follows gives the same result, at the price of a shuffle of all rows.
    """
    bits = (max(1, keys.count()) * BITS_A_KEY - 1).bit_length()
    if bits > MOST_BITS:
        return df.select(*(F.col(f"`{c}`") for c in df.columns), F.lit(True).alias(name))
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    bitmap = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    bitmap = bitmap.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hit = F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0
    found = df.join(F.broadcast(bitmap), word == F.col("_word"), "left")
    return found.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(hit, F.lit(False)).alias(name))
