"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame functions only.

Rows fall into blocks by a hash. How many rows of each block go to each shard is drawn first, as a uniform shuffle would
have it: the blocks are halved again and again, and each half's rows per shard are drawn from the hypergeometric law given
what the whole has. Then each block is permuted and dealt out by its row of the matrix, and each shard is permuted again.
Every number drawn depends on the seed and the block alone, so retries and reruns agree.

Edge cases: a null text has the size 1 (no bytes, plus 1) and the CRC-32 of nothing; null ids take part like others; rows
that repeat are rows of their own (which of two equal rows takes which place is open); an empty table gives an empty
result; output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stalemark.llm.frames import text_of, unwrapped, wrapped
from stalemark.llm.ranks import add_running, bits_for, bucket_of

SHARDS = 8
SEED = 8
BITS_PER_ROUND = 12


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows out of ``total`` are among the ``good`` ones, by inversion at ``u``.

    The chances are summed from the most likely number outwards, each from its neighbour, first for their total and then
    until ``u`` of it is reached; 12 standard deviations to either side hold all that a double can tell.
    """

    def made(p: Column) -> Column:
        g, t, d = p["good"], p["total"], p["draws"]
        mode = F.least(F.floor((d + 1) * (g + 1) / (t + 2)), g, d).cast("double")
        spread = F.sqrt(F.greatest(d * (g / t) * (1 - g / t) * (t - d) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0)))
        reach = F.greatest(F.least(g, d) - mode, mode - F.greatest(F.lit(0.0), d + g - t))
        steps = F.least(F.ceil(spread * 12) + 10, reach).cast("int")
        return F.struct(g.alias("g"), t.alias("t"), d.alias("d"), mode.alias("mode"), steps.alias("steps"))

    def walk(q: Column) -> Column:
        g, d, rest, mode = q["g"], q["d"], q["t"] - q["g"] - q["d"], q["mode"]

        def above(w: Column, k: Column) -> Column:  # the chance of mode + k from that of mode + k - 1
            x = mode + k - 1
            return F.when((x < g) & (x < d), w * (g - x) * (d - x) / ((x + 1) * (rest + x + 1))).otherwise(0.0)

        def below(w: Column, k: Column) -> Column:
            x = mode - k + 1
            return F.when((x > 0) & (rest + x > 0), w * x * (rest + x) / ((g - x + 1) * (d - x + 1))).otherwise(0.0)

        places = F.when(q["steps"] > 0, F.sequence(F.lit(1), q["steps"])).otherwise(F.array().cast("array<int>"))
        state = F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), F.lit(1.0).alias("all"))

        def add(s: Column, k: Column) -> Column:
            return let(
                F.struct(above(s["up"], k).alias("up"), below(s["down"], k).alias("down")),
                lambda n: F.struct(n["up"].alias("up"), n["down"].alias("down"), (s["all"] + n["up"] + n["down"]).alias("all")),
            )

        whole = F.aggregate(places, state, add)["all"]
        begin = F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), (u * whole - 1).alias("left"), mode.alias("at"))

        def seek(s: Column, k: Column) -> Column:
            def step(n: Column) -> Column:
                found, upper, left = s["left"] < 0, s["left"] - n["up"], s["left"] - n["up"] - n["down"]
                at = F.when(found, s["at"]).when(upper < 0, mode + k).when(left < 0, mode - k).otherwise(s["at"])
                return F.struct(n["up"].alias("up"), n["down"].alias("down"), F.when(found, s["left"]).otherwise(left).alias("left"), at.alias("at"))

            return let(F.struct(above(s["up"], k).alias("up"), below(s["down"], k).alias("down")), step)

        return F.aggregate(places, begin, seek)["at"].cast("long")

    inputs = F.struct(good.cast("double").alias("good"), total.cast("double").alias("total"), draws.cast("double").alias("draws"))
    return F.when((draws <= 0) | (good <= 0), F.lit(0).cast("long")).when(good >= total, draws.cast("long")).otherwise(let(let(inputs, made), walk))


def halved(nodes: DataFrame, seed: int) -> DataFrame:
    """Both halves of every node (node, leaves, quota): half the leaves, and the drawn part of the rows per shard."""
    half = (F.size("leaves") / 2).cast("int")
    rows = F.aggregate(F.slice("leaves", F.lit(1), half), F.lit(0).cast("long"), lambda a, x: a + x)
    total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("total"), rows.alias("rows"), F.array().cast("array<bigint>").alias("out"))

    def draw(s: Column, good: Column) -> Column:
        u = uniform(F.lit(seed), F.col("node"), F.size("leaves"), F.size(s["out"]))
        drawn = hypergeometric(good, s["total"], s["rows"], u)
        return let(drawn, lambda x: F.struct((s["total"] - good).alias("total"), (s["rows"] - x).alias("rows"), F.concat(s["out"], F.array(x)).alias("out")))

    split = nodes.withColumn("half", half).withColumn("left", F.aggregate("quota", start, draw)["out"])
    halves = F.array(
        F.struct((F.col("node") * 2).alias("node"), F.slice("leaves", F.lit(1), F.col("half")).alias("leaves"), F.col("left").alias("quota")),
        F.struct(
            (F.col("node") * 2 + 1).alias("node"),
            F.slice("leaves", F.col("half") + 1, F.col("half")).alias("leaves"),
            F.zip_with("quota", "left", lambda a, b: a - b).alias("quota"),
        ),
    )
    return split.select(F.inline(halves))


def leaf_counts(counts: DataFrame, bits: int) -> Column:
    """Rows of blocks 0 .. 2**bits - 1 as an array, from rows (leaf, rows)."""
    found = F.map_from_entries(F.collect_list(F.struct("leaf", "rows")))
    return let(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda i: F.coalesce(m[i.cast("long")], F.lit(0).cast("long"))))


def communication_matrix(counts: DataFrame, bits: int, shards: int, seed: int) -> DataFrame:
    """Rows of each block (block, rows) per shard, as (block, quota).

    A round halves down by at most ``BITS_PER_ROUND`` bits, from an array of the rows below; the first starts with the
    exact sizes of the shards.
    """
    high = min(bits, BITS_PER_ROUND)
    low = bits - high
    top = counts.groupBy(F.shiftright("block", low).alias("leaf")).agg(F.sum("rows").alias("rows"))
    n = F.aggregate("leaves", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.floor(n * (j + 1) / shards) - F.floor(n * j / shards))
    nodes = top.agg(leaf_counts(top, high).alias("leaves")).select(F.lit(0).cast("long").alias("node"), "leaves", sizes.cast("array<bigint>").alias("quota"))
    for _ in range(high):
        nodes = halved(nodes, seed)
    if low:
        inner = counts.withColumn("above", F.shiftright("block", low)).withColumn("leaf", F.col("block") - F.shiftleft("above", low))
        inner = inner.groupBy("above").agg(leaf_counts(inner, low).alias("leaves"))
        nodes = inner.join(nodes.select(F.col("node").alias("above"), "quota"), "above").select(F.col("above").alias("node"), "leaves", "quota")
        for _ in range(low):
            nodes = halved(nodes, seed)
    return nodes.select(F.col("node").alias("block"), "quota")


def shuffle_into_shards(df: DataFrame, by: Sequence[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``shard`` and ``slot`` (from 0, gapless in a shard); shard sizes differ by one row at most.

    ``by`` names the columns that tell rows apart.
    """
    rows = df.count()
    bits = bits_for(rows)
    keys = [F.col("_row")[c] for c in by]
    keyed = wrapped(df).select("_row", *(F.xxhash64(F.lit(seed + i), *keys).alias(f"_k{i}") for i in range(3)))
    keyed = keyed.withColumn("_block", bucket_of("_k0", bits) + (1 << bits >> 1))  # signed keys start below zero
    counts = keyed.groupBy(F.col("_block").alias("block")).agg(F.count(F.lit(1)).alias("rows"))
    matrix = communication_matrix(counts, bits, shards, seed)
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_k1", "_k0")) - 1
    dealt = keyed.withColumn("_place", place).join(matrix, F.col("_block") == F.col("block"))
    passed = F.aggregate(
        "quota",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard")),
        lambda s, q: F.struct((s["sum"] + q).alias("sum"), (s["shard"] + (F.col("_place") >= s["sum"] + q).cast("int")).alias("shard")),
    )
    dealt = dealt.select("_row", "_k2", "_k0", passed["shard"].alias("_shard"))
    slots = add_running(dealt, ["_shard"], ["_k2", "_k0"], bits_for(-(-rows // shards)), {"_slot": F.lit(1).cast("long")})
    return unwrapped(slots, {"shard": F.col("_shard"), "slot": F.col("_slot")})


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, UTF-8 bytes of the text plus 1, and its CRC-32."""
    text = text_of(F.col("text"))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
