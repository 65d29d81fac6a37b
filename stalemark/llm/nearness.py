"""Near duplicates by b-bit MinHash, with links confirmed on whole shingle sets.

1. One pass makes, for every document, the size and a 128-bit hash of its shingle set, ``BANDS`` band keys and the
   packed low bits of its minima. Documents of one set are one class from here on, so exact copies cost nothing more.
2. Classes that share a band with the smallest class of that band are candidates of one another: the connected
   components of that graph hold all pairs that share any band. A pair at the threshold shares none of the bands with
   probability (1 - 0.8**5)**38 < 3e-7.
3. A cluster of candidates is cut into blocks, and each pair of blocks meets in one task, first with nothing but packed
   signatures and set sizes. Bit counts estimate each pair, corrected for low bits that agree by chance; pairs within
   reach of the threshold connect the narrower clusters that are left. Documents that merely share a template end here.
4. Of those, blocks of full sets meet in the same way and settle the pairs within reach. A task returns a spanning forest
   of its links, never all of them.
5. Components of those links.

Edge cases: documents without words (null, empty or blank text) link with nothing; fewer words than a shingle's are one
shingle; a null doc_id takes no part in links and is kept with a null component; rows that repeat a doc_id count as one
document; of equal doc_ids and sets the smallest id stands for all. An empty table gives an empty one. A text is hashed
whole, whatever its length, in slices of a batch. Only doc_id and text are read; other columns, of any name, are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stalemark.llm.frames import map_batches, marked_by, partitions, write_through
from stalemark.llm.graph import connected_components
from stalemark.llm.texts import LOWER, Slice, constants, mix, run_hashes, slices, word_hashes

SHINGLE = 5
BANDS, ROWS_PER_BAND = 38, 5
LOW_BITS = 2
PERCENT = 80
BLOCK, SIGNED_BLOCK = 128, 2048  # members of a cluster that meet as full sets, and as signatures
SURE = 6.0  # standard deviations below the threshold at which an estimate rules a pair out

SIGNATURES = "doc_id long, n_shingles long, high long, low long, bands array<long>, signature binary"


def shingle_sets(part: Slice, length: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    data = LOWER[part.data]
    starts, ends, first = part.words()
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    runs = run_hashes(words, length)
    sets = []
    for at, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= length:
            sets.append(np.unique(runs[at : at + n - length + 1]))
        elif n:
            sets.append(run_hashes(words[at : at + n], n, seed=n))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` minima of each nonempty set, one row a set."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), n), np.uint32)
    for k, c in enumerate(constants(5, n)):
        out[:, k] = np.minimum.reduceat(values * np.uint32(int(c) & 0xFFFFFFFF) + np.uint32(int(c) >> 32), at)
    return out


def packed(rows: np.ndarray, bits: int = LOW_BITS) -> np.ndarray:
    """The low bits of each minimum, as 64-bit words: one row of words a set."""
    low = (rows & np.uint32((1 << bits) - 1)).astype(np.uint64)
    per = 64 // bits
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % per))).reshape(len(rows), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=2)


def estimate(one: np.ndarray, others: np.ndarray, n: int, bits: int = LOW_BITS) -> np.ndarray:
    """Similarity of one packed signature to others by bit counts, corrected for chance agreement of low bits."""
    differs = one ^ others
    for b in range(1, bits):
        differs |= (one ^ others) >> np.uint64(b)
    lowest = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    agree = 1 - np.bitwise_count(differs & lowest).sum(axis=1) / n
    chance = 0.5**bits
    return (agree - chance) / (1 - chance)


def signatures(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    n = BANDS * ROWS_PER_BAND
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                sets = shingle_sets(part, length)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                high, low = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                bands, marks = [[]] * len(sets), [b""] * len(sets)
                if full:
                    values, at = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
                    some = np.flatnonzero(sizes)
                    for out, c in ((high, 11), (low, 12)):
                        out[some] = np.add.reduceat(mix(values ^ constants(c, 1)[0]), at)
                    rows = minima(full, n)
                    weights = constants(9, n).reshape(BANDS, ROWS_PER_BAND)
                    keys = mix((rows.reshape(len(rows), BANDS, ROWS_PER_BAND) * weights).sum(axis=2, dtype=np.uint64)).view(np.int64)
                    for i, k, m in zip(some, keys, packed(rows), strict=True):
                        bands[i], marks[i] = k, m.tobytes()
                ids = batch.column(0).slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), sign, SIGNATURES)


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(doc_id, cluster) of classes (doc_id, bands) that share a band with another."""
    banded = classes.select("doc_id", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).where("hub <> other").select("key", "hub")
    pairs = banded.join(hubs, "key").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    return connected_components(pairs).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def least_estimate(percent: int) -> float:
    """The estimate below which a pair is ruled out: ``SURE`` standard deviations below the threshold."""
    chance = 0.5**LOW_BITS
    agree = chance + (1 - chance) * percent / 100
    return percent / 100 - SURE * (agree * (1 - agree) / (BANDS * ROWS_PER_BAND)) ** 0.5 / (1 - chance)


def open_pairs(marks: np.ndarray, sizes: np.ndarray, sides: list[int], ids: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that neither their signatures nor their sizes rule out, between the two sides (or
    within, if there is one side only).
    """
    least, side = least_estimate(percent), np.array(sides)
    label, across = np.arange(len(ids)), len(set(sides)) > 1
    forest = []
    for i in range(len(ids) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        rest = rest[side[rest] != side[i]] if across else rest
        rest = rest[np.minimum(sizes[i], sizes[rest]) * 100 >= np.maximum(sizes[i], sizes[rest]) * percent]
        if not len(rest):
            continue
        for j in rest[estimate(marks[i], marks[rest], BANDS * ROWS_PER_BAND) >= least].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                forest.append((ids[i], ids[j]))
    return forest


def linked(sets: list[np.ndarray], marks: np.ndarray, sides: list[int], ids: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two sides (or within, if there is one side only)."""
    n = BANDS * ROWS_PER_BAND
    sizes = np.array([len(s) for s in sets])
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    one_side = len(set(sides)) == 1
    side = np.array(sides)
    least = least_estimate(percent)
    forest = []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        rest = rest if one_side else rest[side[rest] != side[i]]
        small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        rest = rest[small * 100 >= large * percent]
        near = estimate(marks[i], marks[rest], n) if len(rest) else np.zeros(0)
        for j in rest[near >= least][np.argsort(-near[near >= least], kind="stable")].tolist():
            if ids[i] == ids[j] or (a := root(i)) == (b := root(j)):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (int(sizes[i]) + int(sizes[j]) - common):
                parent[b] = a
                forest.append((ids[i], ids[j]))
    return forest


def in_blocks(members: DataFrame, size: int) -> DataFrame:
    """Members of clusters of more than one, with ``block`` of ``blocks`` of about ``size`` members each."""
    sized = members.groupBy("cluster").agg(F.count("doc_id").alias("n")).where("n > 1")
    placed = members.join(sized, "cluster").withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    return placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("n")


def pairs_of_blocks(placed: DataFrame, columns: list[str], decide: Callable[[list, list, list, list], list[tuple[int, int]]]) -> DataFrame:
    """Pairs (a, b) that ``decide`` finds where two blocks of a cluster meet, or a block itself.

    It gets, for the members of both, two lists of ``columns``, then their blocks and ids.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.withColumn("other", other).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", *columns
    )
    group = ["cluster", "i", "j"]
    met = met.repartition(partitions(placed), *group).sortWithinPartitions(*group, "block", "doc_id")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def pairs() -> pa.RecordBatch:
            found = []
            if len(held) > 1 and (now[1] == now[2] or len({r[0] for r in held}) == 2):
                blocks, ids, first, second = map(list, zip(*held, strict=True))
                found = decide(first, second, blocks, ids)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for cluster, i, j, *row in zip(*(batch.column(n).to_pylist() for n in range(7)), strict=True):
                if now != (cluster, i, j):
                    if held:
                        yield pairs()
                    now, held = (cluster, i, j), []
                held.append(row)
        if held:
            yield pairs()

    return map_batches(met, settle, "a long, b long")


def narrowed_clusters(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, cluster) of members (doc_id, cluster, n_shingles, signature) that signatures leave in a cluster.

    Documents of one template share bands without being near duplicates. Signatures are a few bytes, so large blocks of
    them can meet; what they do not connect can hold no link, and its full sets are sent nowhere.
    """

    def decide(signature: list, n_shingles: list, blocks: list, ids: list) -> list[tuple[int, int]]:
        marks = np.stack([np.frombuffer(x, np.uint64) for x in signature])
        return open_pairs(marks, np.array(n_shingles), blocks, ids, percent)

    pairs = pairs_of_blocks(in_blocks(members, SIGNED_BLOCK), ["signature", "n_shingles"], decide)
    return connected_components(pairs).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def confirmed_links(docs: DataFrame, members: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between members (doc_id, cluster, high, low, signature) of a cluster, enough to connect what is linked.

    Every block of a cluster meets every other and itself once. ``docs`` gives the texts, for the full sets.
    """
    placed = in_blocks(members, BLOCK)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    texts = marked_by(texts, members, ["doc_id"], "_maybe").where("_maybe").join(placed, "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("cluster", pa.int64()), ("blocks", pa.int32()), ("block", pa.int32()), ("signature", pa.binary()), ("shingles", pa.binary())])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                sets = shingle_sets(part, length)
                hashes = [(int(np.add.reduce(mix(s ^ constants(11, 1)[0])).astype(np.int64)) if len(s) else 0) for s in sets]
                own = batch.slice(part.first, part.n)
                keep = pa.array([h == k for h, k in zip(hashes, own.column(6).to_pylist(), strict=True)], pa.bool_())
                columns = [*own.columns[1:6], pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(keep)

    made = map_batches(texts.select("text", "doc_id", "cluster", "blocks", "block", "signature", "high"), sets_of, "doc_id long, cluster long, blocks int, block int, signature binary, shingles binary")

    def decide(signature: list, shingles: list, blocks: list, ids: list) -> list[tuple[int, int]]:
        marks = np.stack([np.frombuffer(x, np.uint64) for x in signature])
        return linked([np.frombuffer(x, np.uint64) for x in shingles], marks, blocks, ids, percent)

    return pairs_of_blocks(made, ["signature", "shingles"], decide)


def near_duplicates(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents (doc_id, text); links are sets of which
    100 * intersection >= ``percent`` * union. Below ``PERCENT`` the bands would not find all links, so that is refused.
    """
    if percent < PERCENT:
        raise ValueError(f"the bands find the links from a similarity of {PERCENT} percent on, not from {percent}")
    signed = write_through(signatures(docs, length), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A table of its own, so that the joins below can split a class that holds many of the rows.
    classes = write_through(full.groupBy("high", "low").agg(F.min("doc_id").alias("least")), "class-ids")
    firsts = full.join(classes, ["high", "low"]).where("doc_id = least").dropDuplicates(["doc_id", "high", "low"])
    firsts = write_through(firsts.select("doc_id", "n_shingles", "high", "low", "bands", "signature"), "classes")
    marks = firsts.select("doc_id", "n_shingles", "high", "low", "signature")
    candidates = write_through(marks.join(candidate_clusters(firsts), "doc_id"), "candidates")
    members = write_through(marks.join(narrowed_clusters(candidates, percent), "doc_id"), "members")
    components = connected_components(confirmed_links(docs, members, length, percent)).withColumnRenamed("node", "least")
    named = signed.select("doc_id", "n_shingles", "high", "low").join(classes, ["high", "low"], "left").join(components, "least", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "least", "doc_id"))
    found = named.select("doc_id", "n_shingles", component.alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
