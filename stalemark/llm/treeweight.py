"""Scoring texts by context-tree weighting over bytes, and by word counts.

A text is a stream of bytes: its words, A-Z in lower case, each followed by a space, and one end mark. A byte is eight
binary decisions, from the high bit on. Each decision has a tree of contexts, the bytes before it, from none to ``DEPTH``,
across words. A context holds the zeros and ones that training saw there, and their Krichevsky-Trofimov estimate. Its
weighted probability is half its own estimate and half the product of its longer contexts', so every depth takes part,
each context by how well it predicted. Scoring mixes the estimates along the path of contexts by those weights. A context
that training never saw has no estimate, and the mixture ends at the one before it, as at a leaf.

How it runs. Documents become streams in compressed chunks, dealt into blocks of bounded size, and written once. A pass over
them counts the distinct (context, byte) pairs and words of every block. Sums over blocks are the counts of the corpus: all
of them, nothing pruned. The trees are built from the longest contexts to the shortest for the weights, and back for the
mixtures. Each block then asks for the values of its own distinct pairs and words, and a task adds them up over the block's
documents. So what is moved is a block's distinct entries, not its positions, and no task ever holds the model.

Words are counted by 96 bits of hashes of their bytes; pairs up to a depth of 6 are numbers themselves.

Edge cases: a null text is an empty one, whose only token is the end; texts of any length are read whole, one in the memory
of a task at a time; equal texts have equal scores; ids are not looked at, repeated rows count each; without
training text every decision is even, and all tokens have the count 0; an empty table gives no rows; other columns are
carried along, and one named as a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stalemark.llm.frames import map_batches, unwrapped, write_through
from stalemark.llm.spans import Spans
from stalemark.llm.texts import LOWER, SPACE, Slice, mix, slices
from stalemark.session import discard

DEPTH = 5
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 1 << 19
TALLY_ROWS = 1 << 19
END = 0x0A  # no word holds it, and no word ends with it
GAP = 0x20
WORD, PAIR = 1, 0  # kinds of entries
RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "stream_bytes"]


# ------------------------------------------------------------------- streams


def stream_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The streams of a slice's documents, one after another, and where each begins."""
    size, n = len(part.data), part.n
    data = np.full(size + 2 * n, GAP, np.uint8)
    number = np.repeat(np.arange(n), np.diff(part.bounds))
    data[np.arange(size) + 2 * number] = LOWER[part.data]
    ends = part.bounds[1:] + 2 * np.arange(1, n + 1) - 1
    data[ends] = END
    word = ~SPACE[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first separator after a word, as a space
    data[~word] = GAP
    data[ends], keep[ends] = END, True
    bounds = np.concatenate([[0], np.cumsum(keep)[ends]])
    return data[keep], bounds


def pairs_of(stream: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """Each byte of the streams with the ``depth`` bytes before it, as a number; before its text stand end marks."""
    size = len(stream)
    place = np.arange(size) - np.repeat(bounds[:-1], np.diff(bounds))
    out = stream.astype(np.uint64)
    for back in range(1, depth + 1):
        byte = np.full(size, END, np.uint64)
        byte[back:] = stream[: size - back]
        byte[place < back] = END
        out |= byte << np.uint64(8 * back)
    return out.astype(np.int64)


def words_of(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each token, of 64 and 32 bits, the end included, and where each text's tokens begin."""
    stops = np.flatnonzero((stream == GAP) | (stream == END))
    starts = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64)[: len(stops)]
    ends = np.where(stream[stops] == END, stops + 1, stops)  # the end mark is a token of its own
    spans = Spans(stream, starts, ends)
    second = spans.hashes(12).view(np.int64).astype(np.int32).astype(np.int64)
    return spans.hashes(11).view(np.int64), second, np.searchsorted(stops, bounds)


# -------------------------------------------------------------------- chunks


def _chunked(block_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in chunks of streams; ``block`` counts up within the task whenever a block is full."""
        block, filled = None, 0
        for batch in batches:
            for part in slices(batch["text"], CHUNK_BYTES):
                stream, bounds = stream_of(part)
                if block is None or filled + len(stream) > block_bytes:
                    block, filled = int.from_bytes(np.random.default_rng().bytes(8), "little", signed=True), 0
                filled += len(stream)
                rows = batch.slice(part.first, part.n)
                offsets = pa.array([0, part.n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.ListArray.from_arrays(offsets, _plain(rows["train"])),
                        pa.ListArray.from_arrays(offsets, _plain(rows["_row"])),
                        pa.ListArray.from_arrays(offsets, pa.array(np.diff(bounds))),
                        pa.array([pa.Codec("zstd").compress(stream.tobytes(), asbytes=True)], pa.binary()),
                    ],
                    ["block", "train", "rows", "sizes", "data"],
                )

    return pack


def _plain(column: pa.Array) -> pa.Array:
    """The column without an offset, as list arrays need it."""
    return pa.concat_arrays([column])


def _streams(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum(np.asarray(chunk["sizes"], np.int64))]).astype(np.int64)
    data = pa.Codec("zstd").decompress(chunk["data"], int(bounds[-1]), asbytes=True)
    return np.frombuffer(data, np.uint8), bounds


def chunks_of(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents as streams (lower case, single spaces, end mark), about half a megabyte to a row, with their other columns."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("_none"))
    rows = docs.select(row.alias("_row"), F.coalesce(train, F.lit(False)).alias("train"), F.col("text"))
    kind = rows.schema["_row"].dataType.simpleString()
    schema = f"block long, train array<boolean>, rows array<{kind}>, sizes array<long>, data binary"
    return write_through(map_batches(rows, _chunked(block_bytes), schema), "streams", "zstd")


# ------------------------------------------------------------------- entries


class _Tally:
    """Distinct entries (a, or a and b) with sums of their counts, merged as they come in."""

    def __init__(self):
        self.parts, self.held, self.least = [], 0, TALLY_ROWS

    def add(self, *entries: np.ndarray) -> None:
        self.parts.append(entries)
        self.held += len(entries[0])
        if self.held > self.least:
            self.merge()
            self.least = max(TALLY_ROWS, 2 * self.held)

    def merge(self) -> tuple[np.ndarray, ...]:
        if self.parts:
            joined = tuple(np.concatenate(column) for column in zip(*self.parts))
            self.parts = []  # let the parts go before they are sorted
            self.parts = [_summed(*joined)]
            self.held = len(self.parts[0][0])
        return self.parts[0] if self.parts else ()


def _summed(*entries: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal keys as one, with the sum of their counts, the last column."""
    *keys, counts = entries
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [key[order] for key in keys]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    at = np.flatnonzero(fresh)
    return (*(key[at] for key in keys), np.add.reduceat(counts[order], at) if len(at) else counts)


def _entries(depth: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block its distinct pairs and words, with how often they stand in its training documents."""
        block, tallies = None, (_Tally(), _Tally())

        def flush() -> Iterator[pa.RecordBatch]:
            for tally in tallies:
                merged = tally.merge()
                for at in range(0, len(merged[0]) if merged else 0, 1 << 16):
                    first, *second, counts = (column[at : at + (1 << 16)] for column in merged)
                    b = pa.array(second[0].astype(np.int32)) if second else pa.nulls(len(first), pa.int32())
                    columns = [pa.array(np.full(len(first), block)), pa.array(first), b, pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "a", "b", "n"])

        for batch in batches:
            for chunk in batch.to_pylist():
                if chunk["block"] != block:
                    if block is not None:
                        yield from flush()
                    block, tallies = chunk["block"], (_Tally(), _Tally())
                stream, bounds = _streams(chunk)
                train = np.asarray(chunk["train"], np.int64)
                # A pair is at most 56 bits, so the flag fits in beside it, and plain numbers sort fast.
                marked = np.sort(pairs_of(stream, bounds, depth) << 1 | np.repeat(train, np.diff(bounds)))
                at = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]]))
                times = np.diff(np.append(at, len(marked))) * (marked[at] & 1)
                tallies[PAIR].add(marked[at] >> 1, times)
                a, b, first = words_of(stream, bounds)
                tallies[WORD].add(*_summed(a, b, np.repeat(train, np.diff(first))))
        if block is not None:
            yield from flush()

    return count


# --------------------------------------------------------------------- trees
#
# A node is a context and the bits of a byte decided so far; its children have a longer context and the same bits. Contexts
# longer than ``HOME`` bytes stay with the home that their last bytes name: at most 256**(depth - HOME) contexts, however
# large the corpus. Homes are spread over the tasks, and the nodes below them are arrays there. The nodes of up to ``HOME``
# bytes are rows of tables.

HOME = 3
HOMES_TOGETHER = 1 << 18  # pairs of whole homes that a task takes at a time, at least
LOG_HALF = -math.log(2)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function, from 1/2 on, to about 12 digits: Stirling's series six steps up."""
    z, steps = x + 6.0, x.copy()
    for i in range(1, 6):
        steps = steps * (x + i)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(steps)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def reversed_context(pairs: np.ndarray, depth: int) -> np.ndarray:
    """Contexts with the byte next to the decision first, so that those with a common suffix are neighbours when sorted."""
    out = np.zeros_like(pairs)
    for back in range(1, depth + 1):
        out = out << 8 | (pairs >> (8 * back) & 255)
    return out


class Level:
    """Nodes with contexts of one length, and which of them is the parent of each node of the next longer one."""

    def __init__(self, starts: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None):
        self.starts, self.zeros, self.ones, self.longer = starts, zeros, ones, longer
        self.seen = zeros + ones
        self.one = (ones + 0.5) / (self.seen + 1.0)
        own = log_estimate(zeros, ones)
        self.weighted = own if longer is None else np.logaddexp(own, longer) + LOG_HALF
        # How much of the weighted probability is the own estimate's.
        self.share = np.ones(len(own)) if longer is None else np.exp(own + LOG_HALF - self.weighted)


class Decision:
    """The trees of the ``i``-th bit of a byte, below the homes of the pairs (a, n)."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, contexts: np.ndarray, i: int, depth: int, home: int):
        byte = pairs & 255
        prefix, bit = (byte + 256) >> (8 - i), byte >> (7 - i) & 1
        self.order = np.lexsort((contexts, prefix))
        prefix, self.bit, contexts = prefix[self.order], bit[self.order], contexts[self.order]
        counts = counts[self.order].astype(np.float64)
        zeros, ones, longer, self.levels = np.where(self.bit == 0, counts, 0.0), np.where(self.bit == 1, counts, 0.0), None, []
        at = np.arange(len(pairs))
        for length in range(depth, home - 1, -1):
            # The nodes one level down, or the pairs themselves, fall into runs of one context of this length.
            key, kind = contexts[at] >> (8 * (depth - length)), prefix[at]
            fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]))
            zeros, ones = np.add.reduceat(zeros, fresh), np.add.reduceat(ones, fresh)
            if longer is not None:
                longer = np.add.reduceat(longer, fresh)
            at = at[fresh]
            self.levels.append(Level(at, zeros, ones, longer))
            longer = self.levels[-1].weighted
        self.top, self.prefix, self.home = self.levels[-1], prefix[at], contexts[at] >> (8 * (depth - home))

    def chances(self, left: np.ndarray, got: np.ndarray, one: np.ndarray) -> np.ndarray:
        """ln of the mixed probability of each pair's bit, in the order of the pairs, from the state at the top nodes: what
        the mixture has given out, the part of a one in it, and the chance of a one if the path ends there.
        """
        above = self.top
        for level in self.levels[-2::-1]:
            up = np.searchsorted(above.starts, level.starts, "right") - 1
            share, left, got, before = level.share, left[up], got[up], one[up]
            one = np.where(level.seen > 0, got + left * level.one, before)
            left, got, above = left * (1 - share), got + left * share * level.one, level
        mine = np.searchsorted(above.starts, np.arange(len(self.order)), "right") - 1
        chance = np.where(self.bit == 1, one[mine], 1 - one[mine])
        out = np.empty(len(chance))
        out[self.order] = np.log(chance)
        return out


def _decisions(pairs: np.ndarray, counts: np.ndarray, depth: int, home: int) -> list[Decision]:
    contexts = reversed_context(pairs, depth)
    return [Decision(pairs, counts, contexts, i, depth, home) for i in range(8)]


def _whole_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``home``, in tables that no home is divided between."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        homes = batch["home"].to_numpy()
        if size >= HOMES_TOGETHER:
            more = int(np.searchsorted(homes, last, "right"))
            held.append(batch.slice(0, more))
            if more < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size, batch = [], 0, batch.slice(more)
            else:
                continue
        held.append(batch)
        size, last = size + batch.num_rows, homes[-1]
    if held:
        yield pa.Table.from_batches(held)


def _home_tops(depth: int, home: int):
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_homes(batches):
            pairs, counts = table["a"].to_numpy(), table["n"].to_numpy()
            for d in _decisions(pairs, counts, depth, home):
                longer = pa.nulls(len(d.home), pa.float64()) if d.top.longer is None else pa.array(d.top.longer)
                columns = [pa.array(d.home), pa.array(d.prefix.astype(np.int32)), pa.array(d.top.zeros), pa.array(d.top.ones), longer]
                yield pa.RecordBatch.from_arrays(columns, ["context", "prefix", "zeros", "ones", "longer"])

    return tops


def _home_values(depth: int, home: int):
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_homes(batches):
            is_top = pc.is_valid(table["prefix"])
            top, table = table.filter(is_top), table.filter(pc.invert(is_top))
            pairs, counts = table["a"].to_numpy(), table["n"].to_numpy()
            state = [top[c].to_numpy() for c in ("left", "got", "one")]
            keys = top["home"].to_numpy() << 9 | top["prefix"].to_numpy()
            order = np.argsort(keys)
            total = np.zeros(len(pairs))
            for d in _decisions(pairs, counts, depth, home):
                at = order[np.searchsorted(keys, d.home << 9 | d.prefix, sorter=order)]
                total += d.chances(*(s[at] for s in state))
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total)], ["a", "value"])

    return values


def _home_of(depth: int, home: int) -> Column:
    """The last ``home`` bytes of a pair's context, the nearest one first."""
    out = F.lit(0).cast("long")
    for back in range(1, home + 1):
        byte = F.shiftright("a", 8 * back).bitwiseAND(F.lit(255).cast("long"))
        out = out + F.shiftleft(byte, 8 * (home - back))
    return out


def _log_gamma(x: Column) -> Column:
    """The same as ``log_gamma``, over columns."""
    z, steps = x + 6, x
    for i in range(1, 6):
        steps = steps * (x + i)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def _log_estimate(zeros: Column, ones: Column) -> Column:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _short_levels(tops: DataFrame, home: int) -> list[DataFrame]:
    """Nodes with contexts of ``home`` bytes, one byte less, ..., none. Contexts are numbers, the nearest byte first."""
    levels, level = [], tops
    for length in range(home, -1, -1):
        most, least = F.greatest("own", "longer"), F.least("own", "longer")
        both = most + F.log1p(F.exp(least - most)) + LOG_HALF
        leaf = F.col("longer").isNull()
        level = level.withColumn("own", _log_estimate(F.col("zeros"), F.col("ones"))).withColumn("weighted", F.when(leaf, F.col("own")).otherwise(both))
        share = F.when(leaf, 1.0).otherwise(F.exp(F.col("own") + LOG_HALF - F.col("weighted")))
        seen = F.col("zeros") + F.col("ones")
        estimate = (F.col("ones") + 0.5) / (seen + 1.0)
        kept = level.select("context", "prefix", "zeros", "ones", "weighted", share.alias("share"), (seen > 0).alias("seen"), estimate.alias("estimate"))
        levels.append(write_through(kept, "contexts", "zstd"))
        level = levels[-1].groupBy(F.shiftright("context", 8).alias("context"), "prefix").agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer")
        )
    return levels


def _mixed(levels: list[DataFrame]) -> DataFrame:
    """The longest contexts of ``levels`` with the state of the mixture there: see ``Decision.chances``."""
    share, estimate = F.col("share"), F.col("estimate")
    state = [(1 - share).alias("left"), (share * estimate).alias("got"), estimate.alias("one")]
    mixed = levels[-1].select("context", "prefix", *state)
    for level in levels[-2::-1]:
        up = mixed.select(*(F.col(c).alias(f"_{c}") for c in mixed.columns))
        met = level.join(up, (F.shiftright("context", 8) == F.col("_context")) & (F.col("prefix") == F.col("_prefix")))
        mixed = met.select(
            "context", "prefix",
            (F.col("_left") * (1 - share)).alias("left"),
            (F.col("_got") + F.col("_left") * share * estimate).alias("got"),
            F.when(F.col("seen"), F.col("_got") + F.col("_left") * estimate).otherwise(F.col("_one")).alias("one"),
        )
    return mixed


def mixtures(pairs: DataFrame, depth: int) -> DataFrame:
    """(a, value), written: ln of the mixed probability of each pair's byte after its context. ``pairs`` has a and its count n."""
    home = min(HOME, depth)
    placed = pairs.select(_home_of(depth, home).alias("home"), "a", "n")
    ordered = placed.repartition("home").sortWithinPartitions("home")
    tops = map_batches(ordered, _home_tops(depth, home), "context long, prefix int, zeros double, ones double, longer double")
    levels = _short_levels(tops, home)
    state = _mixed(levels).withColumnRenamed("context", "home")
    both = placed.unionByName(state, allowMissingColumns=True).repartition("home").sortWithinPartitions("home")
    values = write_through(map_batches(both, _home_values(depth, home), "a long, value double"), "values", "zstd")
    discard(*levels)
    return values


# -------------------------------------------------------------------- scoring


class Values:
    """Values of a block's entries by their numbers, in an open-addressing table at most half full."""

    def __init__(self, a: np.ndarray, values: np.ndarray, b: np.ndarray | None = None):
        self.a, self.b, self.values = a, b, values
        self.last = (1 << max(4, (2 * len(a)).bit_length())) - 1
        self.table = np.full(self.last + 1, -1, np.int32)
        slot, rest = self._slots(a), np.arange(len(a), dtype=np.int32)
        while len(rest):
            free = rest[self.table[slot[rest]] < 0]
            self.table[slot[free]] = free
            rest = rest[self.table[slot[rest]] != rest]
            slot[rest] = (slot[rest] + 1) & self.last

    def _slots(self, a: np.ndarray) -> np.ndarray:
        return (mix(a.view(np.uint64)) & np.uint64(self.last)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        slot = self._slots(a)
        found = self.table[slot]
        off = np.flatnonzero(self._differ(found, a, b))
        while len(off):
            if (found[off] < 0).any():
                raise RuntimeError("a block asks for an entry that it did not count")
            slot[off] = (slot[off] + 1) & self.last
            found[off] = self.table[slot[off]]
            off = off[self._differ(found[off], a[off], None if b is None else b[off])]
        return self.values[found]

    def _differ(self, found: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        if not len(self.a):
            return np.ones(len(found), bool)
        differ = (self.a[found] != a) | (found < 0)
        return differ if b is None else differ | (self.b[found] != b)


def _scored(depth: int, total: int, distinct: int, schema: pa.Schema):
    low, scale = math.log10(0.1), total + 0.1 * (distinct + 1)

    def add_up(chunks: pa.Table, entries: pa.Table) -> pa.Table:
        is_word = pc.is_valid(entries["b"])
        words = entries.filter(is_word)
        tokens = Values(words["a"].to_numpy(), words["value"].to_numpy(), words["b"].to_numpy().astype(np.int64))
        others = entries.filter(pc.invert(is_word))
        pairs = Values(others["a"].to_numpy(), others["value"].to_numpy())
        out = []
        for batch in chunks.to_batches(max_chunksize=1):
            if not batch.num_rows:
                continue
            stream, bounds = _streams(batch.select(["sizes", "data"]).to_pylist()[0])
            logs = pairs.of(pairs_of(stream, bounds, depth))
            a, b, first = words_of(stream, bounds)
            counts = tokens.of(a, b)
            base = np.where(counts > 0, np.log10(counts + 0.1), low) - math.log10(scale)
            out.append(
                pa.table(
                    {
                        "_row": batch["rows"].flatten(),
                        "n_tokens": np.diff(first),
                        "n_known": np.add.reduceat((counts > 0).astype(np.int64), first[:-1]),
                        "train_tokens": np.full(len(bounds) - 1, total),
                        "base_score": np.add.reduceat(base, first[:-1]),
                        "score": np.add.reduceat(logs, bounds[:-1]) / math.log(10),
                        "stream_bytes": np.diff(bounds),
                    }
                )
            )
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return add_up


def score_documents(docs: DataFrame, train: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, without their text, each with its number of tokens, of known ones, and both scores (log10).

    ``train`` says which documents the counts come from. ``base_score`` is by counts of words, ``score`` by the context
    trees; ``-score * log2(10) / stream_bytes`` is the code length in bits a byte.
    """
    if not 0 <= depth <= 6:
        raise ValueError("a context and its byte must fit 64 bits: a depth of 0 to 6")
    chunks = chunks_of(docs, train, block_bytes)
    rows = chunks.schema["rows"].dataType.elementType
    entries = map_batches(chunks.select("block", "train", "sizes", "data"), _entries(depth), "block long, a long, b int, n long")
    entries = write_through(entries, "entries", "zstd")
    is_word = F.col("b").isNotNull()
    words = write_through(entries.where(is_word).groupBy("a", "b").agg(F.sum("n").alias("n")), "words", "zstd")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    pairs = write_through(entries.where(~is_word).groupBy("a").agg(F.sum("n").alias("n")), "pairs", "zstd")
    values = mixtures(pairs, depth)
    known = words.select("a", "b", F.col("n").cast("double").alias("value"))
    answers = entries.where(~is_word).select("block", "a").join(values, "a").select("block", "a", F.lit(None).cast("int").alias("b"), "value")
    answers = answers.union(entries.where(is_word).select("block", "a", "b").join(known, ["a", "b"]).select("block", "a", "b", "value"))
    answers = write_through(answers, "answers", "zstd")
    discard(entries, words, pairs, values)
    schema = f"_row {rows.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, stream_bytes long"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    scored = chunks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(depth, total, distinct, arrow), schema)
    found = unwrapped(scored, {name: F.col(name) for name in RESULTS})
    return found if len(docs.columns) > 1 else found.drop("_none")

