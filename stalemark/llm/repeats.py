"""Substring dedup: every passage of ``PASSAGE`` words that occurs elsewhere is removed wherever it stands.

1. In each window of ``PASSAGE`` words, the smallest hash of ``GRAM`` words in a row is its anchor. Equal windows have
   equal anchors, and neighbouring windows mostly share theirs, so a document becomes a few runs of windows, one for
   about every 12 words: (anchor, hash of all words of the run).
2. Runs that occur twice, and windows that runs of one anchor have in common, are candidates: hashes say that they recur.
   No group is collected: counts are aggregated before the shuffle, and joined back.
3. The text of one example of each candidate is a passage. Passages are dealt by anchor into decks of bounded size, and the
   stretches of all documents that hold the anchor stream through the Aho-Corasick automaton of its deck.
4. A passage found once only is refuted: the hash lied. All other places that the automata found are removed, and no others.

An anchor with more passages than an automaton may hold is divided by passage (a stretch goes to the parts that its own
windows are in), one that very many stretches hold is salted (each salt has all passages of its deck).

Edge cases: a null text has no words; documents shorter than a window lose nothing; rows that repeat, with one doc_id or
several, repeat each other's windows and lose them; a document may lose all words and stays as an empty one; rows with null
or equal ids are told apart by 128 bits of their text's hash; texts of any length are read whole by one task; an empty table
gives no rows. Other columns are carried along; output columns replace input columns of the same name. Rows equal in id and
text have one salt, so very many copies of one such row make one long task, in a stream of bounded memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stalemark.llm.frames import map_batches, marked_by, partitions, text_of, wrapped, write_through
from stalemark.llm.texts import Slice, constants, expand, mix, run_hashes, slices, word_hashes
from stalemark.session import discard

PASSAGE, GRAM = 35, 12
SLICE_BYTES = 1 << 20
AUTOMATON_WORDS = 1 << 17  # of all passages in an automaton, about
STREAM_RUNS = 50_000  # stretches that one salt of a hot anchor streams, about
PART_WORDS = 2_000
FLUSH_BYTES = 4 << 20
KEY = ["id", "h1", "h2"]  # a document: its id, and 128 bits of a hash of its text, since ids may repeat or be null
RUNS = "id long, h1 long, h2 long, anchor long, seg long, first int, n int, again boolean"
DEALT = "deck long, salts int, sub int, salt int, stream boolean, id long, h1 long, h2 long, first int, text string"
GROUP = ["deck", "salts", "sub", "salt"]
FOUND = "deck long, salts int, sub int, passage int, id long, h1 long, h2 long, begin int, end int, times int"


def sliding(values: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each ``width`` values in a row, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out, reach = better(out[: len(out) - reach], out[reach:]), reach * 2
    rest = width - reach
    return better(out[: len(out) - rest], out[rest:]) if rest else out


def span_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the words ``first[i] .. last[i] - 1`` of each span, from one running sum."""
    base = int(constants(31, 1)[0])
    powers = np.ones(len(words) + 1, np.uint64)
    inverse = np.ones(len(words) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(words), base, np.uint64), out=powers[1:])
    np.multiply.accumulate(np.full(len(words), pow(base, -1, 1 << 64), np.uint64), out=inverse[1:])
    sums = np.zeros(len(words) + 1, np.uint64)
    np.add.accumulate(words * powers[:-1], out=sums[1:])
    return mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


def window_runs(part: Slice, passage: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with one anchor: row, anchor, seg, first window, windows, and whether its anchor's
    words stand in it more than once.
    """
    starts, ends, bounds = part.words()
    words = word_hashes(part.data, starts, ends)
    counts = np.maximum(np.diff(bounds) - passage + 1, 0)
    if not counts.sum():
        return {}
    grams = run_hashes(words, gram)
    width = passage - gram + 1
    least = sliding(grams, width, np.minimum)
    at = expand(bounds[:-1], counts)  # every window, by its first word
    row = np.repeat(np.arange(part.n), counts)
    anchor = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    n = np.diff(np.append(begin, len(at)))
    first = at[begin]
    # A gram is chosen if it is the least of some window; two neighbours chosen with one value make a run repeat itself.
    inside = np.zeros(len(grams) + 2 * width, np.uint64)
    inside[at + width - 1] = anchor
    chosen = np.flatnonzero(sliding(inside, width, np.maximum)[: len(grams)] == grams)
    same = chosen[1:][grams[chosen[1:]] == grams[chosen[:-1]]]
    again = np.zeros(len(begin), bool)
    if len(same):
        # A gram is the anchor of one run only. Of the runs that hold the gram at most ``width`` begin, each with a window of
        # its own, from the last one begun before it backwards.
        of = np.searchsorted(first, same, "right") - 1
        for _ in range(width):
            hit = (anchor[begin[of]] == grams[same]) & (same < first[of] + n[of] + width - 1)
            again[of[hit]] = True
            left = ~hit & (of > 0)
            of, same = of[left] - 1, same[left]
    return {
        "row": row[begin], "anchor": anchor[begin], "seg": span_hashes(words, first, first + n + passage - 1),
        "first": first - bounds[:-1][row[begin]], "n": n, "again": again,
    }


def find_runs(texts: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """Runs of windows of each of ``texts`` (id, h1, h2, text)."""
    schema = pa.schema([*((k, pa.int64()) for k in KEY), ("anchor", pa.int64()), ("seg", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(3)):
                if found := window_runs(part, passage, gram):
                    rows = pa.array(found["row"] + part.first)
                    made = [*(batch.column(k).take(rows) for k in range(3)), *(pa.array(found[k].view(np.int64)) for k in ("anchor", "seg"))]
                    made += [pa.array(found[k].astype(np.int32)) for k in ("first", "n")]
                    yield pa.RecordBatch.from_arrays([*made, pa.array(found["again"])], schema=schema)

    return map_batches(texts, runs, RUNS)


def window_rows(examples: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """A row per window of the runs (anchor, seg, first, n, weight) listed with each text: (anchor, seg, place, window, weight)."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("place", pa.int32()), ("window", pa.int64()), ("weight", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(1)
            for part in slices(batch.column(0)):
                starts, ends, bounds = part.words()
                hashes = run_hashes(word_hashes(part.data, starts, ends), passage, seed=3)
                own = runs.slice(part.first, part.n)
                row = np.repeat(np.arange(part.n), own.value_lengths().to_numpy())
                flat = own.flatten()
                anchor, seg, first, n, weight = (flat.field(k).to_numpy() for k in range(5))
                place = expand(np.zeros(len(n), np.int64), n)
                window = hashes[expand(first + bounds[:-1][row], n)].view(np.int64)
                made = [np.repeat(anchor, n), np.repeat(seg, n), place.astype(np.int32), window, np.repeat(weight, n)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], schema=schema)

    return map_batches(examples.select("text", "runs"), rows, "anchor long, seg long, place int, window long, weight int")


def candidate_runs(texts: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(id, h1, h2, runs): the runs of each of ``texts`` (id, h1, h2, text) that recur by their hashes, as a whole, or where
    ``at`` isn't null, in the windows it lists; with the deck of their anchor, and whether the run is the example.

    Tables that are joined back to what they were counted from are written first: such a join has its own shuffle, which
    can split a key that holds many of the rows. They are removed once no later table is made from them.
    """
    runs = write_through(find_runs(texts, passage, gram), "runs")
    twice = runs.groupBy("anchor").agg(F.count("n").alias("times"), F.max("again").alias("again")).where("times > 1 OR again")
    anchors = write_through(twice.select("anchor", "times"), "anchors")
    live = write_through(runs.join(anchors.select("anchor"), "anchor"), "live-runs")
    discard(runs)
    segs = live.groupBy("anchor", "seg").agg(
        F.count("n").alias("times"), F.max("again").alias("again"), F.min(F.struct(*KEY, "first", "n")).alias("example")
    )
    segs = write_through(segs, "segs")
    kinds = write_through(segs.groupBy("anchor").agg(F.count("seg").alias("kinds")).where("kinds > 1"), "kinds")
    unsure = segs.join(kinds, "anchor", "left").where("kinds IS NOT NULL OR (again AND times = 1)")
    run = F.struct("anchor", "seg", "example.first", "example.n", F.least("times", F.lit(2)).cast("int").alias("weight"))
    listed = unsure.groupBy(*(F.col(f"example.{k}").alias(k) for k in KEY)).agg(F.collect_set(run).alias("runs"))
    listed = write_through(listed, "examples")
    some = marked_by(texts, listed, KEY, "maybe").where("maybe").join(listed, KEY).dropDuplicates(KEY)
    windows = write_through(window_rows(some, passage), "windows")
    again = windows.groupBy("anchor", "window").agg(F.sum("weight").alias("times")).where("times > 1").select("anchor", "window")
    again = write_through(again, "recurring-windows")
    parts = windows.join(again, ["anchor", "window"]).groupBy("anchor", "seg").agg(F.collect_set("place").alias("at"))
    whole = segs.where("times > 1").select("anchor", "seg", "example", F.lit(None).cast("array<int>").alias("at"))
    parts = parts.join(segs.where("times = 1").select("anchor", "seg", "example"), ["anchor", "seg"])
    marked = write_through(whole.unionByName(parts), "recurring-runs")
    discard(segs, kinds, listed, windows, again)
    words = F.when(F.col("at").isNull(), F.col("example.n") + passage - 1).otherwise(F.size("at") * passage)
    held = marked.groupBy("anchor").agg(F.sum(words).alias("words"))
    decks = 1 + 2 * (held.agg(F.sum("words")).first()[0] or 0) // AUTOMATON_WORDS
    held = held.join(anchors, "anchor").select(
        "anchor", *(F.ceil(F.col(c) / most).cast("int").alias(k) for k, c, most in (("subs", "words", AUTOMATON_WORDS), ("salts", "times", STREAM_RUNS)))
    )
    deck = F.when(F.greatest("subs", "salts") > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(decks)))
    held = write_through(held.withColumn("deck", deck), "decks")
    marked_with_deck = write_through(marked.join(held, "anchor"), "dealt-runs")
    found = live.join(marked_with_deck, ["anchor", "seg"])
    chosen = F.struct(*KEY, "first", "n") == F.col("example")
    run = F.struct("deck", "subs", "salts", "first", "n", "at", chosen.alias("example"))
    out = write_through(found.groupBy(*KEY).agg(F.collect_set(run).alias("runs")), "candidates")
    discard(anchors, live, marked, held, marked_with_deck)
    return out


class Line:
    """The words of a document as automata see them, with a space before and after each."""

    def __init__(self, words: list[bytes]):
        self.text = b" %b " % b" ".join(words)
        self.starts = [0, *accumulate(len(w) + 1 for w in words)]

    def cut(self, first: int, last: int) -> bytes:
        """The words ``first`` to ``last - 1``."""
        return self.text[self.starts[first] : self.starts[last] + 1]


def passages_of(line: Line, first: int, n: int, at: list[int] | None, passage: int) -> set[bytes]:
    """The passages of a run that recur: all of it, or the windows ``at`` lists.

    A long run goes in parts that share ``passage`` - 1 words, so every window stays whole in one of them.
    """
    if at is not None:
        return {line.cut(first + p, first + p + passage) for p in at}
    return {line.cut(a, min(a + PART_WORDS, first + n) + passage - 1) for a in range(first, first + n, PART_WORDS)}


def dealt(run: tuple, key: tuple, line: Line, passage: int) -> Iterator[tuple]:
    """Rows of ``DEALT``: the stretch of words under a run for every deck it streams through, and its passages, if the run is
    the example.
    """
    deck, subs, salts, first, n, at, example = run
    own = passages_of(line, first, n, at, passage) if example or subs > 1 else ()
    to = {0}
    if subs > 1:  # all windows: other runs may list some of them
        to = {zlib.crc32(p) % subs for p in own}
        to |= {zlib.crc32(line.cut(k, k + passage)) % subs for k in range(first, first + n)}
    stretch = line.cut(first, first + n + passage - 1)
    for sub in to:
        yield deck, salts, sub, hash((key[0], key[2], first)) % salts, True, *key, first, stretch
    for text in own if example else ():
        for salt in range(salts):
            yield deck, salts, zlib.crc32(text) % subs, salt, False, *key, first, text


def deal(listed: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Passages and stretches (``DEALT``) of documents (id, h1, h2, runs, text)."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    schema = pa.schema([(c.split()[0], kind) for c, kind in zip(DEALT.split(", "), kinds, strict=True)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            flat = batch.column(3).flatten()
            runs = zip(*(flat.field(k).to_pylist() for k in range(flat.type.num_fields)), strict=True)
            counts = batch.column(3).value_lengths().to_pylist()
            for key, count, text in zip(keys, counts, batch.column(4), strict=True):
                line = Line(text.as_py().encode().split())
                for run in islice(runs, count):
                    for row in dealt(run, key, line, passage):
                        made.append(row)
                        size += len(row[-1])
                        if size >= FLUSH_BYTES:
                            yield batch_of(made)
                            made, size = [], 0
        if made:
            yield batch_of(made)

    return map_batches(listed.select(*KEY, "runs", "text"), rows, DEALT)


def occurrences(passages: list[str], stretches: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Where the passages stand in batches of stretches, by one automaton: (stretch, passage, begin, end, times), in words of
    the stretch; places of one passage that touch or overlap are one, found ``times`` times. Send it a list of stretches.
    """
    import ahocorasick

    automaton, sizes = ahocorasick.Automaton(), np.array([p.count(" ") - 1 for p in passages])
    for i, text in enumerate(passages):
        automaton.add_word(text, i)
    automaton.make_automaton()
    while True:
        whole = "".join(stretches)
        hits = np.fromiter(chain.from_iterable(automaton.iter(whole)), np.int64).reshape(-1, 2)
        spaces = np.flatnonzero(np.frombuffer(whole.encode("utf-32-le"), np.uint32) == 32)
        bounds = np.cumsum([0, *(t.count(" ") for t in stretches)])
        last = np.searchsorted(spaces, hits[:, 0])
        of, which = np.searchsorted(bounds, last, "right") - 1, hits[:, 1]
        end = last - bounds[of]
        order = np.lexsort((end, which, of))
        of, which, end = of[order], which[order], end[order]
        begin = end - sizes[which]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (which[1:] != which[:-1]) | (begin[1:] > end[:-1])
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(of)))
        stretches = yield of[at], which[at], begin[at], end[at + times - 1], times


def found_places(rows: DataFrame) -> DataFrame:
    """``FOUND`` places of the passages among rows of ``DEALT``; a passage has one number in all salts of its deck."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOUND.split(", ")])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, search = None, set(), None
        for batch in (b for b in batches if b.num_rows):
            marks = np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in range(5)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                *group, stream = marks[:, a].tolist()
                if group != now:
                    now, passages, search = group, set(), None
                texts = batch.column(9).slice(a, b - a).to_pylist()
                if not stream:
                    passages.update(texts)
                elif passages:
                    if search is None:
                        search = occurrences(sorted(passages), texts)
                        hits = next(search)
                    else:
                        hits = search.send(texts)
                    of, which, begin, end, times = hits
                    key = [batch.column(k).slice(a, b - a).take(pa.array(of)) for k in (5, 6, 7, 8)]
                    first = key[3].to_numpy()
                    columns = [*(np.full(len(of), g) for g in group[:3]), which, *key[:3], first + begin, first + end, times]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], names)

    met = rows.repartition(partitions(rows), *GROUP).sortWithinPartitions(*GROUP, "stream")
    return map_batches(met, locate, FOUND)


def recurring_places(texts: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(id, h1, h2, places): the stretches (begin, end) of words of ``texts`` (id, h1, h2, text) that stand elsewhere too."""
    listed = candidate_runs(texts, passage, gram)
    held = marked_by(texts, listed, KEY, "maybe").where("maybe").join(listed, KEY)
    places = write_through(found_places(deal(held, passage)), "found")
    name = ["deck", "salts", "sub", "passage"]
    refuted = places.groupBy(*name).agg(F.sum("times").alias("times")).where("times = 1").select(*name)
    refuted = write_through(refuted, "refuted")
    kept = places.join(refuted, name, "left_anti").groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("places"))
    kept = write_through(kept, "places")
    discard(listed, places, refuted)
    return kept


def covered(sizes: list[int], of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Which words of documents of ``sizes`` words stand in one of the places: of document ``of[i]``, from ``begin[i]`` to
    ``end[i] - 1``.
    """
    base = np.cumsum([0, *(n + 1 for n in sizes)])
    length = int(base[-1]) + 1
    depth = np.bincount(base[of] + begin, minlength=length) - np.bincount(base[of] + end, minlength=length)
    inside = np.cumsum(depth) > 0
    return [inside[b : b + n] for b, n in zip(base.tolist(), sizes, strict=False)]


def remove_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text`` (the kept words, joined by one space) to documents (doc_id, text)."""
    row = F.col("_row")
    text = text_of(row["text"])
    digest = F.md5(text.cast("binary"))
    halves = (F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(k) for at, k in ((1, "h1"), (17, "h2")))
    keyed = wrapped(docs).select("_row", F.coalesce(row["doc_id"].cast("long"), F.lit(-(2**63))).alias("id"), *halves, text.alias("text"))
    places = recurring_places(keyed.select(*KEY, "text"), passage, gram)
    rest = F.struct(*(row[c].alias(c) for c in docs.columns if c != "text"))
    keyed = marked_by(keyed.select(rest.alias("_rest"), *KEY, "text"), places, KEY, "maybe")
    joined = keyed.where("maybe").join(places, KEY, "left").select("_rest", "text", "places")
    joined = joined.union(keyed.where("NOT maybe").select("_rest", "text", F.lit(None).alias("places")))
    schema = joined.select("_rest", F.lit("").alias("text"), F.lit(1).cast("long").alias("n_words"), F.lit(1).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), SLICE_BYTES):
                own = batch.slice(part.first, part.n)
                words = [[w.decode() for w in (t or "").encode().split()] for t in own.column(1).to_pylist()]
                n_words, flat = [len(w) for w in words], own.column(2).flatten()
                of = np.repeat(np.arange(part.n), pc.fill_null(own.column(2).value_lengths(), 0).to_numpy())
                gone = covered(n_words, of, flat.field(0).to_numpy(), flat.field(1).to_numpy())
                kept = [" ".join([w for w, g in zip(ws, gs.tolist(), strict=True) if not g]) if gs.any() else " ".join(ws) for ws, gs in zip(words, gone, strict=True)]
                n_gone = [int(g.sum()) for g in gone]
                columns = [own.column(0), own.column(1), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["_rest", "text", "n_words", "n_removed", "kept_text"])

    removed = map_batches(joined, remove, schema)
    new = ("n_words", "n_removed", "kept_text")
    return removed.select(*(F.col("_rest")[c].alias(c) for c in docs.columns if c != "text" and c not in new), "text", *new)
