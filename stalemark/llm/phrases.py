"""Document fingerprints from the phrases of a Lempel-Ziv parse.

A text is read from left to right into phrases, each the shortest run of bytes that isn't a phrase yet. Texts that would
compress each other share phrases, so the minimum hashes of two phrase sets tell how alike the texts are. A fingerprint is
one byte of each of ``HASHES`` minima, in hexadecimal; likeness is the share of equal bytes, corrected for the 1 in 256
that agree by chance.

Every phrase without its last byte is a phrase too, so phrases are a tree that is walked byte by byte, and a text that shares
its beginning with another is parsed on from there. The hash of a phrase follows from that of the phrase it continues; phrases
of many documents are hashed together.

Edge cases: a null text is an empty one; empty texts have one fingerprint, like themselves alone; documents follow each
other by descending doc_id, those without one last, rows of one doc_id by their text; a single document is its own next.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stalemark.llm.frames import map_batches, partitions, text_of
from stalemark.llm.texts import constants, mix

HASHES = 128
ROWS_PER_BUCKET = 100
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NO_PHRASE = np.full(HASHES, 0xFFFFFFFF, np.uint32)
_FACTORS = constants(4, HASHES)
FACTORS = (_FACTORS & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
SHIFTS = (_FACTORS >> np.uint64(32)).astype(np.uint32)[:, None]
STEP = 1009  # above any byte; a prime, so that the keys of a tree spread in its dict
PHRASES_AT_ONCE = 1 << 16
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)


def parse(data: bytes, begin: int, known: set[bytes]) -> tuple[list[bytes], int]:
    """Add the phrases of ``data`` from ``begin`` on to ``known``; the new ones, and where an unfinished one begins.

    The plain form, for one text and its phrases as bytes; ``Phrases`` finds the same ones, as hashes, for many texts.
    """
    new, at, end, size = [], begin, len(data), 4
    while at < end:
        size = min(size, end - at)
        if data[at : at + size] in known:
            size += 1
            while at + size <= end and data[at : at + size] in known:
                size += 1
            if at + size > end:
                break
        else:
            while size > 1 and data[at : at + size - 1] not in known:
                size -= 1
        phrase = data[at : at + size]
        known.add(phrase)
        new.append(phrase)
        at += size
    return new, at


def grow(data: bytes, tree: dict[int, int], at: int, last: int) -> int:
    """Add the phrases of ``data`` to ``tree``, walked on from ``at``; where the walk stands in the end.

    A phrase is ``STEP`` times its number, the empty one 0. The tree maps a phrase plus a byte to the phrase one byte longer;
    new ones are numbered after ``last``.
    """
    find = tree.get
    for byte in data:
        key = at + byte
        at = find(key, 0)
        if not at:
            last += STEP
            tree[key] = last
    return at


class Phrases:
    """The phrases of many texts, numbered through."""

    def __init__(self):
        self.keys, self.count = [], 0

    def add(self, data: bytes, tree: dict[int, int], at: int = 0) -> tuple[int, slice]:
        """Grow a tree; where its walk stands, and the numbers of the new phrases, from 0."""
        old, first = len(tree), self.count
        at = grow(data, tree, at, first * STEP)
        self.keys.append(np.fromiter(islice(tree, old, None), np.int64, len(tree) - old))
        self.count += len(tree) - old
        return at, slice(first, self.count)

    def codes(self) -> np.ndarray:
        """The CRC-32 of each phrase, found from that of the phrase it continues, shorter phrases first."""
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        above = keys // STEP
        byte = (keys - above * STEP).astype(np.uint32)
        number = np.arange(1, self.count + 1)
        state, known = np.full(self.count + 1, 0xFFFFFFFF, np.uint32), np.zeros(self.count + 1, bool)
        known[0] = True
        while len(number):
            ready = known[above]
            go, wait = np.flatnonzero(ready), np.flatnonzero(~ready)
            now, before = number[go], state[above[go]]
            state[now] = CRC[(before ^ byte[go]) & 255] ^ (before >> 8)
            known[now] = True
            number, above, byte = number[wait], above[wait], byte[wait]
        return ~state[1:]


def hashed(codes: np.ndarray) -> np.ndarray:
    return (mix(codes.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def least(values: np.ndarray, so_far: np.ndarray = NO_PHRASE) -> np.ndarray:
    """The least value of each hash over the phrases with ``values`` and ``so_far``."""
    for at in range(0, len(values), 1024):
        part = values[None, at : at + 1024] * FACTORS
        part += SHIFTS
        so_far = np.minimum(so_far, part.min(axis=1))
    return so_far


def minima(phrases: list[bytes], so_far: np.ndarray = NO_PHRASE) -> np.ndarray:
    """The least value of each hash over ``phrases`` and ``so_far``."""
    return least(hashed(np.array([zlib.crc32(p) for p in phrases], np.uint64)), so_far)


def low_bytes(minima_: np.ndarray) -> np.ndarray:
    return mix(minima_.astype(np.uint64)).astype(np.uint8)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return max(0.0, (float((one == other).mean()) - 1 / 256) / (1 - 1 / 256))


def fingerprint(text: str) -> np.ndarray:
    found = Phrases()
    found.add(text.encode(), {})
    return low_bytes(least(hashed(found.codes())))


def edited(text: str, following: str) -> tuple[str, int]:
    """``text`` with its last half replaced by the first of ``following``, and the characters that stay."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half], len(text) - half


def add_both(found: Phrases, text: str, other: str, common: int) -> tuple[slice, slice, slice]:
    """The phrases of two texts: those of their first ``common`` characters, parsed once, and those of the rest of each."""
    tree: dict[int, int] = {}
    at, head = found.add(text[:common].encode(), tree)
    again = tree.copy()
    _, one = found.add(text[common:].encode(), tree, at)
    _, two = found.add(other[common:].encode(), again, at)
    return head, one, two


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text): documents in buckets of neighbouring ids, highest id first, and after them as a
    guest the document that follows the bucket's last.

    Quantiles of the ids cut the buckets; the first id of each is a table of one row a bucket.
    """
    rows = docs.count()
    buckets = max(1, min(8 * partitions(docs), rows // ROWS_PER_BUCKET))
    docs = docs.select(F.col("doc_id").cast("long"), text_of(F.col("text")).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else []
    bounds = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts or [])))).cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))))
    placed = docs.withColumn("bucket", bucket)
    heads = placed.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head"))
    # A bucket's first document visits the bucket above; the very first one visits the lowest.
    order, everything = Window.orderBy("bucket"), Window.partitionBy()
    heads = heads.withColumn("host", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(everything)))
    visits = heads.select(F.col("head").alias("_head"), F.col("host").alias("_host"), F.col("bucket").alias("_from"))
    joined = placed.join(F.broadcast(visits), placed["doc_id"].eqNullSafe(F.col("_head")) & (F.col("bucket") == F.col("_from")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_host").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, guest))
    return joined.select(F.inline(places), "doc_id", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each of documents (doc_id, text) and of its edited text, and their likeness."""
    order = ["bucket", "guest", F.col("doc_id").desc_nulls_last(), "text"]
    dealt = in_order(docs).repartition(partitions(docs), "bucket").sortWithinPartitions(*order)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int | None, str]]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, found, pending, before = [], Phrases(), [], None

        def finish(following: str) -> tuple:
            """What is known of the document that waits, now that the next is known, and its phrases."""
            doc_id, text = waiting
            changed, common = edited(text, following)
            return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()), add_both(found, text, changed, common)

        def hash_pending() -> None:
            """Make rows of the documents parsed so far; the last one's waits for its likeness to the next."""
            nonlocal found, before
            values = hashed(found.codes())
            for known, (head, one, two) in pending:
                shared = least(values[head])
                own = low_bytes(least(values[one], shared))
                if before is not None:
                    made.append((*before, likeness(before[3], own)))
                before = None if known is None else (*known, own, low_bytes(least(values[two], shared)))
            found = Phrases()
            pending.clear()

        bucket, waiting, done = None, None, False
        for now, guest, doc_id, text in rows(batches):
            if now != bucket:
                bucket, waiting, done = now, None, False
            if done:
                continue  # one guest is enough
            if waiting is not None:
                pending.append(finish(text))
            waiting = (doc_id, text)
            if guest:  # it ends the bucket: its own row is made where it is at home
                pending.append((None, add_both(found, text, text, len(text))))
                done = True
            if found.count >= PHRASES_AT_ONCE or len(pending) >= 1000:
                hash_pending()
            if len(made) >= 1000:
                yield batch_of(made)
                made = []
        hash_pending()
        if made:
            yield batch_of(made)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        doc_id, n, sha, one, two, near = zip(*made, strict=True)
        columns = [doc_id, n, sha, [x.tobytes().hex() for x in one], [x.tobytes().hex() for x in two], [likeness(a, b) for a, b in zip(one, two, strict=True)], near]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return map_batches(dealt.select("bucket", "guest", "doc_id", "text"), compare, FINGERPRINTS)
