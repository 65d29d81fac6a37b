"""Packing token sequences by the sum-of-squares rule, best fit among equals.

Documents become token ids; each that is longer than the capacity is cut into full pieces and a rest, and every full
piece is a sequence of its own. The rests are packed in chunks of ``ITEMS_PER_CHUNK``, longest first: a rest goes where
the sum over gaps of (open sequences with that gap)² becomes smallest, a new sequence included; among equal sums, where
the smallest gap remains. Only the lengths matter to the rule, so a chunk is packed from thin rows.

Edge cases: a null or empty text is the end-of-document id alone; a null doc_id stays null; rows that repeat are packed
each; an empty table gives an empty result; texts of any length are tokenised whole, the longest in the memory of one task;
among rests of one length any order is as good, since only lengths matter; only doc_id and text are read, so other
columns, of any name, are left out.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stalemark.llm.frames import map_batches

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
ITEMS_PER_CHUNK = 40_000
CACHED_WORDS = 600_000

#: Letters of Latin-1, composed and with one lower case each, and a mark behind them.
LATIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,])?")
#: How byte-level models write bytes: printable ones as they are, the others from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = [chr(b) if b in PRINTABLE else chr(256 + sum(x not in PRINTABLE for x in range(b))) for b in range(256)]

#: How a tokenizer file must treat text before its model sees words, for ``WordEncoder`` to be right.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def reads_words_alone(path: str) -> bool:
    """Does the tokenizer file fold case, drop white space and split as ``WordEncoder`` takes it to?"""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    return (
        parts["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS}
        and parts["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, BYTE_LEVEL]}
        and parts["post_processor"] is None
        and all(t["content"].startswith("<|") for t in parts["added_tokens"])
    )


class WholeTextEncoder:
    """Token ids of texts, as little-endian bytes, by any tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class KnownWords(dict):
    """Ids of words that came back; a word is encoded when it first comes, and waits in ``rare`` until it comes again."""

    def __init__(self, encode):
        self.encode, self.rare = encode, {}

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.rare.pop(word, None)) is None:
            ids = self.rare[word] = self.encode(word)
        else:
            self[word] = ids
        return ids


class WordEncoder:
    """Token ids of texts, as little-endian bytes, by way of a bounded cache of words.

    Right for tokenizers that ``reads_words_alone`` accepts, like the default one, which drops white space before it looks at words and ignores case: what stands between two
    spaces is encoded alike wherever it stands. Latin words need no normalising, so they go straight to the tokenizer's
    model.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, KnownWords(self._ids)
        self.model = self.tokenizer.model

    def _ids(self, word: bytes) -> bytes:
        found = LATIN_WORD.fullmatch(text := word.decode())
        if found:
            parts = [p.lower().encode() for p in found.groups() if p]
            ids = [t.id for p in parts for t in self.model.tokenize("".join([BYTE_CHARS[b] for b in p]))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        data = text.encode()
        if b"<|" in data:  # special tokens are told apart by case
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.known
        out = b"".join(map(known.__getitem__, data.lower().split()))
        for words in (known, known.rare):
            if len(words) > self.most:
                words.clear()
        return out


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """The pieces of each document (doc_id, text): piece number, ids before it, length, and the CRC-32 of its ids."""
    path = tokenizer or default_tokenizer()
    kind = WordEncoder if reads_words_alone(path) else WholeTextEncoder
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = kind(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its sequence (from 0) and its offset there."""
    order = np.argsort(-lengths, kind="stable")
    open_at = np.zeros(capacity + 1, np.int64)  # open sequences per gap
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for item in order:
        size = int(lengths[item])
        # Moving a sequence from gap g to g - size changes the sum by 2 (n[g - size] - n[g] + 1); a full one leaves it.
        change = 2 * (open_at[: capacity + 1 - size] - open_at[size:] + 1)
        change[0] = 1 - 2 * open_at[size]
        change[open_at[size:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * open_at[capacity - size] + 1 if size < capacity else 0
        gap = int(np.argmin(change)) + size
        if change[gap - size] < fresh or (change[gap - size] == fresh and gap < capacity):
            own = waiting[gap].pop()
            open_at[gap] -= 1
        else:
            own, gap, made = made, capacity, made + 1
        sequence[item], offset[item] = own, capacity - gap
        if gap > size:
            open_at[gap - size] += 1
            waiting[gap - size].append(own)
    return sequence, offset


def pack(pieces: DataFrame, rows: int, capacity: int = CAPACITY, chunk: int = ITEMS_PER_CHUNK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32).

    ``rows`` is about the number of pieces shorter than the capacity; it sets how many tasks pack. A task reads its
    pieces in the order of a hash and packs one chunk after another, so its memory doesn't depend on its rows.
    """
    tasks = max(1, -(-rows // chunk))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = F.xxhash64(*names)
    dealt = pieces.select(*names, key.alias("_key")).repartition(tasks, "_key").sortWithinPartitions("_key", *names)
    schema = f"{PIECES}, {PLACES}"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id, held, n_held = TaskContext.get().partitionId() << 40, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held, n_held
            table = pa.Table.from_batches(held)
            lengths = table.column("length").to_numpy()
            short = np.flatnonzero(lengths < capacity)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            sequence[short], offset[short] = sum_of_squares(lengths[short], capacity)
            made = int(sequence[short].max()) + 1 if len(short) else 0
            full = np.flatnonzero(lengths >= capacity)
            sequence[full] = made + np.arange(len(full))
            table = table.append_column("sequence_id", pa.array(sequence + next_id)).append_column("offset", pa.array(offset))
            next_id, held, n_held = next_id + made + len(full), [], 0
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            batch = batch.select(names)
            at = 0
            while at < len(batch):
                some = batch.slice(at, 2 * chunk - n_held)
                held.append(some)
                n_held, at = n_held + len(some), at + len(some)
                if n_held >= 2 * chunk:
                    yield from flush()
        if held:
            yield from flush()

    return map_batches(dealt, place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return pack(token_pieces(docs, capacity, end_id, tokenizer), docs.count(), capacity)
