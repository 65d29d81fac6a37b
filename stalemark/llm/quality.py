"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the inner product of two short vectors. For a document the sum over all pairs is
half of (sum of v x)² - sum of (v x)², so a score costs one pass over its words. The model is fitted in numpy to a bounded
sample of labelled rows; scoring covers every word of every document.

Edge cases: a null text is an empty one and gets a score from its statistics; null or missing metadata counts as 0; labels
that are null or not 0 or 1 teach nothing, a document labelled twice teaches twice, equal rows of one id teach once; with no label at all, or of one kind
only, every score is the share of ones learned (0.5 if none). Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stalemark.llm.frames import map_batches, write_through
from stalemark.llm.texts import LOWER, Slice, slices, word_hashes

BUCKETS = 1 << 15
RANK = 6
TRAINING_ROWS = 4_000
EPOCHS, BATCH = 8, 64
THRESHOLD = 0.7
SLICE_BYTES = 4 << 20
STATISTICS = 12


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(characters)] = 1
    return out


UPPER = _class(bytes(range(65, 91)))
DIGIT = _class(b"0123456789")
SYMBOL = _class(b"#$%&*+<=>@[]^_`{|}~/\\")
SHOUT = _class(b"!?")
MARK = _class(b".,;:'\"()-")


@dataclass
class Features:
    """Word features (row, bucket, value), the rows sorted, and dense statistics, of some documents."""

    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def features(part: Slice, metadata: np.ndarray) -> Features:
    """Buckets of each document's words, valued by the root of their share in it, and its statistics."""
    lower = LOWER[part.data]
    starts, ends, bounds = part.words()
    hashes = word_hashes(lower, starts, ends)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(part.n), counts)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    keys, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
    row = keys // BUCKETS
    value = np.sqrt(times / np.maximum(counts, 1)[row]).astype(np.float32)
    size = np.diff(part.bounds)

    def share(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[part.data])])[part.bounds]) / np.maximum(size, 1)

    newline = np.zeros(256)
    newline[10] = 1
    most = np.zeros(part.n)
    np.maximum.at(most, row, times)
    letters = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[bounds])
    per_word = np.maximum(counts, 1)
    dense = np.stack(
        [
            np.log1p(size), np.log1p(counts), letters / per_word / 10, share(UPPER), share(DIGIT), share(SYMBOL), share(SHOUT),
            share(MARK), share(newline) * 10, np.bincount(row, minlength=part.n) / per_word, most / per_word, (counts == 0) * 1.0,
        ],
        axis=1,
    )
    return Features(row, keys % BUCKETS, value, np.concatenate([dense, metadata], axis=1))


@dataclass
class Machine:
    """Weights of words then of statistics; statistics are centred and scaled first."""

    base: float
    weights: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def parts(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The score before the logistic function, the sums of v x, and the scaled statistics."""
        n = len(f.dense)
        dense = np.clip((f.dense - self.mean) / self.scale, -5, 5).astype(np.float32)
        total = self.base + dense @ self.weights[BUCKETS:]
        sums = dense @ self.vectors[BUCKETS:]
        squares = (dense**2) @ (self.vectors[BUCKETS:] ** 2)
        if len(f.row):
            full, at = np.unique(f.row, return_index=True)
            moved = self.vectors[f.bucket] * f.value[:, None]
            total[full] += np.add.reduceat(self.weights[f.bucket] * f.value, at)
            sums[full] += np.add.reduceat(moved, at, axis=0)
            squares[full] += np.add.reduceat(moved**2, at, axis=0)
        assert len(total) == n
        return total + 0.5 * (sums**2 - squares).sum(axis=1), sums, dense

    def score(self, f: Features) -> np.ndarray:
        return 0.5 * np.tanh(0.5 * self.parts(f)[0].astype(np.float64)) + 0.5


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 6) -> Machine:
    """A machine fitted to (label, buckets, values, statistics) by Adagrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    labels = np.array([r[0] for r in rows], np.float32)
    dense = np.stack([r[3] for r in rows])
    n = BUCKETS + dense.shape[1]
    share = np.clip(labels.mean(), 0.01, 0.99)
    model = Machine(float(np.log(share / (1 - share))), np.zeros(n, np.float32), rng.normal(0, 0.05, (n, RANK)).astype(np.float32), dense.mean(axis=0), dense.std(axis=0) + 1e-6)
    seen_w, seen_v = np.full(n, 1e-4, np.float32), np.full((n, RANK), 1e-4, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = [len(rows[i][1]) for i in some]
            f = Features(np.repeat(np.arange(len(some)), sizes), np.concatenate([rows[i][1] for i in some]), np.concatenate([rows[i][2] for i in some]), dense[some])
            raw, sums, x = model.parts(f)
            error = ((0.5 * np.tanh(0.5 * raw) + 0.5) - labels[some]) / len(some)
            index = np.concatenate([f.bucket, np.tile(np.arange(BUCKETS, n), len(some))])
            row = np.concatenate([f.row, np.repeat(np.arange(len(some)), dense.shape[1])])
            value = np.concatenate([f.value, x.ravel()]).astype(np.float32)
            pull = (error[row] * value)[:, None]
            which, where = np.unique(index, return_inverse=True)
            gw = np.bincount(where, pull[:, 0], len(which)).astype(np.float32) + 1e-5 * model.weights[which]
            each = pull * (sums[row] - model.vectors[index] * value[:, None])
            gv = np.stack([np.bincount(where, each[:, k], len(which)) for k in range(RANK)], axis=1).astype(np.float32) + 1e-5 * model.vectors[which]
            seen_w[which] += gw**2
            seen_v[which] += gv**2
            model.weights[which] -= 0.1 * gw / np.sqrt(seen_w[which])
            model.vectors[which] -= 0.05 * gv / np.sqrt(seen_v[which])
            model.base -= 0.05 * float(error.sum())
    return model


def _metadata(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Logarithms of numeric columns."""
    columns = [np.log1p(np.abs(pc.fill_null(batch.column(n).cast(pa.float64(), safe=False), 0.0).to_numpy(zero_copy_only=False))) for n in names]
    return np.nan_to_num(np.stack(columns, axis=1)) if columns else np.zeros((len(batch), 0))


def training_rows(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = (), most: int = TRAINING_ROWS) -> list:
    """Features of documents (doc_id, text) that are among the first ``most`` of ``labels`` (doc_id, label) in the order of
    a hash. Of documents that share an id, equal ones count once, and the first ``most`` by a hash of the whole are taken.
    """
    few = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id", "label").limit(most)
    few = few.select("doc_id", F.col("label").cast("int").alias("label"), F.monotonically_increasing_id().alias("_label"))
    place = F.xxhash64(F.lit(6), "doc_id", "text", *metadata).alias("_place")
    found = docs.join(F.broadcast(few), "doc_id").select("text", "label", *metadata, "_label", place)
    found = write_through(found.dropDuplicates(["_place", "_label"]), "labelled")
    first = found.select("_place", "_label").orderBy("_place", "_label").limit(most)
    found = found.join(F.broadcast(first), ["_place", "_label"]).select("text", "label", *metadata)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = _metadata(batch, metadata)
            for part in slices(batch.column(0), SLICE_BYTES):
                f = features(part, extra[part.first : part.first + part.n])
                cut = np.searchsorted(f.row, np.arange(part.n + 1))
                label = batch.column(1).slice(part.first, part.n)
                made = [[x[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (f.bucket.astype(np.int32), f.value)]
                yield pa.RecordBatch.from_arrays(
                    [label, pa.array(made[0], pa.list_(pa.int32())), pa.array(made[1], pa.list_(pa.float32())), pa.array(list(f.dense), pa.list_(pa.float64()))], names=["label", "buckets", "shares", "dense"]
                )

    table = map_batches(found, rows, "label int, buckets array<int>, shares array<float>, dense array<double>").toArrow()
    columns = [table.column(0).to_pylist(), *([x.values.to_numpy(zero_copy_only=False) for x in table.column(k)] for k in (1, 2, 3))]
    out = [(y, b.astype(np.int64), v, d) for y, b, v, d in zip(*columns, strict=True)]
    return sorted(out, key=lambda r: (r[0], r[3].tolist(), r[1].tolist()))


def learn_quality(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ()) -> Machine | float:
    """A machine, or the share of ones if there is nothing to tell apart."""
    rows = training_rows(docs, labels, metadata)
    ones = sum(r[0] for r in rows)
    if not rows:
        return 0.5
    return fit(rows) if 0 < ones < len(rows) else ones / len(rows)


def score_documents(docs: DataFrame, model: Machine | float, metadata: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` to documents with a column text; every other column passes through."""
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*(F.col(f"`{c}`") for c in columns), F.lit(0.5).alias("score"), F.lit(1).alias("predicted")).schema
    text_at = columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = _metadata(batch, metadata)
            for part in slices(batch.column(text_at), SLICE_BYTES):
                if isinstance(model, float):
                    found = np.full(part.n, model)
                else:
                    found = model.score(features(part, extra[part.first : part.first + part.n]))
                own = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    return map_batches(docs.select(*(F.col(f"`{c}`") for c in columns)), score, schema)


