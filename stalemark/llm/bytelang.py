"""Language ID by a bidirectional gated recurrent network over bytes.

The network is trained in numpy, by backpropagation through time, on words of a bounded sample of labelled documents. It
reads each word byte by byte in both directions and labels every byte; a document's probabilities are the mean over all
its bytes. Words are read whole (if longer, in pieces of about ``PIECE`` bytes that end with a character; training draws
from all pieces) and don't depend on their neighbours, so a word
that comes back in a slice of documents is read once and counted as often as it stands there.

Every language with a label is learned. The sample holds about ``DOCS_PER_LANGUAGE`` documents of each, up to 64 languages;
with more it stays at about ``DOCS`` documents in all, but never below ``LEAST_DOCS`` of a language, so from 1,600
languages on it grows with their number, as do the network, the steps (each of ``BATCH`` words; languages take turns if
they are more) and the memory of a step and of scoring.

Edge cases: ``und`` and score 0 for a null text, a text without a letter, or if nothing was learned; a null lang teaches
nothing; a null doc_id is not held out and teaches nothing; rows that repeat teach once and get equal answers; ties go to the language
first by code point. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stalemark.llm.frames import WORD, map_batches, write_through
from stalemark.llm.texts import LOWER, Slice, expand, slices, word_hashes

HIDDEN = 12
PIECE = 24
DOCS_PER_LANGUAGE = 500  # expected; the sample is drawn by hash
DOCS, LEAST_DOCS = 32_000, 20
WORDS_PER_DOC = 60
STEPS, BATCH = 300, 512
NONE = "und"
SLICE_BYTES = 2 << 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """``inputs``: the three gates of each byte; ``recur``: of the state; ``out``: labels of both states; by direction."""

    languages: list[str]
    inputs: list[np.ndarray]
    recur: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def some(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.3, shape).astype(np.float32)

        n = len(languages)
        return cls(languages, [some(256, 3 * hidden) for _ in "fb"], [some(hidden, 3 * hidden) for _ in "fb"], [some(hidden, n) for _ in "fb"], np.zeros(n, np.float32))

    def run(self, codes: np.ndarray, side: int, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (steps, words, hidden) over ``codes`` (words, steps); with ``keep``, what the way back needs."""
        h = self.recur[side].shape[0]
        state, states, kept = np.zeros((len(codes), h), np.float32), [], []
        for t in range(codes.shape[1]):
            x = self.inputs[side][codes[:, t]]
            u = state @ self.recur[side]
            gates = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            if keep:
                kept.append((state, z, r, n, u[:, 2 * h :]))
            state = n + z * (state - n)
            states.append(state)
        return np.stack(states), kept

    def labels(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (steps, words, languages) of every byte; those past a word's length mean nothing."""
        ahead, _ = self.run(codes, 0)
        back, _ = self.run(turned(codes, lengths), 1)
        at = np.clip(lengths[None, :] - 1 - np.arange(codes.shape[1])[:, None], 0, None)
        back = back[at, np.arange(len(codes))[None, :]]
        logits = ahead @ self.out[0] + back @ self.out[1] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=2, keepdims=True)

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss per byte and the gradient of each parameter, in the order of ``parameters``."""
        h, steps = self.recur[0].shape[0], codes.shape[1]
        words = np.arange(len(codes))
        both = [codes, turned(codes, lengths)]
        runs = [self.run(c, side, keep=True) for side, c in enumerate(both)]
        at = np.clip(lengths[None, :] - 1 - np.arange(steps)[:, None], 0, None)
        inside = (np.arange(steps)[:, None] < lengths[None, :])[:, :, None]
        back = runs[1][0][at, words[None, :]]
        logits = runs[0][0] @ self.out[0] + back @ self.out[1] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        total = inside.sum()
        loss = -float(np.log(p[:, words, labels] + 1e-12)[inside[:, :, 0]].sum() / total)
        p[:, words, labels] -= 1
        d = np.where(inside, p, 0).astype(np.float32) / np.float32(total)
        into_back = np.zeros_like(runs[1][0])
        np.add.at(into_back, (at, words[None, :]), d @ self.out[1].T)
        into = [d @ self.out[0].T, into_back]
        d_out = [np.tensordot(s, d, ((0, 1), (0, 1))) for s in (runs[0][0], back)]
        d_inputs, d_recur = [], []
        for side in (0, 1):
            d_in, d_rec, d_state = np.zeros_like(self.inputs[side]), np.zeros_like(self.recur[side]), np.zeros((len(codes), h), np.float32)
            for t in range(steps - 1, -1, -1):
                state, z, r, n, un = runs[side][1][t]
                g = d_state + into[side][t]
                dn = g * (1 - z) * (1 - n * n)
                gates = np.concatenate([g * (state - n) * z * (1 - z), dn * un * r * (1 - r), dn], axis=1)
                np.add.at(d_in, both[side][:, t], gates)
                gates[:, 2 * h :] = dn * r
                d_rec += state.T @ gates
                d_state = g * z + gates @ self.recur[side].T
            d_inputs.append(d_in)
            d_recur.append(d_rec)
        return loss, [*d_inputs, *d_recur, *d_out, d.sum(axis=(0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recur, *self.out, self.bias]


def turned(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each word backwards, within its length."""
    at = np.clip(lengths[:, None] - 1 - np.arange(codes.shape[1])[None, :], 0, None)
    return np.take_along_axis(codes, at, axis=1)


def as_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(lengths.max())), np.uint8)
    for i, w in enumerate(words):
        codes[i, : len(w)] = np.frombuffer(w, np.uint8)
    return codes, lengths


def train(words: list[bytes], labels: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> Network:
    """A network fitted to words of known language, each language as often as any other, by Adam. A step takes words of
    ``batch`` languages at most; ``steps`` is how often each has its turn.
    """
    net, rng = Network.fresh(languages, seed=seed), np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == k) for k in range(len(languages))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    turns = -(-len(by_label) // batch)
    steps *= turns
    order = np.arange(len(by_label))
    for step in range(1, steps + 1):
        if turns > 1 and step % turns == 1:
            order = rng.permutation(len(by_label))
        some = order[(step - 1) % turns :: turns]
        chosen = np.concatenate([rng.choice(by_label[k], -(-batch // len(some))) for k in some])
        codes, lengths = as_codes([words[i] for i in chosen])
        _, grads = net.gradients(codes, lengths, labels[chosen])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def pieces_of(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice cut into pieces, between characters: starts, ends, and where each document's pieces begin."""
    starts, ends, bounds = part.words()
    counts = -(-(ends - starts) // PIECE)
    place = expand(np.zeros(len(starts), np.int64), counts)
    begin = np.repeat(starts, counts) + PIECE * place
    for _ in range(3):  # back to the first byte of a character
        begin -= ((part.data[begin] & 0xC0) == 0x80) & (place > 0)
    bound = np.concatenate([[0], np.cumsum(counts)])
    end = np.append(begin[1:], 0)[: len(begin)]
    end[bound[1:] - 1] = ends
    return begin, end, bound[bounds]


def document_probabilities(net: Network, part: Slice) -> np.ndarray:
    """The mean of the probabilities of all bytes of each document's words; zeros without words."""
    data = LOWER[part.data]
    starts, ends, bounds = pieces_of(part)
    sums = np.zeros((part.n, len(net.languages)))
    if not len(starts):
        return sums
    _, first, where = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[first]
    order = np.argsort(lengths, kind="stable")
    each = np.empty((len(first), len(net.languages)), np.float32)
    block = max(64, min(4096, (1 << 20) // len(net.languages)))
    for at in range(0, len(order), block):
        some = order[at : at + block]
        n = lengths[some]
        place = starts[first[some]][:, None] + np.arange(int(n.max()))[None, :]
        codes = data[np.minimum(place, len(data) - 1)]
        p = net.labels(codes, n)
        p *= (np.arange(int(n.max()))[:, None] < n[None, :])[:, :, None]
        each[some] = p.sum(axis=0)
    full = np.flatnonzero(np.diff(bounds))
    total = np.add.reduceat(each[where], bounds[:-1][full], axis=0, dtype=np.float64)
    sums[full] = total / np.add.reduceat(ends - starts, bounds[:-1][full])[:, None]
    return sums


def has_letter(part: Slice) -> np.ndarray:
    """Which documents have a letter."""
    ascii_letters = np.concatenate([[0], np.cumsum((LOWER[part.data] >= 97) & (LOWER[part.data] <= 122))])
    found = np.diff(ascii_letters[part.bounds]) > 0
    for i in np.flatnonzero(~found).tolist():
        text = part.data[part.bounds[i] : part.bounds[i + 1]].tobytes().decode()
        found[i] = any(map(str.isalpha, text))
    return found


def training_words(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, per_doc: int = WORDS_PER_DOC) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Words, their labels and the languages, from about ``per_language`` documents (doc_id, text, lang) of each, or fewer
    of each of many languages.

    Rows equal in doc_id, text and lang count once. The shares are a table of one row per language, as many as the network has labels, so it may be broadcast.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(F.col("text").rlike(WORD))
    known = known.select("lang", "text", F.xxhash64(F.lit(7), "doc_id", "text").alias("key"))
    counts = write_through(known.groupBy("lang").agg(F.approx_count_distinct("key").alias("count")), "languages")
    if not (n := counts.count()):
        return [], np.zeros(0, np.int64), []
    each = min(per_language, max(LEAST_DOCS, DOCS // n))
    shares = counts.select("lang", (each / F.col("count")).alias("share"))
    drawn = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(shares), "lang").where(drawn < F.col("share"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch.column(0), SLICE_BYTES):
                data = LOWER[part.data]
                starts, ends, bounds = pieces_of(part)
                for first, n in zip(bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True):
                    chosen = first + np.random.default_rng(n).choice(n, min(per_doc, n), replace=False) if n else []
                    found.append([data[starts[k] : ends[k]].tobytes() for k in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.binary()))], names=["lang", "key", "words"])

    rows = map_batches(sample.select("text", "lang", "key"), some, "lang string, key long, words array<binary>")
    rows = rows.groupBy("lang", "key").agg(F.first("words").alias("words")).collect()
    languages = sorted({r["lang"] for r in rows if r["words"]})
    place = {lang: k for k, lang in enumerate(languages)}
    pairs = sorted((place[r["lang"]], bytes(w)) for r in rows for w in r["words"])
    return [w for _, w in pairs], np.array([k for k, _ in pairs], np.int64), languages


def label_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to documents with a column text; every other column passes through."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*(F.col(f"`{c}`") for c in columns), F.lit("").alias("lang_pred"), F.lit(0.5).alias("score")).schema
    text_at = columns.index("text")
    size = SLICE_BYTES * 16 // max(16, len(net.languages) if net else 0)  # the more languages, the fewer words at once

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(text_at), size):
                found, score = [NONE] * part.n, np.zeros(part.n)
                if net is not None:
                    p = document_probabilities(net, part)
                    sure = has_letter(part)
                    score = np.where(sure, np.minimum(p.max(axis=1), 1.0), 0.0)
                    found = [net.languages[k] if s else NONE for k, s in zip(p.argmax(axis=1), sure, strict=True)]
                own = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    return map_batches(docs.select(*(F.col(f"`{c}`") for c in columns)), label, schema)


def least_score(net: Network) -> float:
    """The score below which a text is hardly in any learned language: a little above what chance would give.

    With four languages or fewer, an eighth of the way from chance to certainty; with more, 1.375 times chance. One language
    alone rejects nothing.
    """
    n = len(net.languages)
    return (1 + min(3, n - 1) / 8) / n if n > 1 else 0.0


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_languages(docs: DataFrame) -> Network | None:
    """A network trained on a sample of the documents that are not held out."""
    words, labels, languages = training_words(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return train(words, labels, languages) if languages else None
