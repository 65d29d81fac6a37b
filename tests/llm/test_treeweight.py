"""Context-tree weighting against a recursion over plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stalemark.llm import texts, treeweight
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, held boolean"
END = b"\n"


def tokens(text):
    return brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [END]


def stream(text):
    return b"".join(t + b" " for t in tokens(text)[:-1]) + END


class Trees:
    """Counts of (context, bits so far) in dictionaries, and weighted probabilities by the recursion itself."""

    def __init__(self, streams, depth):
        self.depth, self.counts, self.longer, self.known = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for s in streams:
            for context, prefix, bit in self.decisions(s):
                for length in range(depth + 1):
                    self.counts[context[depth - length :], prefix][bit] += 1
                    if length:
                        self.longer[context[depth - length + 1 :], prefix].add(context[depth - length :])

    def decisions(self, s):
        padded = END * self.depth + s
        for at, byte in enumerate(s):
            for i in range(8):
                yield padded[at : at + self.depth], (256 + byte) >> (8 - i), byte >> (7 - i) & 1

    def estimate(self, context, prefix):
        zeros, ones = self.counts[context, prefix]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def parts(self, context, prefix):
        """ln of the own estimate and of the product of the longer contexts' weighted probabilities."""
        if (context, prefix) not in self.known:
            own = self.estimate(context, prefix)
            longer = sum(self.weighted(c, prefix) for c in self.longer[context, prefix]) if len(context) < self.depth else None
            self.known[context, prefix] = own, longer
        return self.known[context, prefix]

    def weighted(self, context, prefix):
        own, longer = self.parts(context, prefix)
        return own if longer is None else np.logaddexp(own, longer) - math.log(2)

    def one(self, context, prefix, length=0):
        short = context[self.depth - length :]
        zeros, ones = self.counts.get((short, prefix), (0, 0))
        estimate = (ones + 0.5) / (zeros + ones + 1)
        deeper = context[self.depth - length - 1 :]
        if length == self.depth or sum(self.counts.get((deeper, prefix), (0, 0))) == 0:
            return estimate
        own, longer = self.parts(short, prefix)
        share = 1 / (1 + math.exp(min(longer - own, 700)))
        return share * estimate + (1 - share) * self.one(context, prefix, length + 1)

    def score(self, s):
        chances = ((self.one(c, p), bit) for c, p, bit in self.decisions(s))
        return sum(math.log10(one if bit else 1 - one) for one, bit in chances)


def hard_rows(seed):
    rng = random.Random(seed)
    def prose(n):
        return " ".join(rng.choice(["the", "cat", "Dog", "sat", "on", "mat", "été", "日本"]) for _ in range(n))

    rows = [(i, prose(rng.randrange(12)), "en", i % 4 == 0) for i in range(25)]
    rows += [(30, None, None, False), (31, "", "de", True), (32, " \t\n ", None, False), (33, "x" * 200 + " novel!", "en", True), (None, prose(5), "en", True)]
    rows += [(34, prose(300) + "\x0b\x1cq", "en", False), rows[3], rows[4], (35, "\U0001f600" + prose(2), "fr", True)]
    return rows


@pytest.mark.parametrize("seed, depth, block", [(1, 5, 1), (2, 2, 400), (3, 0, 1 << 20), (4, 6, 100)])
def test_scores_against_the_recursion(spark, seed, depth, block):
    rows = hard_rows(seed)
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({n: F.lit("mine") for n in ("score", "block", "train", "rows", "a", "value")})
    got = treeweight.score_documents(df, ~F.col("held"), depth, block)
    assert set(got.columns) == {"doc_id", "lang", "held", "block", "train", "rows", "a", "value", *treeweight.RESULTS}
    trees = Trees([stream(r[1]) for r in rows if not r[3]], depth)
    counts = Counter(t for r in rows if not r[3] for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text, lang, held in rows:
        mine = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in mine)
        want.append((str(i), lang or "", held, "mine", len(mine), sum(counts[t] > 0 for t in mine), n, len(stream(text)), base, trees.score(stream(text))))
    rows = got.select("doc_id", "lang", "held", "block", "n_tokens", "n_known", "train_tokens", "stream_bytes", "base_score", "score").collect()
    found = sorted((str(r[0]), r[1] or "", *r[2:]) for r in rows)
    assert len(found) == len(want)
    for f, w in zip(found, sorted(want)):
        assert f[:8] == w[:8] and f[8:] == pytest.approx(w[8:], rel=1e-9, abs=1e-9)


def test_chances_of_all_bytes_add_up_to_one(spark):
    """After any context, seen or not, the next byte is a byte: every pair is asked for, those not seen with a count of 0."""
    rng = random.Random(9)
    counts = Counter((rng.choice([97, 98]) << 16 | rng.choice([97, 98, 99]) << 8 | rng.choice([97, 98, 255])) for _ in range(40))
    for context in ((97 << 8 | 97), (120 << 8 | 97), (120 << 8 | 121)):
        counts.update({context << 8 | byte: 0 for byte in range(256)})
    pairs = spark.createDataFrame([(k, n) for k, n in counts.items()], "a long, n long")
    sums = treeweight.mixtures(pairs, 2).groupBy(F.shiftright("a", 8).alias("c")).agg(F.sum(F.exp("value")).alias("s"), F.count("*").alias("n"))
    whole = [r.s for r in sums.collect() if r.n == 256]
    assert len(whole) == 3 and whole == pytest.approx([1.0] * 3, abs=1e-12)


def test_no_training_text_and_no_rows(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in treeweight.score_documents(df, F.lit(False)).collect()}
    assert rows[1].score == pytest.approx(-8 * 6 * math.log10(2)) and rows[2].base_score == pytest.approx(0.0)
    assert (rows[1].n_tokens, rows[1].n_known, rows[1].train_tokens) == (3, 0, 0)
    assert treeweight.score_documents(df.where("doc_id > 5"), F.lit(True)).collect() == []
    only = treeweight.score_documents(df.select("text"), F.lit(True))
    assert set(only.columns) == set(treeweight.RESULTS) and only.count() == 2


def test_streams_and_pairs():
    rng = random.Random(4)
    rows = ["".join(rng.choice("aB é\n\t") for _ in range(rng.randrange(20))) for _ in range(100)] + [None, "", " ", "Z"]
    part = next(texts.slices(pa.array(rows)))
    data, bounds = treeweight.stream_of(part)
    assert [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])] == [stream(t) for t in rows]
    pairs = treeweight.pairs_of(data, bounds, 3)
    want = [(END * 3 + stream(t))[at : at + 4] for t in rows for at in range(len(stream(t)))]
    assert [int(p).to_bytes(4, "big") for p in pairs] == want


def test_words_that_share_a_hash_are_told_apart():
    """Entries are looked up by both hashes; here the first is the same for all."""
    schema = pa.schema([("_row", pa.struct([("i", pa.int64())])), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("stream_bytes", pa.int64())])
    part = next(texts.slices(pa.array(["a b a"])))
    data, bounds = treeweight.stream_of(part)
    real = treeweight.words_of

    def colliding(s, b):
        _, second, first = real(s, b)
        return np.zeros_like(second), second, first

    treeweight.words_of = colliding
    try:
        pairs, (a, b, _) = treeweight.pairs_of(data, bounds, 1), colliding(data, bounds)
        entries = pa.table({"a": [*pairs, *a], "b": pa.array([None] * len(pairs) + b.tolist(), pa.int32()), "value": [-1.0] * len(pairs) + [5.0, 7.0, 5.0, 1.0]})
        chunk = pa.table({"rows": pa.array([[{"i": 1}]], pa.list_(schema.field("_row").type)), "sizes": [[len(data)]], "data": [pa.Codec("zstd").compress(data.tobytes(), asbytes=True)]})
        got = treeweight._scored(1, 18, 3, schema)(chunk, entries).to_pylist()[0]
    finally:
        treeweight.words_of = real
    want = sum(math.log10((c + 0.1) / (18 + 0.1 * 4)) for c in (5, 7, 5, 1))
    assert (got["n_tokens"], got["n_known"]) == (4, 4) and got["base_score"] == pytest.approx(want)
