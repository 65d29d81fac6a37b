"""The interaction audit, its byte transducer and its hash table against plain loops."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stalemark.llm import audit, spans, texts
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def hard_rows(seed=5):
    rng = random.Random(seed)
    many = " ".join(f"w{i}" for i in range(150))
    dull = " ".join(rng.choice(["a", "b", "c"]) for _ in range(150))
    shapes = [many, dull, many.upper(), dull + " #", "Été ÖFFNET 日本語 \U0001f600", "", None, " \t\n\x0b", "x" * 5000, "$", many]
    rows = [(i, rng.choice(shapes), rng.choice(["en", "de", None, ""])) for i in range(200)]
    rows += [(7, many, "en"), (7, many, "en"), (None, many, "en"), (None, dull, None), (900, " ".join(f"v{i % 9000}" for i in range(20000)), "en")]
    return [(i, t, lang, "s", 0) for i, t, lang in rows]


def failing(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = brute.words(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > least[t],
        }
        out.append((i, lang or "", {k for k, v in fails.items() if v}))
    return out


def expected(rows, labels):
    good, toxic = ({i for i, *flags in labels if i is not None and flags[at] == 1} for at in (0, 1))
    docs, out = failing(rows), {}
    for part in {p for _, p, _ in docs}:
        over_all = Counter()
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit, keep = [d for d in left if f in d[2]], [d for d in left if f not in d[2]]
                over_all[f] += len(hit)
                out[part, "".join(order), step] = [
                    len(keep), len(hit), sum(f in d[2] for d in gone), sum(d[2] == {f} for d in docs if d[1] == part),
                    sum(d[0] in good for d in hit), sum(d[0] in toxic for d in hit),
                ]
                left, gone = keep, gone + hit
        for (p, order, step), row in out.items():
            if p == part:
                row.append(over_all[order[step - 1]])
    return out


def found(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in frame.collect()}


@pytest.mark.parametrize("seed", [5, 6])
def test_audit_against_loops(spark, seed):
    rows = hard_rows(seed)
    labels = [(i, i % 3 % 2, None if i % 5 else 1) for i in range(0, 150)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs = docs.withColumns({n: F.lit("mine") for n in ("mask", "part", "digest", "n_words", "good", "copy", "_row")})
    marks = spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("x"))
    assert found(audit.audit_filters(docs, marks)) == expected(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit.audit_filters(none, spark.createDataFrame([], LABELS)).collect() == []
    rows = hard_rows()
    assert found(audit.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS))) == expected(rows, [])


def test_transducer_against_a_loop_over_bytes():
    rng = random.Random(1)
    rows = ["".join(rng.choice("aB #é日\n\t\x0c$") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "a", " "]
    part = next(texts.slices(pa.array(rows)))
    acts, begins, ends = audit.transduce(part)
    want_begins, want_ends, want_acts = [], [], []
    for first, last in zip(part.bounds[:-1], part.bounds[1:]):
        state = audit.OUTSIDE
        for at in range(first, last):
            byte = part.data[at]
            want_acts.append(audit.ACT[state, byte])
            if audit.ACT[state, byte] & audit.BEGIN:
                want_begins.append(at)
            if audit.ACT[state, byte] & audit.END:
                want_ends.append(at)
            state = audit.STEP[state, byte]
        if state == audit.INSIDE:
            want_ends.append(last)
    assert (begins.tolist(), ends.tolist(), acts.tolist()) == (want_begins, want_ends, want_acts)


@pytest.mark.parametrize("bits", [0, 2, 64])
def test_hash_table_never_trusts_a_hash(bits):
    """Equal spans are found, and only those, even if all hashes or most of them collide."""
    rng = random.Random(bits)
    words = [rng.choice(["a", "b", "ab", "", "longer than eight", "longer than eighT", "z" * 70, "z" * 69 + "y"]).encode() for _ in range(300)]
    data = np.frombuffer(b"".join(words) + b".", np.uint8)
    ends = np.cumsum([len(w) for w in words])
    found = spans.Spans(data, ends - [len(w) for w in words], ends)
    owners = np.array([rng.randrange(4) for _ in words])
    hashes = found.hashes(1) & np.uint64((1 << bits) - 1)
    first = spans.first_equal(found, owners, hashes)
    for i, f in enumerate(first):
        assert (words[f], owners[f]) == (words[i], owners[i]) and first[f] == f
    assert len(set(first.tolist())) == len({(w, o) for w, o in zip(words, owners)})


def test_span_hashes_do_not_depend_on_place():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 90))).encode() for _ in range(200)]
    one = b" ".join(words)
    for text in (one, b"shift " + one):
        part = next(texts.slices(pa.array([text.decode()])))
        starts, ends, _ = part.words()
        got = spans.Spans(part.data, starts, ends).hashes(3)[-len(words) :]
        known = dict(zip(words, got.tolist())) if text is one else known
        assert got.tolist() == [known[w] for w in words]
    assert len(set(known.values())) == len(set(words))
