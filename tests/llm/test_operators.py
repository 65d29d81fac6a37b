"""Each operator against brute force or its invariants, on hard small tables: nulls, empty and long texts, ties, repeats,
empty tables, and extra columns called as the operator's own.
"""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stalemark.llm import balltree, bytelang, chat, frames, graph, mixing, nearness, packing, phrases, quality, ranks, repeats, sharding, texts
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rng_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, blanks, one long text."""
    rng = random.Random(3)
    base = [rng_text(rng, rng.randrange(1, 200)) for _ in range(30)]
    passage = rng_text(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:6])]
    for i, t in enumerate(base[6:18]):
        words = t.split()
        words[rng.randrange(len(words))] = "edited"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{rng_text(rng, 20)} {passage}\n{rng_text(rng, 9)}") for i in range(5)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "Été öffnet 　 日本語 \U0001f600 !!"), (404, rng_text(rng, 9000)), (405, "x" * 3000), (406, "$$$ 123")]
    sources = ["b", "a", None, "ä", "a"]
    return [(i, t, "en" if i % 2 else "de", sources[i % 5], None if t is None else len(t)) for i, t in rows]


def frame(spark, rows, clash=()):
    """The rows as a table with extra columns of the given names."""
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({name: F.lit("mine") for name in clash})


# ---------------------------------------------------------------------- helpers


def test_words_and_hashes():
    rows = ["a b", None, "", " x\x1c y z\n", "a b"]
    part = next(texts.slices(pa.array(rows)))
    starts, ends, bounds = part.words()
    found = [[part.data[a:b].tobytes() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(bounds[:-1], bounds[1:])]
    assert found == [brute.words(t) for t in rows]
    hashes = texts.word_hashes(part.data, starts, ends)
    assert len(set(hashes.tolist())) == len({w for ws in found for w in ws})
    assert sum(p.n for p in texts.slices(pa.array(rows), 1)) == 5 and not list(texts.slices(pa.array([], pa.string())))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: least[x] for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", None]), rng.randrange(-(2**63), 2**63), rng.randrange(9)) for _ in range(500)]
    df = ranks.add_running(spark.createDataFrame(rows, "g string, key long, v long"), ["g"], ["key"], 3, {"before": F.col("v")})
    want = {r: sum(o[2] for o in rows if o[0] == r[0] and o[1] < r[1]) for r in rows}
    assert {(r.g, r.key, r.v): r.before for r in df.collect()} == want


# ------------------------------------------------------------------------- top k


@pytest.mark.parametrize("n", [0, 3, 700])
def test_top_k(spark, monkeypatch, n):
    monkeypatch.setattr(balltree, "LEAST_ROWS", 100)
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200 if n > 3 else 0)]  # equal vectors
    rows += [(2000, None), (2001, [0.1, None]), (2050, [float("nan")] * 6), (2051, [float("inf")]), (None, [0.5] * 6)]
    rows += [(50 * i + 5000, v) for i, v in enumerate([[], [], [2.0], [-3.0], [1e30, 1e30], [-1e30, 2e9]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("mine"))
    vectors = balltree.whole_vectors(df)
    got = {tuple(r) for r in balltree.top_inner_products(vectors, vectors.where("id % 50 = 0")).collect()}
    clamped = {(q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in brute.top_k(rows)}
    assert got == clamped


def test_equal_vectors_with_repeated_ids():
    """Rows of the query's own id, however many, hide no other id with the same vector."""
    ids = np.array([50] * 9 + [60, 60, 70])
    tree = balltree.BallTree(np.ones((12, 3)))
    for exact in (True, False):
        assert sorted(tree.search(np.ones(3), ids, 50, 5, float("-inf"), exact)) == [(3, 60), (3, 60), (3, 70)]
        assert sorted(tree.search(np.ones(3), ids, 60, 2, float("-inf"), exact)) == [(3, 50), (3, 50)]


# ------------------------------------------------------------------------ packing


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = docs + docs[:2] + [(500, "a <|endoftext|> b <|ENDOFTEXT|>", None, None, 0)]
    got = packing.pack_documents(frame(spark, rows, ["piece", "offset", "_key"]), 256).collect()
    pieces = Counter()
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            pieces[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.01 * sum(r.length for r in got) / 256 + 2
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_sum_of_squares_is_the_rule():
    rng = np.random.default_rng(1)
    lengths, capacity = rng.integers(1, 12, 60), 12
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    gaps = []  # of the sequences opened so far
    for item in np.argsort(-lengths, kind="stable"):
        size, choices = int(lengths[item]), []
        for gap in {g for g in gaps if g >= size} | {capacity}:
            after = Counter(gaps) if gap == capacity else Counter(gaps) - Counter([gap])
            after = after + Counter([gap - size])
            choices.append((sum(n * n for g, n in after.items() if g), gap))
        own = sequence[item]
        gap = capacity - offset[item]
        assert (min(choices)[0], gap) in choices and gap == min(choices)[1]
        gaps = gaps + [capacity - size] if own == len(gaps) else [*gaps[:own], gaps[own] - size, *gaps[own + 1 :]]


def test_other_tokenizers_encode_whole_texts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.reads_words_alone(packing.default_tokenizer()) and not packing.reads_words_alone(path)
    got = packing.token_pieces(frame(spark, docs), 64, 1, path).collect()
    tokenizer, want = Tokenizer.from_file(path), Counter()
    for doc_id, text, *_ in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(map(tuple, got)) == want


def test_marks_hold_every_partner(spark, monkeypatch):
    keys, rows = spark.range(0, 900, 3).toDF("k"), spark.range(3000).selectExpr("id AS k", "id AS `a.b`")
    for most in (26, 4):  # a bitmap, and more keys than it has room for
        monkeypatch.setattr(frames, "MOST_BITS", most)
        got = frames.marked_by(rows, keys, ["k"], "maybe")
        assert got.columns == ["k", "a.b", "maybe"] and got.count() == 3000
        marked = {r.k for r in got.where("maybe").collect()}
        assert marked >= set(range(0, 900, 3)) and (len(marked) < 1000 if most == 26 else len(marked) == 3000)
    assert frames.marked_by(rows, keys.limit(0), ["k"], "maybe").where("maybe").count() == 0


def test_full_chunks_are_packed_on(spark):
    pieces = spark.range(300).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + id % 7 as length", "id as ids_crc32")
    got = packing.pack(pieces, 1, 10, chunk=20).collect()
    assert len(got) == 300 and max(Counter({r.sequence_id: 0 for r in got}).values()) == 0
    total = Counter()
    for r in got:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 10


# --------------------------------------------------------------- near duplicates


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, percent):
    rng = random.Random(8)
    words = rng_text(rng, 120).split()
    hot = []  # one text with ever more edits, on both sides of the threshold
    for i in range(300):
        mine = list(words)
        for _ in range(rng.randrange(0, 5)):
            mine[rng.randrange(120)] = f"e{rng.randrange(40)}"
        hot.append((1000 + i, " ".join(mine), None, None, 0))
    rows = docs + hot + [(900, "A B c", None, None, 0), (901, "a b C", None, None, 0), (902, "a b", None, None, 0)]
    got = nearness.near_duplicates(frame(spark, rows, ["kept", "cluster", "high"]), percent=percent).collect()
    want = brute.near_groups([r[:2] for r in rows], percent)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark, docs):
    assert nearness.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (None, "a b c d e f", "", "", 0), (2, "a b c d e f", "", "", 0)]
    got = nearness.near_duplicates(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter({(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 2, None, True): 1})


def test_documents_of_one_template_send_no_sets(spark):
    rng = random.Random(21)
    header = rng_text(rng, 60)
    rows = [(i, f"{header} " + " ".join(f"x{i}y{j}" for j in range(42))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 600, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = nearness.signatures(docs)
    candidates = signed.join(nearness.candidate_clusters(signed), "doc_id")
    assert max(r["count"] for r in candidates.groupBy("cluster").count().collect()) > 300
    left = nearness.narrowed_clusters(candidates).collect()
    assert {r.doc_id for r in left} == {i for n in range(0, 600, 60) for i in (n, 1000 + n)}
    got = {r.doc_id: r.component_id for r in nearness.near_duplicates(docs).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}


@pytest.mark.parametrize("percent", [80, 85])
def test_open_pairs_leave_no_link_out(percent):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - k], rng.integers(0, 1 << 63, k % 40, dtype=np.uint64)])) for k in range(0, 200, 2)]
    sides = [k % 2 for k in range(len(sets))]
    marks = nearness.packed(nearness.minima(sets, 190))
    ids = list(range(len(sets)))
    label = {i: i for i in ids}
    for a, b in nearness.open_pairs(marks, np.array([len(s) for s in sets]), sides, ids, percent):
        label = {i: label[a] if at == label[b] else at for i, at in label.items()}
    for a, b in nearness.linked(sets, marks, sides, ids, percent):
        assert label[a] == label[b]


def test_estimates():
    sets = [np.unique(texts.mix(np.arange(a, a + 1000, dtype=np.uint64))) for a in (0, 0, 100, 5000)]
    marks = nearness.packed(nearness.minima(sets, 190))
    near = nearness.estimate(marks[0], marks, 190)
    assert near[0] == near[1] == 1 and abs(near[2] - 900 / 1100) < 0.15 and abs(near[3]) < 0.2


# ------------------------------------------------------------------ fingerprints


def lz(data):
    known, at = set(), 0
    while at < len(data):
        end = at + 1
        while end <= len(data) and data[at:end] in known:
            end += 1
        if end > len(data):
            break
        known.add(data[at:end])
        at = end
    return known


def test_parse(docs):
    for text in [r[1] or "" for r in docs] + ["a" * 50, "ab" * 40]:
        known = set()
        new, _ = phrases.parse(text.encode(), 0, known)
        assert known == lz(text.encode()) and len(new) == len(known)


def test_phrases_of_many_texts(docs):
    """Trees grown side by side hold the phrases of a plain parse, also where a second text goes on from the first's head."""
    texts_ = [r[1] or "" for r in docs] + ["a" * 5000, "ab" * 400, "\U0001f600é" * 90, "", "a"]
    found, pairs = phrases.Phrases(), []
    for text, following in zip(texts_, texts_[1:] + texts_[:1]):
        other, common = phrases.edited(text, following)
        pairs.append((text, other, phrases.add_both(found, text, other, common)))
    codes = found.codes()
    assert len(codes) == found.count
    for text, other, (head, one, two) in pairs:
        for whole, rest in ((text, one), (other, two)):
            assert Counter([*codes[head].tolist(), *codes[rest].tolist()]) == Counter(zlib.crc32(p) for p in lz(whole.encode()))
        assert phrases.fingerprint(text).tobytes() == phrases.low_bytes(phrases.minima(sorted(lz(text.encode())))).tobytes()
    assert len(phrases.Phrases().codes()) == 0


def test_fingerprints_take_less_than_plain_parses():
    """Texts and their edited ones, from parse to fingerprints: trees against a parse that cuts every phrase out of the text."""
    rng = random.Random(4)
    rows = [rng_text(rng, rng.randrange(300, 600)) for _ in range(150)]

    def timed(work):
        spent = []
        for _ in range(5):
            began = time.process_time()
            work()
            spent.append(time.process_time() - began)
        return min(spent)

    def plain():
        for text, following in zip(rows, rows[1:] + rows[:1]):
            other, common = phrases.edited(text, following)
            known = set()
            head, at = phrases.parse(text[:common].encode(), 0, known)
            shared = phrases.minima(head)
            for whole, dictionary in ((text, known.copy()), (other, known)):
                phrases.low_bytes(phrases.minima(phrases.parse(whole.encode(), at, dictionary)[0], shared))

    def together():
        found, pairs = phrases.Phrases(), []
        for text, following in zip(rows, rows[1:] + rows[:1]):
            pairs.append(phrases.add_both(found, text, *phrases.edited(text, following)))
        values = phrases.hashed(found.codes())
        for head, one, two in pairs:
            shared = phrases.least(values[head])
            phrases.low_bytes(phrases.least(values[one], shared)), phrases.low_bytes(phrases.least(values[two], shared))

    assert timed(together) < 0.8 * timed(plain)


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_fingerprints(spark, monkeypatch, docs, n):
    monkeypatch.setattr(phrases, "ROWS_PER_BUCKET", 5)
    rows = docs[:n] + [(None, "no id", None, None, 0), (7, "again", None, None, 0)] * (n > 2)
    got = phrases.fingerprint_documents(frame(spark, rows, ["bucket", "guest", "fingerprint"])).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = []
    for k, (i, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        one, two, three = (phrases.low_bytes(phrases.minima(sorted(lz(t.encode())))) for t in (text, other, following))
        want.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), one.tobytes().hex(), two.tobytes().hex(), phrases.likeness(one, two), phrases.likeness(one, three)))
    assert Counter(map(tuple, got)) == Counter(want)


# ----------------------------------------------------------------------- repeats


@pytest.mark.parametrize("passage,gram,vocabulary", [(35, 12, 400), (6, 3, 4), (5, 2, 30)])
def test_repeats(spark, docs, passage, gram, vocabulary):
    rng = random.Random(passage)
    rows = docs + docs[2:4] + [(600, "q " * 90, None, None, 0), (None, docs[3][1], None, None, 0), (1, "other text of a known id", None, None, 0)]
    rows += [(700 + i, rng_text(rng, rng.randrange(120), vocabulary), None, None, 0) for i in range(20)]
    got = repeats.remove_repeats(frame(spark, rows, ["places", "kept_text", "anchor", "id"]), passage, gram)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "places", "anchor", "id", "text", "n_words", "n_removed", "kept_text"]
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    assert found == Counter(brute.without_repeats([r[:2] for r in rows], passage))
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_short_periods(spark):
    """Stretches that repeat themselves every few words, each in one document alone."""
    rng = random.Random(24)
    rows = []
    for i in range(3000):
        period = rng.randrange(1, 24)
        cycle = [f"p{i}x{k}" for k in range(period)]
        stretch = [cycle[k % period] for k in range(35 + period + rng.randrange(5))]
        around = [[f"a{i}x{side}x{k}" for k in range(rng.randrange(60))] for side in range(2)]
        rows.append((i, " ".join([*around[0], *stretch, *around[1]]), None, None, 0))
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    assert found == Counter(brute.without_repeats([r[:2] for r in rows]))


def test_texts_of_one_id_and_one_checksum_are_told_apart(spark):
    """Rows with null or equal ids whose texts share a CRC-32, one of them with a passage that stands elsewhere."""
    rng, seen, found = random.Random(8), {}, None
    passage = " ".join(f"p{i}" for i in range(40))
    while found is None:
        tail = str(rng.randrange(10**12))
        for kind, text in (("shared", f"{passage} {tail}"), ("own", " ".join(f"q{i}" for i in range(45)) + f" {tail}")):
            other = seen.setdefault(zlib.crc32(text.encode()), (kind, text))
            if other[0] != kind:
                found = {kind: text, other[0]: other[1]}
    for same in (None, 7):
        rows = [(same, found["shared"], "en", "a", 0), (same, found["own"], "en", "a", 0), (1, f"x {passage} y", "en", "a", 0)]
        got = {r.text: r.n_removed for r in repeats.remove_repeats(frame(spark, rows)).collect()}
        assert got == {found["shared"]: 40, found["own"]: 0, f"x {passage} y": 40}


def test_long_passages_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "PART_WORDS", 7)
    words = [b"w%d" % k for k in range(40)]
    line = repeats.Line(words)
    rows = list(repeats.dealt((5, 1, 2, 3, 23, None, True), (1, 2, 3), line, 5))
    passages = sorted({r[-1].decode() for r in rows if not r[4]})
    assert len(passages) == 4 and sum(not r[4] for r in rows) == 8  # every salt has all of them
    docs = [words, words[5:30], [b"x", *words[:9]], [b"y"] * 3]
    of, _, begin, end, _ = next(repeats.occurrences(passages, [repeats.Line(d).text.decode() for d in docs]))
    gone = [np.flatnonzero(g).tolist() for g in repeats.covered([len(d) for d in docs], of, begin, end)]
    assert gone == [list(range(3, 30)), list(range(5, 25)), [], []]
    assert repeats.passages_of(line, 3, 23, [0, 4], 5) == {b" w3 w4 w5 w6 w7 ", b" w7 w8 w9 w10 w11 "}


def test_places_that_touch_are_one():
    found = next(repeats.occurrences([" a a "], [" a a a b a a ", " b ", " \u00e9 a a "]))
    assert [x.tolist() for x in found] == [[0, 0, 2], [0, 0, 0], [0, 4, 1], [3, 6, 3], [2, 1, 1]]


def test_divided_and_salted_decks(spark, monkeypatch):
    """Automata of a few words and salts of a few stretches: anchors with many passages, and one passage in most rows."""
    monkeypatch.setattr(repeats, "AUTOMATON_WORDS", 60)
    monkeypatch.setattr(repeats, "STREAM_RUNS", 3)
    monkeypatch.setattr(repeats, "FLUSH_BYTES", 500)
    rng = random.Random(3)
    core = [f"c{k}" for k in range(6)]
    rows = []
    for i in range(120):  # one gram of every row, in contexts that few or many share
        near = [f"n{rng.randrange(3)}" for _ in range(4)]
        rows.append((i, " ".join([rng_text(rng, 9, 300), *near[:2], *core, *near[2:], rng_text(rng, 9, 300)]), None, None, 0))
    rows += [(200 + i, " ".join(core * 3), None, None, 0) for i in range(10)] + [(None, rows[5][1], None, None, 0), rows[7], rows[7]]
    rows.append((300, "z " * 70, None, None, 0))
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(frame(spark, rows), 8, 5).collect())
    assert found == Counter(brute.without_repeats([r[:2] for r in rows], 8))


def test_hashes_that_lie_remove_nothing(spark, monkeypatch):
    """All words have one hash: every window is a candidate everywhere, and only the automata know better."""
    monkeypatch.setattr(repeats, "word_hashes", lambda data, starts, ends, seed=1: np.full(len(starts), seed, np.uint64))
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(40 + i)), None, None, 0) for i in range(12)]
    assert repeats.find_runs(frame(spark, rows).selectExpr("doc_id AS id", "doc_id AS h1", "doc_id AS h2", "text")).select("anchor").distinct().count() == 1
    assert {r.n_removed for r in repeats.remove_repeats(frame(spark, rows)).collect()} == {0}


# ------------------------------------------------------------- quality, language


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["fine", "good", "plain", "text"] if good else ["bad!!", "$$$", "SPAM", "now"]) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words), None, None, 5))
        labels.append((i, int(good)))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled(random.Random(1), 400)
    odd = [(900, None, None, None, None), (901, "", None, None, -1), (902, "fine " * 5000, None, None, 2**62)]
    df = frame(spark, rows + odd, ["score", "predicted"])
    train = spark.createDataFrame(labels + [(900, None), (None, 1), (1, 7)], "doc_id long, label int")
    model = quality.learn_quality(df.where("NOT (doc_id % 4 <=> 2)"), train, ["n_chars"])
    got = {r.doc_id: r for r in quality.score_documents(df, model, ["n_chars"]).collect()}
    held = [(i, y) for i, y in labels if i % 4 == 2]
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values()) and len(got) == 403
    assert abs(got[900].score - got[900].score) == 0 and quality.learn_quality(df, train.limit(0)) == 0.5
    assert {r.score for r in quality.score_documents(df, 0.5).collect()} == {0.5}
    assert quality.score_documents(frame(spark, []), model, ["n_chars"]).count() == 0


def test_samples_are_bounded_by_rows(spark):
    """Rows that share a drawn doc_id don't add to the sample of either model."""
    rows = [(1, f"word{i} again", "en", None, 0) for i in range(1000)] + [(2, "copy of a row", "en", None, 0)] * 1000 + [(3, "other", "en", None, 0)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, label int")
    df = frame(spark, rows)
    assert len(quality.training_rows(df, labels, ["n_chars"], most=40)) == 40
    assert sorted(r[0] for r in quality.training_rows(df.where("doc_id > 1"), labels, ["n_chars"])) == [0, 0, 1]
    words, _, _ = bytelang.training_words(df, per_language=100)
    assert 100 < len(words) < 400
    words, _, _ = bytelang.training_words(df.where("doc_id > 1"))
    assert Counter(words) == Counter([b"copy", b"of", b"a", b"row", b"other"])


def test_machine_counts_pairs():
    """The sum-of-squares identity against the sum over all pairs."""
    rng = np.random.default_rng(2)
    part = next(texts.slices(pa.array(["a b c a", "d"])))
    f = quality.features(part, np.zeros((2, 0)))
    n = quality.BUCKETS + f.dense.shape[1]
    model = quality.Machine(0.3, rng.normal(size=n).astype(np.float32), rng.normal(size=(n, 3)).astype(np.float32), f.dense.mean(axis=0), f.dense.std(axis=0) + 1)
    raw, _, dense = model.parts(f)
    for k in range(2):
        own = f.row == k
        x = [*zip(f.bucket[own], f.value[own]), *((quality.BUCKETS + j, v) for j, v in enumerate(dense[k]))]
        pairs = sum(model.vectors[i] @ model.vectors[j] * a * b for p, (i, a) in enumerate(x) for j, b in x[p + 1 :])
        assert abs(raw[k] - (0.3 + sum(model.weights[i] * a for i, a in x) + pairs)) < 1e-3


def test_language(spark):
    rng = random.Random(4)
    parts = {"de": ["schön", "keit", "ung", "der"], "en": ["the", "ing", "and", "ly"], "fr": ["eaux", "é", "que", "la"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text, lang if i % 10 else None, None, 0))
    odd = [(900, None, "en", None, 0), (901, "12 $ !", "de", None, 0), (902, "", None, None, 0), (903, "日本", "en", None, 0), (904, "der" * 4000, None, None, 0), (None, "la eaux", "zz", None, 0)]
    df = frame(spark, rows + odd, ["lang_pred", "score"])
    net = bytelang.learn_languages(df)
    got = {r.doc_id: r for r in bytelang.label_documents(df, net).collect()}
    assert net.languages == ["de", "en", "fr"]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[2]]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.9 * len(held)
    assert [got[i].lang_pred == "und" for i in (900, 901, 902, 903, 904)] == [True, True, True, False, False]
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 246
    assert bytelang.learn_languages(frame(spark, [])) is None
    assert {(r.lang_pred, r.score) for r in bytelang.label_documents(df, None).collect()} == {("und", 0.0)}


def test_least_score():
    scores = [bytelang.least_score(bytelang.Network.fresh([str(i) for i in range(n)], seed=1)) for n in (1, 2, 4, 200)]
    assert scores[0] == 0 and scores[1] == 0.5625 and scores[2] == 0.34375 and abs(scores[3] - 1.375 / 200) < 1e-12


def test_many_languages(spark):
    """Every language is learned, the rarest too, and the words of each are bounded."""
    rows = [(i, f"a{i % 301} b{i % 301} {'c' * (i % 5)}", f"l{i % 301:03}", None, 0) for i in range(1806)] + [(5000, "only one", "rare", None, 0), (5001, " ", "blank", None, 0)]
    words, labels, languages = bytelang.training_words(frame(spark, rows), per_language=2)
    assert "rare" in languages and "blank" not in languages and len(languages) > 250
    assert Counter(labels.tolist())[languages.index("rare")] == 2 and len(words) < 4 * 302 * 3
    words, labels, languages = bytelang.training_words(frame(spark, rows))
    assert len(languages) == 302 and max(Counter(labels.tolist()).values()) <= 18
    net = bytelang.train(words, labels, languages, steps=2, batch=100)
    assert net.languages == languages and all(np.isfinite(p).all() for p in net.parameters())
    got = bytelang.label_documents(frame(spark, rows[:50]), net).collect()
    assert len(got) == 50 and all(r.lang_pred in languages for r in got)


def test_pieces_of_long_words(spark):
    """Training draws from all pieces of a text without spaces; no cut goes through a character."""
    text = "".join(chr(0x4E00 + k) for k in range(400)) + "a\U0001f600" * 50
    part = next(texts.slices(pa.array([f"x {text} y", None, text])))
    starts, ends, bounds = bytelang.pieces_of(part)
    cut = [[part.data[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(bounds[:-1], bounds[1:])]
    assert cut[0] == ["x", *cut[2], "y"] and "".join(cut[2]) == text and not cut[1]
    assert all(len(p.encode()) <= bytelang.PIECE + 3 for p in cut[2])
    words, _, _ = bytelang.training_words(frame(spark, [(1, text, "zh", None, 0)]))
    assert {w.decode() for w in words} <= set(cut[2])
    assert len(words) == min(bytelang.WORDS_PER_DOC, len(cut[2])) > 50


def test_languages_take_turns():
    words = [bytes([97 + k // 4, 97 + k % 4]) for k in range(12)]
    net = bytelang.train(words, np.arange(12), [f"l{k:02}" for k in range(12)], steps=200, batch=5)
    p = net.labels(*bytelang.as_codes(words))
    assert (p.mean(axis=0).argmax(axis=1) == np.arange(12)).all()


def test_gradients():
    """Backpropagation through time against differences."""
    net = bytelang.Network.fresh(["a", "b"], hidden=3)
    for name in ("inputs", "recur", "out"):
        setattr(net, name, [p.astype(np.float64) for p in getattr(net, name)])
    net.bias = net.bias.astype(np.float64)
    codes, lengths = bytelang.as_codes([b"abc", b"d", b"ca"])
    labels = np.array([0, 1, 1])
    _, grads = net.gradients(codes, lengths, labels)
    rng = np.random.default_rng(1)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(3)] + ([(97, 1)] if p.shape[0] == 256 else []):
            kept = p[at]
            p[at] = kept + 1e-3
            high = net.gradients(codes, lengths, labels)[0]
            p[at] = kept - 1e-3
            low = net.gradients(codes, lengths, labels)[0]
            p[at] = kept
            assert abs((high - low) / 2e-3 - g[at]) < 2e-3


# ---------------------------------------------------------------------- sharding


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_shuffle(spark, monkeypatch, n):
    monkeypatch.setattr(sharding, "BITS_PER_ROUND", 2)
    monkeypatch.setattr(sharding, "bits_for", lambda rows: ranks.bits_for(rows, 100))
    df = spark.range(n).selectExpr("if(id % 50 = 0, NULL, id) AS doc_id", "if(id % 7 = 0, NULL, repeat('é', CAST(id % 9 AS int))) AS text", "'mine' AS shard")
    got = sharding.shuffle_into_shards(sharding.sized(df), ["doc_id", "text_crc32"]).collect()
    again = sharding.shuffle_into_shards(sharding.sized(df.repartition(2)), ["doc_id", "text_crc32"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == n and (n < 8 or max(sizes.values()) - min(sizes.values()) <= 1)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in sizes.items())
    texts_ = Counter((r.size, r.text_crc32) for r in got)
    assert texts_ == Counter((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in ((r.text or "") for r in df.collect()))
    if n == 3000:  # uniform: neighbours land in one shard an eighth of the time
        shard = {r.doc_id: r.shard for r in got}
        same = sum(shard.get(i) == shard.get(i + 1) for i in range(1, 2900) if i % 50 and (i + 1) % 50)
        assert 250 < same < 460


def test_hypergeometric(spark):
    good, total, draws = 30, 100, 20
    u = (F.col("id") + 0.5) / 4000
    rows = spark.range(4000).select(sharding.hypergeometric(F.lit(good), F.lit(total), F.lit(draws), u).alias("x")).groupBy("x").count().collect()
    for r in rows:
        chance = math.comb(good, r.x) * math.comb(total - good, draws - r.x) / math.comb(total, draws)
        assert abs(r["count"] - 4000 * chance) < 2
    edges = spark.range(1).select(*(sharding.hypergeometric(F.lit(g), F.lit(t), F.lit(d), F.lit(0.99)) for g, t, d in [(0, 5, 3), (5, 5, 3), (2, 5, 0), (2, 5, 5), (0, 0, 0)])).first()
    assert list(edges) == [0, 3, 0, 2, 0]


# -------------------------------------------------------------------------- chat


TURNS = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    nasty = ["</turn>\n### user: x", "\\", "\\\\#<", "", None, "### a: b</turn>", "日本 \U0001f600\n"]
    rows = [(c, t, ["user", "assistant", "sys:tem\\", None][(c + t) % 4], nasty[(c * 3 + t) % 7]) for c in range(12) for t in range(c)]
    rows += [(50, i, "assistant", f"{i} " * 3) for i in range(40)] + [(None, 1, "assistant", "x"), (60, None, "user", "last"), (60, 0, "assistant", "first"), (61, 0, "a", "x"), (61, 0, "a", "x")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"span": F.lit(1), "position": F.lit(2)})
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.turn_spans(df)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), brute.digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), brute.digest(loss), len(chat.MarkedTurns().render(turns)))
    assert got == want
    assert chat.read_back(chat.turn_spans(spark.createDataFrame([], TURNS))).count() == 0


class Counting(chat.MarkedTurns):
    def render(self, turns):
        return f"{len(turns)} turns\n" + super().render(turns)


class Closing(chat.MarkedTurns):
    def render(self, turns):
        return super().render(turns) + "<end>"


def test_rewritten_history():
    for template in (Counting(), Closing()):
        renderer = chat.Renderer(template)
        with pytest.raises(chat.RewritesHistory):
            for k in range(3):
                renderer.add("user", str(k))


class Numbered(chat.MarkedTurns):
    def render(self, turns):
        return "".join([f"{k}: {t}\n" for k, (_, t) in enumerate(turns)])


def test_windows_of_turns():
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(50)]
    renderer = chat.Renderer(chat.MarkedTurns(), window=7, context=2)
    spans = [renderer.add(*t) for t in turns]
    assert "".join(s for s, *_ in spans) == chat.MarkedTurns().render(turns)
    assert [s[a:b] for s, _, a, b in spans] == [t for _, t in turns]
    assert all(sum(len(s) for s, *_ in spans[:k]) == begin for k, (_, begin, _, _) in enumerate(spans))
    with pytest.raises(ValueError, match="looks back"):
        renderer = chat.Renderer(Numbered(), window=7, context=2)
        for t in turns:
            renderer.add(*t)


class Forgetting(chat.MarkedTurns):
    """Drops early turns of a conversation of more than ``most``."""

    def __init__(self, most):
        self.most = most

    def render(self, turns):
        return super().render(turns[1:] if len(turns) > self.most else turns)


def test_late_rewriting(spark):
    for most, n in ((5, 6), (10, 11), (20, 21), (20, 28)):
        renderer = chat.Renderer(Forgetting(most), window=7, context=2)
        with pytest.raises(chat.RewritesHistory):
            for k in range(n):
                renderer.add("user", str(k))
            renderer.finish()
    rows = [(c, k, "user", str(k)) for c in (1, 2) for k in range(620 if c == 1 else 3)]
    df = spark.createDataFrame(rows, TURNS)
    assert chat.turn_spans(df, Forgetting(620)).count() == 623
    with pytest.raises(Exception, match="RewritesHistory"):
        chat.turn_spans(df, Forgetting(600)).collect()


# ------------------------------------------------------------------------ mixing


def brute_targets(sizes, weights):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        rest = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / rest for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark, docs):
    rows = docs + [(800, "tiny", "en", "z", 4), (801, "of two", "en", "y", 6), (801, "of two", "en", "y", 6)]
    df = frame(spark, rows, ["size", "target", "spans", "rank"])
    mixed = mixing.mix_sources(df, block_words=4).collect()
    again = mixing.mix_sources(df.repartition(5), block_words=4).collect()
    assert Counter((r.doc_id, r.text, r.taken) for r in mixed) == Counter((r.doc_id, r.text, r.taken) for r in again)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    want = brute_targets(sizes, mixing.WEIGHTS)
    taken = Counter()
    for r in mixed:
        assert r.size == len(brute.words(r.text)) and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 12 for s in want), (taken, want)
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    blank = [(1, None, None, None, 0), (2, "", None, "a", 0)]
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix_sources(frame(spark, blank)).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_mixed_documents(spark, docs):
    df = frame(spark, docs, ["size", "spans"])
    out = mixing.mixed_documents(df, block_words=4)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(brute.words(r.text))
        assert " ".join(w.decode() for w in brute.words(r.text)) in " ".join(w.decode() for w in brute.words(next(d[1] for d in docs if d[0] == r.doc_id)))
    assert words == Counter({r.doc_id: r.taken for r in mixing.mix_sources(df, block_words=4).collect() if r.taken})


def sainte_lague(targets, seats):
    won = Counter()
    for _ in range(seats):
        won[max((t / (2 * won[s] + 1), -s) for s, t in targets.items())[1] * -1] += 1
    return won


def test_block_quotas(spark):
    rng = random.Random(6)
    targets = {k: rng.choice([0.0, 5.0, 40.0, 1000 * rng.random()]) for k in range(25)}
    df = spark.createDataFrame([(str(k), 1000, k, t) for k, t in targets.items()], "source string, source_size long, rank long, target double")
    got = {r["rank"]: r.cuts for r in mixing.block_quotas(df, 8, 5).collect()}
    seats = int(sum(targets.values()) // 8)
    for shard in range(6):
        want = sainte_lague(targets, seats * shard // 5)
        assert {k: cuts[shard] for k, cuts in got.items()} == {k: want[k] for k in targets}
