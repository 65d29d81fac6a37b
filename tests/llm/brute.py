"""What the operators have to return, written out plainly for small tables."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def top_k(vectors, k=5, scale=256, every=50):
    """(query, rank, other, score) from (id, vector) pairs."""
    whole = [
        (i, [math.floor(float(x) * scale) for x in v])
        for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in whole:
        if q % every == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(a) == len(b))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(hits[:k], 1)}
    return out


def near_groups(docs, percent=85, length=5):
    """(id, set size, component) from (id, text) pairs."""
    sets = {}
    for i, text in docs:
        w = [re.sub(rb"[A-Z]+", lambda m: m[0].lower(), x) for x in words(text)]
        sets[i] = {tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1))} if w else set()
    least = {i: i for i in sets}
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = Counter((a, b) for ids in by_shingle.values() for n, a in enumerate(ids) for b in ids[n + 1 :])

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for (a, b), common in pairs.items():
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            least[b] = a
    return {(i, len(s), root(i)) for i, s in sets.items()}


def without_repeats(docs, passage=35):
    """(id, words, removed words, kept text) from (id, text) pairs."""
    split = [(i, words(text)) for i, text in docs]
    seen = Counter(tuple(w[k : k + passage]) for _, w in split for k in range(len(w) - passage + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - passage + 1):
            if seen[tuple(w[k : k + passage])] > 1:
                gone[k : k + passage] = [True] * passage
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
