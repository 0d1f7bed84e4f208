"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations
from math import exp, log10, sqrt
from zlib import crc32

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def near_classes(rows, threshold=0.8):
    """{doc_id: class} and the links of (doc_id, text) rows."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, links = sorted(sets), set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y):
                if x != y:
                    links.add((a, b))
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}, links


def contamination(rows, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item) if item is not None else "")
    out = {}
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def unigram(rows):
    """{doc_id: (n_tokens, n_known, base_score)} and the number of training tokens."""
    tokens = {i: [*SPACED.findall((t or "").translate(LOWER)), None] for i, t in rows}
    counts = Counter()
    for i, w in tokens.items():
        if crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    score = lambda w: sum(log10((counts[x] + 1) / (n + v + 1)) for x in w)
    return {i: (len(w), sum(counts[x] > 0 for x in w), score(w)) for i, w in tokens.items()}, n


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def subsequence_kernel(a, b, sizes=(3, 4), reach=6, decay=0.8):
    """Gap-weighted subsequence kernel of two words by listing all subsequences."""

    def weights(word):
        out = Counter()
        for size in sizes:
            for at in combinations(range(len(word)), size):
                span = at[-1] - at[0] + 1
                if span <= reach:
                    out[tuple(word[i] for i in at)] += decay**span
        return out

    def norm(n):
        shapes = (at for size in sizes for at in combinations(range(n), size) if at[-1] - at[0] < reach)
        return sqrt(sum(decay ** (2 * (at[-1] - at[0] + 1)) for at in shapes))

    x, y = weights(a), weights(b)
    return sum(x[k] * y[k] for k in x) / (norm(len(a)) * norm(len(b)))


def discriminant(rows, x, pooled_share, diagonal_share, floor, temper):
    """Probability of class 1 for ``x`` from (features, class) rows, by densities."""
    by = {k: np.array([f for f, c in rows if c == k]) for k in (0, 1)}
    covs = {k: np.cov(v.T, bias=True) for k, v in by.items()}
    pooled = sum(len(by[k]) * covs[k] for k in by) / len(rows)
    logs = {}
    for k, v in by.items():
        cov = (1 - pooled_share) * covs[k] + pooled_share * pooled
        cov = (1 - diagonal_share) * cov + diagonal_share * np.diag(np.diag(cov)) + floor * np.eye(len(cov))
        d = x - v.mean(axis=0)
        density = -0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1]
        logs[k] = temper * density + np.log(len(v) / len(rows))
    return 1 / (1 + exp(logs[0] - logs[1]))
