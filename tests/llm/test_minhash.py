"""MinHash components against a plain version over all pairs of documents."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq.llm import minhash_dedup, queries

from . import brute

SCHEMA = "doc_id long, text string"


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOWER))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def _plain(rows):
    sets = {i: _set(t) for i, t in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def _out(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def _prose(draw, n):
    return [draw.choice("aethrn") + draw.choice(["er", "in", "on", "ath"]) + str(draw.randrange(60)) for _ in range(n)]


def _families(seed, families=25, most=6, changes=(0, 0, 1, 2, 3)):
    draw, rows = random.Random(seed), []
    for _ in range(families):
        base = _prose(draw, draw.randrange(40, 200))
        for _ in range(draw.randrange(1, most)):
            text = list(base)
            for _ in range(draw.choice(changes)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(999)}"
            rows.append((len(rows), " ".join(text)))
    return rows + [(5000, ""), (5001, None), (5002, "a b"), (5003, "A  B"), (5004, "a b c"), (5005, "a, b")]


def test_components_are_those_of_all_pairs(spark):
    rows = _families(3)
    assert _out(minhash_dedup.minhash_duplicates(spark.createDataFrame(rows, SCHEMA))) == _plain(rows)


@pytest.mark.parametrize("seed", range(2))
def test_large_buckets_lose_no_component(spark, monkeypatch, seed):
    """Buckets of three or more are large, blocks hold a few texts, chains link texts that are unlike their hub."""
    draw = random.Random(seed)
    rows = _families(seed, 12, 20, (0, 1, 2, 3, 4))
    text = _prose(draw, 150)
    for i in range(40):  # each is near to the one before, the last is unlike the first
        text[draw.randrange(len(text))] = f"y{i}"
        rows.append((6000 + i, " ".join(text)))
    monkeypatch.setattr(minhash_dedup, "PAIR_LIMIT", 2)
    monkeypatch.setattr("corpusq.llm.near_dup.BLOCK_BYTES", 6000)
    assert _out(minhash_dedup.minhash_duplicates(spark.createDataFrame(rows, SCHEMA))) == _plain(rows)


def test_exactly_the_threshold_is_linked(spark):
    words = [f"w{k}" for k in range(189)]
    # 185 shingles; 15 others at the end of the second leave 170 of 200 in common, 16 leave 169 of 201
    at, below = words[:174] + [f"v{k}" for k in range(15)], words[:173] + [f"v{k}" for k in range(16)]
    for other, same in ((at, True), (below, False)):
        rows = [(1, " ".join(words)), (2, " ".join(other))]
        x, y = _set(rows[0][1]), _set(rows[1][1])
        assert (100 * len(x & y) >= 85 * len(x | y)) == same
        assert _out(minhash_dedup.minhash_duplicates(spark.createDataFrame(rows, SCHEMA))) == _plain(rows)


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _out(queries.op13_minhash(spark, sf)) == _plain(rows)


def test_odd_rows(spark):
    long = " ".join(_prose(random.Random(1), 60_000))
    twin = "one two three four five six seven"
    rows = [(1, twin), (2, twin.upper()), (2, twin), (2, twin), (3, long), (4, long + " more"), (5, None), (6, " \t"), (None, twin), (None, None), (7, long.replace(" ", "\n"))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("node", "comp", "sig", "component_id", "kept", "__id", "__hash", "g", "h1")})
    out = minhash_dedup.minhash_duplicates(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert {i: r.component_id for i, r in by.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 3}
    assert {i: r.n_shingles for i, r in by.items()} | {3: 0, 4: 0, 7: 0} == {1: 3, 2: 3, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    left = minhash_dedup.keep_first(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 1), (False, 3), (False, 5), (False, 6), (True, 0), (True, 0)]
    assert minhash_dedup.minhash_duplicates(df.where("false")).count() == minhash_dedup.keep_first(df.where("false")).count() == 0


def test_text_ids(spark):
    rows = [(f"d{i:05d}", t) for i, t in _families(4, 8)]
    assert _out(minhash_dedup.minhash_duplicates(spark.createDataFrame(rows, "doc_id string, text string"))) == _plain(rows)


@given(st.integers(0, 1 << 32), st.integers(200, 400), st.floats(0.5, 1))
@settings(max_examples=40, deadline=None)
def test_equal_minima_estimate_the_coefficient(seed, size, share):
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 1 << 63, size, dtype=np.uint64)
    y = np.concatenate([x[: int(size * share)], draw.integers(0, 1 << 63, size - int(size * share), dtype=np.uint64)])
    x, y = np.unique(x), np.unique(y)
    coefficient = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    _, _, rows = minhash_dedup.minima([x, y])
    assert abs((rows[0] == rows[1]).mean() - coefficient) < 6 * (coefficient * (1 - coefficient) / minhash_dedup.HASHES) ** 0.5 + 0.02


def test_signature_limit_is_the_binomial_one():
    m = minhash_dedup.least_equal()
    draw = np.random.default_rng(1).binomial(minhash_dedup.HASHES, 0.85, 4_000_000)
    assert 70 < m < draw.min()
