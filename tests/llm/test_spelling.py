"""Spelling variants against a plain version over all pairs of words."""

import random
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq.llm import queries, spelling

SCHEMA = "doc_id long, text string"


def _runs(text):
    run = ""
    for c in (text or "") + "\n":
        if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
            run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif run:
            yield run
            run = ""


def _one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in _runs(text):
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [u for u in n if abs(len(u) - len(w)) < 2 and _one_error(w, u)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


def _out(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def _rows(seed, stems=40, docs=60):
    draw = random.Random(seed)
    letters = "abcdeé"
    base = ["".join(draw.choice(letters) for _ in range(draw.randrange(4, 11))) for _ in range(stems)]
    words = []
    for w in base:
        words += [w] * draw.choice([1, 3, 9, 30])
        for _ in range(draw.randrange(5)):
            k, c = draw.randrange(len(w)), draw.choice(letters)
            v = draw.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words += [v] * draw.choice([1, 2, 4])
    return [(i, " ".join(draw.choice((w, w.upper(), w.capitalize())) for w in draw.choices(words, k=80))) for i in range(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_words_and_forms_are_those_of_all_pairs(spark, seed):
    rows = _rows(seed)
    expected = _plain(rows)
    assert any(f for _, f, *_ in expected) and any(r not in (w, f) for w, f, r, *_ in expected)
    assert _out(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA))) == expected


def test_buckets_dealt_in_blocks(spark, monkeypatch):
    """With blocks of three words every bucket of more is dealt over groups."""
    rows = _rows(7)
    monkeypatch.setattr(spelling, "BLOCK", 3)
    assert _out(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA))) == _plain(rows)


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _out(queries.op12_spelling(spark, sf)) == _plain(rows)


def test_odd_rows(spark):
    long = "Wordy wordz Überall " * 30_000
    rows = [(1, None), (2, ""), (3, " 12 "), (4, long), (None, "nameless " * 5), (5, "é" * 50_000 + " " + "twins " * 3), (5, "twins " * 3), (5, "twins " * 3)]
    rows += [(6, "×÷×÷× " * 4), (7, "naïve naïves naives " * 4), (8, "Ärger ärger " * 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("word", "n", "form", "half", "key", "role")})
    assert _out(spelling.spelling_variants(df)) == _plain(rows)
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_chains_are_followed_to_the_end(spark):
    forms = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(40)] + [("v", "w039")]
    roots = {r.word: r.root for r in spelling.followed(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert roots == {w: "w040" for w, _ in forms}


@given(st.lists(st.text("abé", min_size=5, max_size=9), min_size=2, max_size=70, unique=True))
@settings(max_examples=200, deadline=None)
def test_recurrences_find_one_error(words):
    index = spelling.Index([(w, k) for k, w in enumerate(words)])
    for w in words:
        expected = {u for u in words if _one_error(w, u)}
        read = lambda found: {index.words[k][0] for k in range(len(words)) if found >> k & 1}
        assert read(index.near(w)) == expected
        parts = [read(index.near(w, half, first)) for half in {len(w) // 2, (len(w) - 1) // 2} for first in (True, False)]
        assert set().union(*parts) == expected and sum(map(len, parts)) == len(expected)
