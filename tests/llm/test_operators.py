"""The operators against plain versions and planted cases."""

import random
import time
from html.parser import HTMLParser
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    language_model,
    licenses,
    mixing,
    near_dup,
    quality,
    queries,
    secrets,
    shared,
    tokens,
    toxicity,
)

from . import brute


def _frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def _prose(draw, n):
    return " ".join(draw.choice("aethrn") + draw.choice(["er", "in", "on", "ath", "est"]) + str(draw.randrange(60)) for _ in range(n))


# tokens


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_word_hashes_agree_with_a_plain_split(texts):
    hashes, offsets = tokens.word_hashes(texts)
    assert np.diff(offsets).tolist() == [len(brute.words(t)) for t in texts]
    seen = {}
    flat = [w for t in texts for w in brute.words(t)]
    for w, h in zip(flat, hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# near duplicates


def _near_rows():
    draw = random.Random(3)
    rows, i = [], 0
    for _ in range(25):
        base = _prose(draw, draw.randrange(30, 120)).split()
        for _ in range(draw.randrange(1, 6)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                text[draw.randrange(len(text))] = f"x{draw.randrange(999)}"
            rows.append((i, " ".join(text)))
            i += 1
    return rows + [(i, ""), (i + 1, None), (i + 2, "a b"), (i + 3, "A, b!"), (i + 4, "a b c")]


def test_classes_and_links_are_those_of_all_pairs(spark):
    rows = _near_rows()
    classes, links = brute.near_classes(rows)
    out = {r.doc_id: r for r in near_dup.near_duplicates(_frame(spark, rows)).collect()}
    assert {i: r.class_id for i, r in out.items()} == classes
    texts = {}
    for i, t in rows:
        texts.setdefault(brute.shingles(t) or i, i)
    node = {i: texts[brute.shingles(t) or i] for i, t in rows}
    different = {tuple(sorted((node[a], node[b]))) for a, b in links if node[a] != node[b]}
    assert {i: r.n_links for i, r in out.items()} == {i: sum(node[i] in p for p in different) for i, _ in rows}


def test_large_buckets_lose_no_class(spark, monkeypatch):
    """With buckets of two or more treated as large, classes stay those of all pairs."""
    draw = random.Random(8)
    base = _prose(draw, 90).split()
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(draw.randrange(0, 5)):
            text[draw.randrange(len(text))] = f"x{draw.randrange(99)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, t) for i, t in _near_rows()]
    monkeypatch.setattr(near_dup, "PAIR_LIMIT", 2)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 4000)
    out = {r.doc_id: r.class_id for r in near_dup.near_duplicates(_frame(spark, rows)).collect()}
    assert out == brute.near_classes(rows)[0]


def test_large_buckets_count_all_links(spark, monkeypatch):
    """With small buckets treated as large and blocks of a few texts, n_links stay those of all pairs."""
    draw = random.Random(9)
    base = _prose(draw, 200).split()
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(draw.randrange(0, 4)):
            text[draw.randrange(len(text))] = f"x{draw.randrange(99)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, t) for i, t in _near_rows()]
    monkeypatch.setattr(near_dup, "PAIR_LIMIT", 2)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 8000)
    monkeypatch.setattr(near_dup, "COLUMNS", 50)
    texts = {}
    for i, t in rows:
        texts.setdefault(brute.shingles(t) or i, i)
    node = {i: texts[brute.shingles(t) or i] for i, t in rows}
    different = {tuple(sorted((node[a], node[b]))) for a, b in brute.near_classes(rows)[1] if node[a] != node[b]}
    expected = {i: sum(node[i] in p for p in different) for i, _ in rows}
    assert max(expected.values()) > 20
    assert {r.doc_id: r.n_links for r in near_dup.near_duplicates(_frame(spark, rows)).collect()} == expected


def test_ids_of_any_kind_and_repeated_ids_lose_no_link(spark):
    """Text ids; and ids that stand for several texts, which are each linked by themselves."""
    rows = _near_rows()
    named = [(f"d{i:04d}", t) for i, t in rows]
    classes, _ = brute.near_classes(named)
    out = near_dup.near_duplicates(_frame(spark, named, "doc_id string, text string"))
    assert {r.doc_id: r.class_id for r in out.collect()} == classes
    text = _prose(random.Random(1), 100).split()
    other = " ".join([*text[:50], "changed", *text[51:]])
    third = _prose(random.Random(2), 100)
    docs = _frame(spark, [(1, " ".join(text)), (2, " ".join(text)), (2, other), (2, third), (3, third)])
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in near_dup.near_duplicates(docs).collect())
    assert found == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (2, 2, 0), (3, 2, 0)]
    kept = sorted((r.doc_id, r.text) for r in near_dup.drop_near_duplicates(docs).collect())
    assert kept == sorted([(1, " ".join(text)), (2, third)])


def test_tables_too_large_to_broadcast_give_the_same(spark, monkeypatch):
    """With no table small enough to broadcast, all results stay."""
    rows = [*_near_rows(), *((500 + i, t) for i, t in _near_rows()), (1, None), (None, "x y"), (None, None)]
    docs = _frame(spark, rows)
    bench = _frame(spark, [(i, " ".join((t or "").split()[:15])) for i, t in rows[::9]], "item_id long, text string")

    def results():
        kept = [f(docs) for f in (exact_dedup.drop_exact_duplicates, near_dup.drop_near_duplicates)]
        told = [exact_dedup.exact_dedup(docs), near_dup.near_duplicates(docs), decontaminate.decontaminate(docs, bench)]
        told.append(decontaminate.drop_contaminated(docs, bench))
        return [sorted(map(str, d.collect())) for d in (*kept, *told)]

    before = results()
    assert 0 < len(before[1]) < len(before[0]) < len(rows) > len(before[-1]) > 0
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "BITS", 64)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    assert results() == before


def test_pruning_keeps_pairs_at_the_threshold():
    limits = near_dup.needed()
    draw = np.random.default_rng(1)
    n = 20_000
    a = np.zeros((n, near_dup.HASHES), np.uint32)
    keep = near_dup.surviving(a, (draw.random((n, near_dup.HASHES)) > 0.8).astype(np.uint32), limits)
    assert len(keep) > 0.999 * n
    keep = near_dup.surviving(a, (draw.random((n, near_dup.HASHES)) > 0.4).astype(np.uint32), limits)
    assert len(keep) < 0.2 * n


# decontamination


def test_windows_agree_with_a_plain_search(spark):
    draw = random.Random(5)
    items = [(i, _prose(draw, draw.choice([3, 9, 13, 14, 40]))) for i in range(30)]
    rows = []
    for i in range(80):
        text = _prose(draw, draw.randrange(5, 300)).split()
        for _ in range(draw.randrange(0, 4)):
            passage = draw.choice(items)[1].split()
            cut = draw.randrange(len(passage))
            piece = passage if draw.random() < 0.5 else passage[cut:]
            at = draw.randrange(len(text))
            text[at:at] = piece
        rows.append((i, ", ".join(text)))
    expected = brute.contamination(rows, items)
    bench = _frame(spark, items, "item_id long, text string")
    for most in (decontaminate.SHARD_WORDS, 20):
        decontaminate.SHARD_WORDS, before = most, decontaminate.SHARD_WORDS
        try:
            out = decontaminate.decontaminate(_frame(spark, rows), bench).collect()
            kept = {r.doc_id for r in decontaminate.drop_contaminated(_frame(spark, rows), bench).collect()}
        finally:
            decontaminate.SHARD_WORDS = before
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in out} == expected
        assert kept == {i for i, e in expected.items() if not e[3]}


def test_rows_are_judged_by_their_text_for_any_number_of_shards(spark, monkeypatch):
    draw = random.Random(12)
    items = [(None, _prose(draw, 30)), (1, _prose(draw, 400)), (1, _prose(draw, 20)), (2, "one two"), (3, None)]
    clean = [_prose(draw, 50) for _ in range(3)]
    bad = [" ".join(items[1][1].split()[a : a + 40]) for a in (0, 100, 360)]
    rows = [(None, clean[0]), (None, bad[0]), (1, clean[1]), (1, bad[1]), (1, bad[1]), (2, bad[2]), (3, clean[2]), (4, items[0][1]), (5, None)]
    docs, bench = _frame(spark, rows), _frame(spark, items, "item_id long, text string")
    stays = sorted([(None, clean[0]), (1, clean[1]), (3, clean[2]), (5, None)], key=str)
    judged = []
    for most in (decontaminate.SHARD_WORDS, 150, 16):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", most)
        assert sorted((tuple(r) for r in decontaminate.drop_contaminated(docs, bench).collect()), key=str) == stays
        judged.append(sorted(map(str, decontaminate.decontaminate(docs, bench).collect())))
    assert judged[0] == judged[1] == judged[2]


# secrets


def test_trigram_queries_are_implied_by_matches():
    q = secrets.trigram_query(r"(?:abc|xyz_?q)[0-9]+tail")
    assert q == ("and", (("or", ("abc", ("and", ("xyz", "yz_", "z_q")), ("and", ("xyz", "yzq")))), ("and", ("tai", "ail"))))
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is True
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))


@given(st.lists(st.sampled_from(["token=", "Password : ", '"', "AKIA", "ABCDEFGHIJKLMNOP", "deadbeefdeadbeef", "api_KEY=", "é", " ", "short", "0123456789abcdefg", "\n"]), max_size=14))
@settings(max_examples=150, deadline=None)
def test_scan_with_the_index_finds_what_plain_scans_find(parts):
    import re

    text = "".join(parts)
    expected = sorted(
        (m.start(), k, m.end())
        for k, r in enumerate(secrets.RULES)
        for m in re.finditer(r.pattern, text)
        if m.end(r.group) - m.start(r.group) >= r.least
    )
    assert secrets.Scanner(secrets.RULES).scan([None, text, ""]) == [[], expected, []]


# licences


def test_licences_are_found_whole_and_inside(spark):
    templates = dict(licenses.TEMPLATES)
    rows = [
        (1, templates["MIT-text"].upper()),
        (2, "Some prose.\nReleased under the MIT License.\nMore prose follows here."),
        (3, "Nothing of the kind stands here, only prose about a license."),
        (4, None),
        (5, templates["ISC"].replace("\n", " ") + "\n\nCopyright someone"),
    ]
    out = {r.doc_id: r for r in licenses.find_licences(_frame(spark, rows)).collect()}
    assert out[1].license == "MIT-text" and out[1].dice == 1.0
    assert out[2].license == "MIT" and out[2].licenses.split(",")[0] == "MIT"
    assert out[3].license is None and out[4].license is None and out[3].dice == 0.0
    assert out[5].license == "ISC"


def test_notices_that_are_no_segment_are_found(spark):
    templates = dict(licenses.TEMPLATES)
    draw = random.Random(5)
    prose = lambda: _prose(draw, 300)
    mit = templates["MIT-text"].split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    changed = " ".join(w if i % 25 else "other" for i, w in enumerate(templates["GPL-3.0-header"].split()))
    rows = [
        (1, f"{prose()}\n{wrapped}\n{prose()}"),
        (2, f"{prose()}\n\n{' '.join(mit[:60])}\n\n{' '.join(mit[60:120])}\n\n{' '.join(mit[120:])}\n\n{prose()}"),
        (3, f"{prose()} Released under the MIT License. {prose()}"),
        (4, f"{prose()} {changed} {prose()}"),
        (5, f"{prose()}\nReleased under the MIT License.\n{prose()} released under the MIT license {prose()}"),
        (6, f"{prose()} {' '.join(mit[:60])} {prose()}"),
        (7, f"{prose()} {templates['Apache-2.0-header']} {prose()}"),
    ]
    out = {r.doc_id: r for r in licenses.find_licences(_frame(spark, rows)).collect()}
    assert [out[i].licenses for i in range(1, 8)] == ["MIT-text", "MIT-text", "MIT", "GPL-3.0-header", "MIT", "", "Apache-2.0-header"]
    assert [out[i].n_segments for i in range(1, 8)] == [1, 1, 1, 1, 2, 0, 1]
    assert out[1].dice == out[2].dice == out[3].dice == 1.0 and 0.8 <= out[4].dice < 1.0


@given(st.integers(1, 400), st.integers(1, 400))
def test_size_bounds_prune_only_what_cannot_match(a, b):
    reach = (2 - licenses.THRESHOLD) / licenses.THRESHOLD
    if not b / reach <= a <= b * reach:
        assert 2 * min(a, b) / (a + b) < licenses.THRESHOLD


# mixing


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(2)
    rows = [(i, "w " * draw.randrange(0, 400), draw.choice(["big"] * 8 + ["mid", "s", None])) for i in range(1500)]
    docs = _frame(spark, rows, "doc_id long, text string, source string")
    out = mixing.mix_plan(docs).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert 0 <= r.copies <= 3 and r.target <= 3 * r.source_size + 1e-6
        by.setdefault(r.source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        taken = sum(r.copies * r["size"] for r in v)
        assert abs(taken - v[0].target) <= 3 * max(r["size"] for r in v)
    again = {(r.doc_id, r.copies) for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in out}
    mixed = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.copies for r in out if r.copies}


def test_the_mix_takes_what_is_planned(spark, monkeypatch):
    """Also of repeated rows, in any number of parts."""
    draw = random.Random(6)
    rows = [(i, "w " * draw.randrange(1, 90), "en", draw.choice("aab")) for i in range(60)]
    rows += [(7, "same text " * 9, lang, source) for source in ("a", "b", None) for lang in ("en", "fr", None) for _ in range(37)]
    rows += [(None, f"no id {i % 3}", "en", "a") for i in range(30)] + [(8, None, None, None)]
    docs = _frame(spark, rows, "doc_id long, text string, lang string, source string").withColumn("n", F.monotonically_increasing_id())
    for salts in (64, 1):
        monkeypatch.setattr(mixing, "SALTS", salts)
        plan = mixing.mix_plan(docs).collect()
        assert len(plan) == len(rows)
        mixed = mixing.mix(docs).collect()
        assert len(mixed) == sum(r.copies for r in plan)
        assert len({(r.n, r.copy_no) for r in mixed}) == len(mixed) and max(r.copy_no for r in mixed) <= 3
        for source in ("a", "b", None):
            own = [r for r in plan if r.source == source]
            taken = sum(r.copies * r["size"] for r in own)
            assert taken == sum(len((r.text or "").split()) for r in mixed if r.source == source)
            assert abs(taken - own[0].target) <= 3 * max(r["size"] for r in own)


# quality, toxicity, language model


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op5_quality(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = out.join(labels, "doc_id").selectExpr("avg(int(predicted = quality)) a", "count(*) n").first()
    assert r.n > 80 and r.a > 0.95


def test_quality_scores_are_those_of_a_plain_discriminant(spark):
    draw = random.Random(21)
    junk = lambda: " ".join(draw.choice(["BUY!!", "$$$", "||", "99", "now", "now"]) for _ in range(draw.randrange(5, 60)))
    rows = [(i, _prose(draw, draw.randrange(20, 200)) if i % 3 else junk()) for i in range(240)]
    labels = [(i, int(i % 3 > 0)) for i in range(200)] + [(5, 1), (5, 1), (6, None)]
    docs, known = _frame(spark, rows), _frame(spark, labels, "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality.quality_scores(docs, known).collect()}
    x = dict(zip((i for i, _ in rows), quality.statistics([t for _, t in rows])))
    training = [(x[i], y) for i, y in labels if y is not None and crc32(str(i).encode()) % 3 != 1]
    for i, _ in rows:
        expected = brute.discriminant(
            training, x[i], quality.SHRINK_POOLED, quality.SHRINK_DIAGONAL, quality.FLOOR, quality.TEMPER
        )
        assert out[i] == pytest.approx(expected, rel=1e-6, abs=1e-9)


def test_discriminant_separates_gaussians():
    draw = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {0: draw.normal(0, 1, (400, d)), 1: draw.normal(2, 0.5, (400, d))}
    model = quality.Discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()})
    assert (model.score(x[1]) > 0.5).mean() > 0.97 and (model.score(x[0]) < 0.5).mean() > 0.97


INSULTS = ["moron", "blockhead", "worthless", "numskull", "nitwit"]


def _labelled(draw, n):
    rows = []
    for i in range(n):
        text, toxic = _prose(draw, 60).split(), draw.random() < 0.4
        if toxic:
            for _ in range(2):
                text.insert(draw.randrange(len(text)), draw.choice(INSULTS))
        rows.append((i, " ".join(text) + ".", int(toxic)))
    return rows


def test_toxicity_on_held_out_and_disguised_insults(spark):
    rows = _labelled(random.Random(4), 700)
    docs = _frame(spark, [r[:2] for r in rows])
    labels = _frame(spark, [(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [r for r in rows if crc32(str(r[0]).encode()) % 5 == 0]
    assert all(out[r[0]].held_out for r in held)
    assert np.mean([out[i].predicted == y for i, _, y in held]) > 0.97
    model = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    clean = _prose(random.Random(9), 30)
    disguised = [f"{clean} {w}" for w in ("mor.on", "b-l-o-c-k-h-e-a-d", "n i t w i t", "worthhless", "num5kull")]
    assert (model.score(disguised) >= 0.5).mean() >= 0.8
    assert model.score([clean, "", None]).max() < 0.5


def test_collapsed_table_gives_the_kernel():
    words = [bytes(c - 96 for c in w.encode()) for w in ("idiot", "idxiot", "harmless", "abcabcabc")]
    for a, b in combinations(words, 2):
        table = toxicity._collapse([a], np.array([1.0]))
        value = toxicity.word_values(toxicity._joined([b]), table)[2][0]
        assert value == pytest.approx(float(toxicity.kernel([a], [b])[0, 0]), rel=1e-4)
    assert toxicity.kernel(words[:1], words[1:2])[0, 0] > 2 * toxicity.kernel(words[:1], words[2:3])[0, 0]


@given(st.text("abcdeo", min_size=3, max_size=9), st.text("abcdeo", min_size=3, max_size=9))
@settings(max_examples=60, deadline=None)
def test_kernel_is_that_of_all_subsequences(a, b):
    one, two = (bytes(ord(c) - 96 for c in w) for w in (a, b))
    assert float(toxicity.kernel([one], [two])[0, 0]) == pytest.approx(brute.subsequence_kernel(a, b), rel=1e-4, abs=1e-6)


def test_toxicity_sample_is_bounded_by_characters(spark, monkeypatch):
    rows = [(i, "x" * (100 + i)) for i in range(60)]
    docs = _frame(spark, rows)
    labels = _frame(spark, [(i, i % 2) for i in range(60)] + [(4, 0), (4, 0)], "doc_id long, toxic int")
    whole = toxicity.training_sample(docs, labels, "toxic")
    assert len(whole[0]) == sum(crc32(str(i).encode()) % 5 != 0 for i in range(60))
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2000)
    texts, ys = toxicity.training_sample(docs, labels, "toxic")
    for y in (0, 1):
        assert 500 < sum(len(t) for t, own in zip(texts, ys) if own == y) <= 1000
    assert set(texts) <= set(whole[0])


def test_language_model_does_not_depend_on_the_split_of_the_input(spark, monkeypatch):
    """Several shares, documents dealt to 1, 16 and 64 tasks: the same weights, so the same scores and gain."""
    monkeypatch.setattr(language_model, "SHARE", 6_000)
    monkeypatch.setattr(language_model, "GROUP", 2)
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{k} v{k % 7}" for k in draw.choices(range(40), k=draw.randrange(60)))) for i in range(400)]
    rows += [(None, "no id"), (7, "same id"), (7, "same id"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (1, 16, 64):
        out = language_model.lm_scores(docs.repartition(parts)).collect()
        found.append(sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.base_score, r.score) for r in out))
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        assert all(abs(a[3] - b[3]) < 1e-6 * max(1, abs(b[3])) for a, b in zip(other, found[0]))
    assert sum(r[3] - r[2] for r in found[0]) > 0


def test_language_model_base_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected, n = brute.unigram(rows)
    out = queries.op10_lm(spark, sf).collect()
    assert len(out) == len(rows) and {r.train_tokens for r in out} == {n}
    for r in out:
        assert (r.n_tokens, r.n_known) == expected[r.doc_id][:2]
        assert r.base_score == pytest.approx(expected[r.doc_id][2], rel=1e-9)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.85


def test_rare_tokens_are_counted_in_the_join(spark, monkeypatch):
    """With few tokens sent to the tasks the others meet their counts in the join."""
    draw = random.Random(17)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.4)) % 900}" for _ in range(draw.randrange(0, 60)))) for i in range(300)]
    expected, n = brute.unigram(rows)
    docs = _frame(spark, rows)
    for most in (language_model.FREQUENT, 5, 0):
        monkeypatch.setattr(language_model, "FREQUENT", most)
        out = language_model.lm_scores(docs).collect()
        for r in out:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (*expected[r.doc_id][:2], n)
            assert r.base_score == pytest.approx(expected[r.doc_id][2], rel=1e-9)


def test_class_scores_are_those_of_a_plain_softmax():
    """Every token's class probability and share, token by token."""
    texts = ["the cat sat, the dog.", "", "Über den Fluss. the end", None]
    hashes, tails, offsets = language_model.token_stream(texts)
    model = language_model.Model(np.unique(hashes)[:2])
    draw = np.random.default_rng(3)
    model.weights += draw.normal(size=model.weights.shape).astype(np.float32)
    model.bias += draw.normal(size=model.bias.shape).astype(np.float32)
    model.log_sizes += draw.random(model.log_sizes.shape)
    found = model.log10_classes(hashes, tails, offsets)
    shift = 64 - (language_model.BUCKETS.bit_length() - 1)
    mixed = lambda x: int(tokens.mix(np.array([x & (2**64 - 1)], np.uint64))[0]) >> shift
    start, salts = int(language_model._START), [int(s) for s in language_model._SALTS]
    singles = {int(h): k for k, h in enumerate(model.singles)}
    for a, b in zip(offsets, offsets[1:]):
        own, kinds = [int(h) for h in hashes[a:b]], [int(t) for t in tails[a:b]]
        for i, h in enumerate(own):
            last = [own[i - d] if i >= d else start for d in (1, 2)]
            near = [kinds[i - d] if i >= d else language_model.TAILS for d in (1, 2, 3)]
            rows = [mixed(last[0] ^ salts[0]), mixed(last[1] ^ salts[1]), mixed(((near[0] * 64 + near[1]) * 64 + near[2]) ^ salts[2])]
            logits = model.bias.astype(float) + sum(model.weights[r].astype(float) for r in rows)
            k = singles.get(h, kinds[i] + language_model.SINGLES)
            p = np.exp(logits[k]) / np.exp(logits).sum()
            assert found[a + i] == pytest.approx(np.log10(p) - model.log_sizes[k], abs=1e-4)


@given(st.lists(st.integers(0, 40), min_size=1, max_size=300))
@settings(max_examples=50, deadline=None)
def test_row_sums(rows):
    values = np.random.default_rng(len(rows)).normal(size=(len(rows), 5)).astype(np.float32)
    touched, sums, n = language_model.row_sums(np.array(rows), values)
    assert touched.tolist() == sorted(set(rows)) and n.tolist() == [rows.count(r) for r in touched]
    for r, s in zip(touched, sums):
        assert np.allclose(s, values[np.array(rows) == r].sum(axis=0), atol=1e-4)


def test_class_probabilities_add_up():
    model = language_model.Model(np.array([5, 9], np.uint64))
    model.weights += np.random.default_rng(0).normal(size=model.weights.shape).astype(np.float32)
    hashes, tails, offsets = language_model.token_stream(["the cat sat, then.", "", "über ñandú"])
    p = model.probabilities(language_model.features(hashes, tails, offsets))
    assert p.shape == (len(hashes), language_model.CLASSES)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    model.weights *= 300  # far apart logits
    p = model.probabilities(language_model.features(hashes, tails, offsets))
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.diff(offsets).tolist() == [5, 1, 3]


# exact duplicates


@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from([None, "", " ", "a b", "a  b", "a\tb", "A b", "a b ", "x" * 70, "x" * 70 + "y"])), max_size=12))
@settings(max_examples=6, deadline=None)
def test_exact_groups(spark, rows):
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    out = exact_dedup.exact_dedup(_frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.normal(t), []).append(i)
    expected = {i: (min(g), len(g), i == min(g), brute.sha(t)) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out} == expected


# html


def test_frame_inside_the_article_goes_and_quotations_stay(spark):
    quoted = "A passage that two of the articles quote."
    own = [f"Story {i} has words of its own, number {i} of them, at some length and to its end." for i in range(9)]
    body = lambda i: f"<p>{own[i]}</p>" + (f"<p>{quoted}</p>" if i in (4, 5) else "")
    html = lambda i: f"<article><p>Share this story</p>{body(i)}<p>All rights kept</p></article>"
    rows = [(i, f"http://h/a/{i}", html(i)) for i in range(9)] + [(20 + i, f"http://v/a/{i}", f"<article><p>{own[0]}</p><p>version {i}</p></article>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_text.extract(pages.coalesce(1)).collect()}
    middle = html_text.Page(4, "u", "h", "/a/4", html_text.lines_of(html(4)))
    around = [html_text.Page(i, "u", "h", f"/a/{i}", html_text.lines_of(html(i))) for i in (1, 2, 3, 5, 6, 7)]
    assert html_text.main_text(middle, around) == f"{own[4]}\n{quoted}"
    assert out[4].split("\n")[:1] == [own[4]] and quoted in out[4] and quoted in out[5]
    assert [out[20 + i] for i in range(4)] == [f"{own[0]}\nversion {i}" for i in range(4)]


def test_pages_agree_with_a_plain_pass_over_all_of_them(spark):
    """However the ranges are cut, a page meets the three before and after it in the whole order."""
    draw = random.Random(13)
    rows = []
    for i in range(140):
        host = draw.choice(["a.org", "a.org", "b.net", "c.com"])
        frame = [f"Menu of {host}", f"Part {i % 3} of {host}"]
        body = [_prose(draw, 8) for _ in range(draw.randrange(4))] + draw.sample([f"Quote {k}" for k in range(4)], 1)
        lines = "".join(f"<p>{x}</p>" for x in [*frame, *body, f"Imprint of {host}"])
        html = f"<article>{lines}</article>" if i % 2 else f"<body>{lines}<form>mail</form></body>"
        rows.append((draw.choice([i, 7, None]), draw.choice([f"http://{host}/x/{i % 9}", f"http://{host}/y/{i}", None]), draw.choice([html, html, html, None])))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hashed = pages.select("*", html_text._host(F.col("url")).alias("host"), html_text._path(F.col("url")).alias("path"), F.xxhash64("html").alias("h"))
    known = sorted(hashed.collect(), key=lambda r: (r.host, r.path, r.page_id is not None, r.page_id or 0, r.h))
    whole = [html_text.Page(r.page_id, r.url, r.host, r.path, html_text.lines_of(r.html)) for r in known]
    plain = [html_text.main_text(p, whole[max(0, i - 3) : i] + whole[i + 1 : i + 4]) for i, p in enumerate(whole)]
    expected = sorted((str(r.page_id), str(r.url), t) for r, t in zip(known, plain))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        for parts in (1, 3, 16, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            out = html_text.extract(pages.repartition(2)).collect()
            assert sorted((str(r.page_id), str(r.url), r.text) for r in out) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(coalesce, "true")


def test_article_without_furniture():
    html = """<html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><header>site</header>
    <div id="cookie-notice">we use cookies</div><main><article><header><h1>Title</h1><span>by x</span></header>
    <p>One<br>two &eacute;&nbsp;x</p><div class="ad">buy</div><ul><li>a</li><li>b</li></ul><form>mail</form>
    <section class="comments"><p>first!</p></section></article></main><aside>more</aside><script>var x="<p>no</p>"</script><footer>f</footer></body></html>"""
    page = html_text.Page(1, "u", "h", "/a", html_text.lines_of(html))
    assert html_text.main_text(page, [None]) == "Title\nOne two é x\na\nb"


def test_lines_that_the_site_repeats_go():
    page = lambda i, body: html_text.Page(i, "u", "h", f"/a/{i}", html_text.lines_of(f"<p>Welcome</p><p>All news</p>{body}<p>Imprint</p>"))
    a, b = page(1, "<p>First story of its own, at length.</p>"), page(2, "<p>Another story, quite other words.</p>")
    assert html_text.main_text(a, [None, b]) == "First story of its own, at length."
    assert html_text.main_text(a, [a]) == "Welcome\nAll news\nFirst story of its own, at length.\nImprint"


def _text(html):
    return html_text.main_text(html_text.Page(1, "u", "h", "/a", html_text.lines_of(html)), [None])


def test_names_inside_an_article_do_not_drop_its_text():
    html = """<nav>menu</nav><article><h2 id="related-work">Related work</h2><section id="social-history"><p>Told.</p></section>
    <h2 id="comments-on-policy">Comments on policy</h2><p class="menu-planning">Plans.</p><section id="notices"><p>Noted.</p></section>
    <div class="promo box-2"><p>buy</p></div><div id="comments"><p>first!</p></div><div class="userComments"><p>second</p></div></article>"""
    assert _text(html) == "Related work\nTold.\nComments on policy\nPlans.\nNoted."


def test_an_article_in_a_container_named_like_furniture_stays():
    assert _text('<div class="ad-hoc"><article>body</article></div>') == "body"
    assert _text('<div class="sidebar"><article>body<div class="ad">buy</div></article></div>') == "body"
    assert _text('<div id="comments"><article>reply</article></div><main>story</main>') == "story"
    assert _text("<aside><article>teaser</article></aside><p>story</p>") == "story"


def test_the_header_of_an_article_keeps_its_paragraphs():
    html = "<header><p>site</p></header><article><header><h1>Title</h1><p>Standfirst.</p><nav><p>share</p></nav></header><p>Text.</p></article>"
    assert _text(html) == "Title\nStandfirst.\nText."


def test_odd_pages_take_linear_time():
    n = 40_000
    begin = time.monotonic()
    for html in ('<a href="x>' * n, "<a '\">\" " * n, "<div>" * n + "</p>" * n, "<a " * n, "<!" * n, "<" * n):
        html_text.lines_of(f"{html}end")
    assert time.monotonic() - begin < 10
    lines = ["x", "y"] * 10_000
    begin = time.monotonic()
    assert len(html_text.shared_lines(["p", *lines], [*lines[1:], "q"])) == len(lines) - 1
    assert time.monotonic() - begin < 10


class _Plain(HTMLParser):
    """Blocks of a well-formed page in an independent way: each element asks all that it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.within, self.blocks, self.text = [], [], ""

    def close_block(self):
        words = self.text.split()
        self.text = ""
        if words:
            names = [x for x, _ in self.within]
            named = [c for _, c in self.within]
            frame = any(x in ("nav", "footer", "aside", "form", "header", "script") for x in names) or "ad" in named or "comment-list" in named
            self.blocks.append((" ".join(words), "article" in names, frame))

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a"):
            self.close_block()
        self.within.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.close_block()
        self.within.pop()

    def handle_data(self, data):
        self.text += data


def test_pages_agree_with_an_independent_extractor(spark):
    """Other parser, other alignment (a whole table of lengths, all ties open where lines are unlike)."""
    draw = random.Random(31)
    rows = []
    for i in range(60):
        host = draw.choice(["a.org", "b.net"])
        body = [f"<p>{_prose(draw, 6)} <b>{i}</b> &amp; more</p>" for _ in range(draw.randrange(1, 5))]
        body += draw.sample(['<div class="ad">buy</div>', '<div class="comment-list"><p>first</p></div>', "<p>Share this</p>", '<h2 id="related-work">Work</h2>', "<form>mail</form>"], 3)
        inner = "".join(body)
        html = f"<header>{host}</header><nav><a>home</a></nav><article>{inner}<p>Rights of {host}</p></article><footer>end</footer>"
        rows.append((i, f"http://{host}/p/{i:03}", html))
    ordered = sorted(rows, key=lambda r: (r[1].split("/")[2], r[1]))
    parsed = {}
    for i, url, html in rows:
        page = _Plain()
        page.feed(html)
        page.close_block()
        parsed[i] = (url.split("/")[2], page.blocks)

    def shared(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        out = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(i)
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    expected = {}
    for place, (i, _, _) in enumerate(ordered):
        host, blocks = parsed[i]
        lines = [b[0] for b in blocks]
        near = [parsed[r[0]] for r in ordered[max(0, place - 3) : place] + ordered[place + 1 : place + 4]]
        aligned = [shared(lines, [b[0] for b in other]) for h, other in near if h == host]
        inside = [k for k, b in enumerate(blocks) if b[1] and not b[2]]
        frame = {k for k in inside if sum(k in s for s in aligned) >= 3 and 2 * sum(k in s for s in aligned) > len(aligned)}
        if 2 * sum(len(lines[k]) for k in frame) > sum(len(lines[k]) for k in inside):
            frame = set()
        expected[i] = "\n".join(lines[k] for k in inside if k not in frame)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == expected


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = sorted(html_text.shared_lines(a, b))
    assert len(found) == best[-1][-1]
    it = iter(b)
    assert all(a[i] in it for i in found)
    for align in (html_text._by_meetings, html_text._by_bits):
        found, it = sorted(align(a, b)), iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in it for i in found)


def test_toxicity_sample_keeps_both_labels(spark, monkeypatch):
    """A very long document, one that repeats its id and one that repeats its row shut none out."""
    ids = [i for i in range(400) if crc32(str(i).encode()) % 5 != 0][:40]
    rows = [(i, f"text {i}") for i in ids]
    labels = _frame(spark, [(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    plain = toxicity.training_sample(_frame(spark, rows), labels, "toxic")
    assert sum(plain[1]) == 20
    long = {i: "word " * 3_000_000 for i in ids[1::2][:3]}  # toxic, each longer than the label's share
    mended = [(i, long.get(i, t)) for i, t in rows]
    mended += [(ids[0], f"again {k}") for k in range(300)] + [(ids[2], None)] * 500 + [(ids[4], "")] * 500
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 200)
    texts, ys = toxicity.training_sample(_frame(spark, mended), labels, "toxic")
    assert sum(ys) == 17 and len(ys) - sum(ys) == 19 + 2  # without ids[0]; two with a second text
    only = [(i, "word " * (40 + i)) for i in ids]
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100)
    texts, ys = toxicity.training_sample(_frame(spark, only), labels, "toxic")
    assert sorted(ys) == [0, 1]  # the shortest of each


def _plain_ranges(ranges, wanted):
    taken, out = list(ranges), []
    for b, e in wanted:
        out.append(all(e <= x or y <= b for x, y in taken))
        if out[-1]:
            taken.append((b, e))
    return out


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_ranges_that_are_taken(given_ranges, wanted):
    one, two = ([(b, b + n) for b, n in r] for r in (given_ranges, wanted))
    taken = licenses.Taken(one)
    assert [taken.add(b, e) for b, e in two] == _plain_ranges(one, two)


def test_many_notices_in_one_text():
    """The work grows with the text: as many notices are counted as stand there."""
    notice = next(t for name, t in licenses.TEMPLATES if name == "MIT")
    found = licenses.Licences(licenses.TEMPLATES, licenses.THRESHOLD).best_of([("so and so " + notice + " and more ") * 5000])
    assert [(name, n) for name, _, n in found[0]][:1] == [("MIT", 5000)]
