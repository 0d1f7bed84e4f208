"""Queries that SQL does not express, against plain versions over the smallest tables."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusq import model, registry
from corpusq.functions.text import expand_query
from corpusq.operators import chunking, search
from corpusq.plans import chunks as chunk_plans
from corpusq.plans import retrieval

TOKEN = re.compile(r"[^\W]+")


def _run(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


def _token_set(text):
    return {t for t in TOKEN.findall(text.lower()) if len(t) > 1}


@pytest.fixture(scope="module")
def hits(spark, sf):
    found = defaultdict(list)
    for r in retrieval._hits(spark, sf).select("query_id", "id", "rank", "score", "text").collect():
        found[r.query_id].append(r)
    return {q: sorted(rows, key=lambda r: (r.rank, r.id)) for q, rows in found.items()}


def test_mmr(spark, sf, hits):
    def jaccard(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    expected = set()
    for q, rows in hits.items():
        sets = [_token_set(r.text) for r in rows]
        low, high = min(r.score for r in rows), max(r.score for r in rows)
        scaled = [(r.score - low) / (high - low) if high > low else 1.0 for r in rows]
        chosen = list(range(len(rows))) if len(rows) <= 10 else []
        while len(chosen) < min(10, len(rows)):
            def worth(i):
                like = max((jaccard(sets[i], sets[j]) for j in chosen), default=0.0)
                return 0.7 * scaled[i] - 0.3 * like

            chosen.append(max((i for i in range(len(rows)) if i not in chosen), key=lambda i: (worth(i), -i)))
        expected |= {(q, rows[i].id, n) for n, i in enumerate(chosen, 1)}
    assert {(r.query_id, r.id, r.mmr_rank) for r in _run(spark, sf, "mmr_select")} == expected


def test_short_chunks_take_their_neighbours(spark, sf):
    docs = defaultdict(list)
    for r in chunk_plans._fixed(spark, sf).select("doc_id", "chunk_index", "content").collect():
        docs[r.doc_id].append((r.chunk_index, r.content))
    expected = {}
    for doc, rows in docs.items():
        texts = [t for _, t in sorted(rows)]
        for i, own in enumerate(texts):
            front, back, size = [], [], len(own)
            for j in [*range(i - 1, -1, -1), *range(i + 1, len(texts))] if len(own) < 350 else []:
                if size < 850 and texts[j] not in own:
                    (front if j < i else back).append(texts[j])
                    size += len(texts[j])
            expected[doc, i] = "\n".join([*front[::-1], own, *back])
    found = {(r.doc_id, r.chunk_index): r.expanded for r in _run(spark, sf, "neighbour_expansion")}
    assert found == expected


def test_recall_is_expanded_variant_by_variant(spark):
    parent = lambda i: f"p{i % 7}"
    own = [(q, i, n, parent(i)) for q in (1, 2, 3) for n, i in enumerate(range(q * 10, q * 10 + 2 * q), 1)]
    more = [(q, v, i, n, parent(i)) for q in (1, 2, 3) for v in (0, 1, 2) for n, i in enumerate(range(q * 10 + v, q * 10 + v + 5), 1)]
    k, expected = 5, set()
    for q in (1, 2, 3):
        results = [(i, None, n, None) for x, i, n, _ in own if x == q]
        for v in (0, 1, 2):
            if len({parent(i) for i, *_ in results}) >= k:
                break
            size = len(results)
            for x, w, i, n, _ in more:
                if (x, w) == (q, v) and i not in {r[0] for r in results}:
                    results.append((i, v, n, round(1 / (60 + n + size), 9)))
        expected |= {(q, *r) for r in results}
    a = spark.createDataFrame(own, "query_id int, id int, rank int, parent_id string")
    b = spark.createDataFrame(more, "query_id int, variant int, id int, rank int, parent_id string")
    out = search.expand_recall(a, b, k).collect()
    assert {(r.query_id, r.id, r.variant, r.rank, r.score and round(r.score, 9)) for r in out} == expected
    assert len(out) == len(expected) > len(own)


def test_query_variants(spark, sf):
    texts = {r.item_id: r.text for r in model.read(spark, sf, "benchmark").collect()}
    found = defaultdict(set)
    for r in _run(spark, sf, "expanded_queries"):
        found[r.query_id].add(r.variant)
    stop = set("a an and are as at be by do does for from how in is it of on or that the this to was what when where which who why with".split())
    for q, text in texts.items():
        words = [w for w in re.findall(r"\w+", text.lower()) if w not in stop]
        assert " ".join(words) in found[q] and 1 <= len(found[q]) <= 5
        parts = [p.strip() for p in re.split("[,;:，；：、]", text)]
        assert found[q] <= {" ".join(words), *parts, *re.findall('"([^"]+)"', text), re.sub(r"[?？]+$", "", text.strip())}
    one = spark.range(1).select(expand_query(F.lit('How to "keep data" safe, and why?')).alias("v")).first().v
    assert one == ["keep data safe", "keep data", 'How to "keep data" safe', "and why?", '"keep data" safe, and why']


def test_linked_pages_keep_their_text(spark, sf):
    """Without the links the text is as before; each link is of a name, put in once."""
    docs = {r.doc_id: r.text for r in model.read(spark, sf, "documents").collect()}
    import hashlib

    from corpusq.operators import wiki
    from corpusq.plans import graphs

    names = defaultdict(set)
    for r in graphs._contributions(spark, sf).collect():
        names[r.doc_id].add((r.name, r.slug))
    found = {r.doc_id: (r.n_links, r.text_md5) for r in _run(spark, sf, "cross_linked_pages")}
    assert set(found) == set(names)
    for doc, own in names.items():
        text = wiki.inject_links(docs[doc], sorted(own))
        assert found[doc] == (text.count("[["), hashlib.md5(text.encode()).hexdigest())
        assert re.sub(r"\[\[[^\]|]+\|([^\]]*)\]\]", r"\1", text) == docs[doc]
        slugs = re.findall(r"\[\[([^\]|]+)\|", text)
        assert len(slugs) == len(set(slugs)) and set(slugs) <= {s for _, s in own}


@pytest.mark.parametrize("name", ["structural_chunks", "hierarchy_chunks"])
def test_chunks_cover_their_texts(spark, sf, name):
    docs = {r.doc_id: r.text for r in model.read(spark, sf, "documents").collect()}
    config = chunking.Config()
    spans = defaultdict(list)
    for r in _run(spark, sf, name):
        if name == "structural_chunks":
            assert 0 <= r.start_at < r.end_at <= len(docs[r.doc_id])
            spans[r.doc_id].append((r.start_at, r.end_at))
        elif r.chunk_type == "parent_text":
            assert r.end_at - r.start_at <= config.parent_size or chunking.protected_ranges(docs[r.doc_id][r.start_at : r.end_at])
            spans[r.doc_id].append((r.start_at, r.end_at))
        else:
            assert r.end_at - r.start_at <= config.child_size or chunking.protected_ranges(docs[r.doc_id][r.start_at : r.end_at])
    for doc, text in docs.items():
        covered = set()
        for a, b in spans[doc]:
            covered.update(range(a, b))
        assert not any(not c.isspace() for i, c in enumerate(text) if i not in covered)


def test_strategies_side_by_side(spark, sf):
    docs = {r.doc_id: r.text for r in model.read(spark, sf, "documents").collect()}
    items = {r.item_id: r.text for r in model.read(spark, sf, "benchmark").collect()}
    evidence = [(q, d, t.find(p), t.find(p) + len(p)) for q, p in items.items() for d, t in docs.items() if t and p in t]
    out = {r.strategy: r for r in _run(spark, sf, "strategy_evaluation")}
    chunks = chunk_plans._fixed(spark, sf).collect()
    assert out["fixed"].n_chunks == len(chunks) and out["fixed"].index_bytes == sum(len(c.content.encode()) for c in chunks)
    mrr = recall = precision = 0.0
    for q in items:
        own = [(d, a, b) for x, d, a, b in evidence if x == q]
        ranked = sorted((abs(c.start_at * 3 - len(docs[c.doc_id])), c.doc_id, c.start_at, c.end_at) for c in chunks if c.doc_id in {d for d, _, _ in own})[:20]
        good = [n for n, (_, d, s, e) in enumerate(ranked, 1) if any(d == x and s < b and e > a for x, a, b in own)]
        met = {x for x in own if any(d == x[0] and s < x[2] and e > x[1] for _, d, s, e in ranked)}
        mrr += 1 / good[0] if good and good[0] <= 10 else 0
        recall += len(met) / len(own) if own else 0
        precision += len(good) / len(ranked) if ranked else 0
    n = len(items)
    assert (out["fixed"].mrr, out["fixed"].recall, out["fixed"].precision) == pytest.approx((mrr / n, recall / n, precision / n), abs=2e-6)
    assert set(out) == {"fixed", "recursive", "auto"}
