"""Known values, invariants and order-independence of the operators."""

import base64
import io
import json
import random
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq import model, tables, tools
from corpusq.functions import text as T
from corpusq.functions import vectors as V
from corpusq.operators import catalog, chunking, evaluation, fusion, graph, history, lexical, retrieval_context, usage, wiki
from corpusq.sources import parse, sinks
from corpusq.streaming import jobs


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def ranked(spark, lists):
    rows = [(q, i, r) for q, ids in lists.items() for r, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id int, id string, rank int")


# fusion


def test_reciprocal_rank_fusion(spark):
    out = fusion.rrf(ranked(spark, {1: ["A", "B", "C"]}), ranked(spark, {1: ["A", "C"]})).orderBy("rank").collect()
    assert [r.id for r in out] == ["A", "C", "B"]
    assert out[0].score == pytest.approx(2 / 61)


def test_rerank_keeps_the_order_of_what_the_scorer_leaves(spark):
    hits = ranked(spark, {1: list("abcde")})
    score = F.when(F.col("id") == "c", 0.9).when(F.col("id") == "a", 0.1)
    out = fusion.rerank(hits, score, 4).orderBy("final_rank").collect()
    assert [r.id for r in out] == ["c", "a", "b", "d", "e"]


def test_mmr_prefers_other_words_and_leaves_short_lists(spark):
    rows = [(1, "a", 1.0, 1, ["x", "y"]), (1, "b", 0.5, 2, ["x", "y"]), (1, "c", 0.45, 3, ["z"]), (1, "e", 0.0, 4, ["w"]), (2, "d", 1.0, 1, ["x"])]
    hits = spark.createDataFrame(rows, "query_id int, id string, score double, rank int, tokens array<string>")
    out = {(r.query_id, r.mmr_rank): r.id for r in fusion.mmr(hits, 2).collect()}
    assert out == {(1, 1): "a", (1, 2): "c", (2, 1): "d"}


def test_greedy_dedupe_keeps_the_better(spark):
    long = "the same long sentence said again and again until it is longer than eighty characters, yes"
    rows = [(1, "a", 1, long), (1, "b", 2, long + " more"), (1, "c", 3, "other")]
    hits = spark.createDataFrame(rows, "query_id int, id string, rank int, text string").withColumn("tokens", T.token_set(F.col("text")))
    assert {r.id for r in fusion.greedy_dedupe(hits).collect()} == {"a", "c"}


def test_graph_hits_merge_into_documents(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id int, id string, rank int, text string").withColumn("tokens", T.token_set(F.col("text")))
    out = fusion.merge_cohorts(make([(1, "d", 1, "alpha beta gamma")]), make([(1, "g", 1, "alpha beta gamma"), (1, "h", 2, "delta")])).collect()
    assert {r.id: r.merged_into for r in out} == {"g": "d", "h": None}


# evaluation


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    relevant = spark.createDataFrame([(1, "b"), (1, "c"), (1, "z")], "query_id int, id string")
    out = {r.query_id: (r.mrr, r.recall) for r in evaluation.ranking_metrics(ranked(spark, {1: ["a", "b", "c"], 2: ["a"]}), relevant, q).collect()}
    assert out == {1: (0.5, pytest.approx(2 / 3)), 2: (0.0, 0.0)}


def test_spans_overlap(spark):
    c = lambda a, b: one(spark, evaluation.overlaps(F.lit(a), F.lit(b), F.lit(100), F.lit(180)))
    assert c(80, 140) and not c(180, 200) and not c(0, 100)


@pytest.mark.parametrize("mrrs,ms,size,expected", [((0.10, 0.105, 0.10815), 200, 200, (True, True)), ((0.0, 0.1, 0.2), 100, 100, (False, True)), ((0.1, 0.105, 0.2), 201, 100, (True, False))])
def test_release_gates(spark, mrrs, ms, size, expected):
    rows = [(s, m, 0.5, 0.5, 100 if s != "semantic" else ms, 100 if s != "semantic" else size) for s, m in zip(("fixed", "auto", "semantic"), mrrs)]
    r = evaluation.release_gates(spark.createDataFrame(rows, "strategy string, mrr double, recall double, precision double, duration_ms long, index_bytes long")).first()
    assert (r.auto_passed, r.semantic_passed) == expected


def test_templates_and_case_errors(spark):
    assert one(spark, evaluation.is_template(F.array(F.lit("placeholder-1"))))
    assert not one(spark, evaluation.is_template(F.array(F.lit("17"))))
    rows = [(1, "q", "d", "a" * 64, 100, 5, 10, "e"), (2, " ", None, "v", 100, 90, 120, "")]
    cases = spark.createDataFrame(rows, "case_id int, query string, doc_id string, version string, n_chars int, source_start int, source_end int, answer_evidence string")
    out = evaluation.case_errors(cases).collect()
    assert {r.case_id for r in out} == {2} and len(out) == 5


# usage


def test_usage_golden(spark):
    rows = [("chat", True, 120, 80, 200, 20), ("chat", False, 50, 0, 50, 0)]
    u = spark.createDataFrame(rows, "model_type string, success boolean, prompt_tokens long, completion_tokens long, total_tokens long, cached_tokens long")
    r = usage.totals(u).first()
    assert (r.calls, r.successes, r.failures, r.total_tokens, r.success_rate) == (2, 1, 1, 250, 0.5)
    assert usage.totals(u.where("false")).first().success_rate == 0.0


def test_cache_rates(spark):
    rows = [("chat", 100, 40), ("embedding", 300, 150), ("embedding", 200, 50), ("extract", 5, 5)]
    u = spark.createDataFrame(rows, "model_type string, prompt_tokens long, cached_tokens long")
    assert {r.model_type: r.cache_rate for r in usage.cache_rates(u).collect()} == {"chat": 0.4, "embedding": 0.4}
    assert one(spark, T.safe_rate(F.lit(240), F.lit(820))) == 0.2927


def test_bounds():
    assert usage.days_or_default(None) == 7 and usage.days_or_default(500) == 90
    assert catalog.bounded("x", 1, 10, 99) == 99 and catalog.bounded("x", 1, 10, 99, True) == 10 and catalog.bounded("7", 1, 5, 3) == 5


# chunking


def test_fixed_windows_golden(spark):
    """Figures of all documents of at most 4,000 characters at sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars <= 4000")
    c = chunking.fixed_chunks(docs)
    r = c.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.round(F.avg(F.col("end_at") - F.col("start_at")), 3).alias("w")).first()
    assert (r.n, r.d, r.w) == (3533, 851, 417.037)


@given(st.text(alphabet="ab \n.#`。", max_size=900), st.sampled_from(["auto", "recursive", "fixed", "heading", "layout"]))
@settings(max_examples=120, deadline=None)
def test_chunks_cover_the_text(text, strategy):
    config = chunking.Config(size=64, overlap=16, child_size=64, child_overlap=16, parent_size=128)
    spans = chunking.structural_spans(text, config, strategy)
    covered = set()
    for a, b, _, _ in spans:
        assert 0 <= a < b <= len(text)
        covered.update(range(a, b))
    assert not [i for i in range(len(text)) if not text[i].isspace() and i not in covered]
    assert [s[0] for s in spans] == sorted(s[0] for s in spans)


def test_headings_make_breadcrumbs():
    text = "# A\n\nintro\n\n## B\n\nbody\n\n# C\n\nend\n"
    out = chunking.structural_spans(text, chunking.Config(size=64, overlap=8))
    assert [(h, s) for _, _, h, s in out] == [("A", "heading"), ("A > B", "heading"), ("C", "heading")]


def test_code_fences_are_not_cut():
    text = "x " * 40 + "```\n" + "code\n" * 20 + "```\n" + "y " * 40
    fence = (text.index("```"), text.rindex("```") + 3)
    for a, b in chunking.recursive_spans(text, 0, len(text), 120, 0):
        assert not fence[0] < b < fence[1]


def test_hierarchy_children_lie_in_parents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert chunking.hierarchy_violations(chunking.hierarchy(docs)).count() == 0


def test_semantic_boundaries():
    assert chunking.consolidate([4, 5, 9], [8], 12, 3) == [4, 8]


def test_config_is_checked():
    for bad in ({"size": 10}, {"overlap": 300}, {"parent_size": 100}):
        with pytest.raises(ValueError):
            chunking.Config(**bad)


def test_breadcrumbs_and_records(spark):
    rows = [(1, 0, 1, "A"), (1, 1, None, None), (1, 2, 2, "B"), (1, 3, None, None), (1, 4, 1, "C"), (1, 5, None, None)]
    h = spark.createDataFrame(rows, "doc_id int, pos int, level int, title string")
    assert [r.path for r in chunking.breadcrumbs(h).orderBy("pos").collect()] == ["A", "A", "A > B", "A > B", "C", "C"]
    cells = [("s", 1, ["", ""]), ("s", 2, ["h1", "h2"]), ("s", 3, ["", "v"]), ("s", 4, [" ", None])]
    r = chunking.records_with_header(spark.createDataFrame(cells, "sheet string, row int, cells array<string>")).collect()
    assert [(x.row, x.header, x.first_column, x.last_column) for x in r] == [(3, ["h1", "h2"], 2, 2)]


# parent contexts


def test_siblings_collapse(spark):
    rows = [(1, 7, 10, 1, 0.9), (1, 7, 11, 3, 0.5), (1, None, 12, 2, 0.7)]
    hits = spark.createDataFrame(rows, "query_id int, parent_id int, id int, rank int, score double")
    out = retrieval_context.collapse_siblings(hits).orderBy("rank").collect()
    assert [(r.id, r.child_ids) for r in out] == [(10, [10, 11]), (12, [12])]


def test_edits_overlay_newest_first():
    text, spans = retrieval_context.overlay_edits("0123456789abcdefghij", 100, [(102, 108, "XX", 1), (106, 112, "YYY", 2), (116, 120, "Z", 1)])
    assert text == "012345YYYcdefZ"
    assert retrieval_context.rendered_span(spans, 106, 108) == (6, 9)
    assert retrieval_context.rendered_span(spans, 100, 103) == (0, 3)


def test_evidence_window_is_held_inside(spark):
    w = lambda n, a, b: [one(spark, c) for c in retrieval_context.evidence_window(F.lit(n), F.lit(a), F.lit(b), F.lit(a), F.lit(a + 1), 100)]
    assert w(80, 0, 10) == [0, 80] and w(1000, 500, 520) == [460, 560] and w(1000, 990, 1000) == [900, 1000] and w(1000, 0, 400) == [0, 100]


def test_fallback_reasons(spark):
    hits = spark.createDataFrame([(i, p, 0, "k", 1, s, e) for i, p, s, e in [(1, None, 0, 5), (2, 9, 0, 5), (3, 5, 0, 5), (4, 6, 0, 5), (5, 7, 0, 50), (6, 7, 0, 5)]], "id int, parent_id int, tenant_id int, kb_id string, doc_id int, start_at int, end_at int")
    parents = spark.createDataFrame([(5, "text", 0, "k", 1, 0, 10), (6, "parent_text", 1, "k", 1, 0, 10), (7, "parent_text", 0, "k", 1, 0, 10)], "parent_id int, p_type string, p_tenant_id int, p_kb_id string, p_doc_id int, p_start int, p_end int")
    out = {r.id: r.fallback for r in retrieval_context.resolve_parents(hits, parents).collect()}
    assert out == {1: None, 2: "missing_parent", 3: "invalid_parent_type", 4: "parent_scope_mismatch", 5: "invalid_source_range", 6: None}


# text and vectors


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("Über on_1 Café"))) == ["uber", "on", "1", "cafe"]
    assert one(spark, T.token_set(F.lit("A bb BB c_c"))) == ["bb", "c_c"]
    assert one(spark, T.wiki_slug(F.lit("  Hello, World!  "))) == "hello--world" and one(spark, T.wiki_slug(F.lit("!!"))) == "page"
    assert one(spark, T.wiki_links(F.lit("a [[x|y]] b [[ z ]]"))) == ["x", "z"]
    assert one(spark, T.replace_dead_links(F.lit("[[a|A]] [[b]] [[c|see c]]"), F.array(F.lit("a")))) == "[[a|A]] b see c"
    assert one(spark, T.concat_overlapping(F.lit("hello wor"), F.lit("world"))) == "hello world"
    assert one(spark, T.strip_thinking(F.lit("<think>a\nb</think> yes"))) == "yes"
    assert one(spark, T.shorten(F.lit("a  b\nc"), 10)) == "a b c" and one(spark, T.shorten(F.lit("abcdef"), 4)) == "abc…"
    assert [one(spark, T.column_name(F.lit(i))) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, T.unique_strings(F.array(F.lit("A"), F.lit(" a "), F.lit(""), F.lit("b")))) == ["A", "b"]
    assert one(spark, T.first_json_object(F.lit('so: {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'
    assert one(spark, T.valid_sha256(F.lit("AB" * 32))) == "ab" * 32 and one(spark, T.valid_sha256(F.lit("x"))) is None
    assert one(spark, T.csv_list(F.lit("a, b,,a"))) == ["a", "b"]
    assert one(spark, T.file_type(F.lit("x.PDF"))) == "pdf" and one(spark, T.file_type(F.lit("x"), F.lit("text/html"))) == "html"
    assert one(spark, T.replace_names(F.lit("ab abc"), {"ab": "1", "abc": "2"})) == "1 2"
    assert one(spark, T.intent(F.lit("Hello there"))) == "chitchat" and one(spark, T.intent(F.lit(" "))) == "empty"
    assert one(spark, T.eval_keywords(F.lit("The cat, 12 a cat。dog"))) == ["the", "cat", "dog"]
    assert one(spark, T.usage_field(F.lit('{"u":{"p":7}}'), "$.x", "$.u.p")) == 7
    assert one(spark, T.tokens_for_context(F.lit("中文字abcd"))) == 3
    assert "retention policy" in one(spark, T.expand_query(F.lit("What is the retention policy?")))


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, V.l2_distance(a, b)) == pytest.approx(5**0.5) and one(spark, V.cosine_distance(a, b)) == 1.0
    assert one(spark, V.valid(a, 2)) and not one(spark, V.valid(a, 3))
    assert not one(spark, V.valid(F.array(F.lit(0.0), F.lit(0.0)), 2)) and not one(spark, V.valid(F.array(F.lit(float("nan")), F.lit(1.0)), 2))


# graph, wiki, history


def test_relation_weights_golden(spark):
    e = graph.merge_entities(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 2)], "name string, chunk_id int"))
    raw = spark.createDataFrame([(" a", "b", "12", 1), ("a", "c", "3", 2), ("a", "a", "5", 1)], "source string, target string, strength string, chunk_id int")
    r = graph.merge_relations(graph.clean_relations(raw))
    out = {x.target: x for x in graph.relation_weights(e, r).collect()}
    assert out["b"].strength == 10 and out["b"].weight == pytest.approx(10.0)
    assert out["c"].weight == pytest.approx(1 + 9 * (0.6 + 0.4 * 0.3))
    assert {x.name: x.degree for x in graph.degrees(r).collect()} == {"a": 2, "b": 1, "c": 1}


def test_two_hops_leave_out_neighbours(spark):
    rows = [("d", 1, 2, 4.0, 1), ("d", 2, 1, 4.0, 1), ("d", 2, 3, 2.0, 5), ("d", 3, 2, 2.0, 5), ("e", 1, 9, 4.0, 1), ("e", 2, 7, 1.0, 1)]
    e = spark.createDataFrame(rows, "doc_id string, a int, b int, weight double, degree int")
    found = graph.two_hop(e, scope=("doc_id",)).collect()
    assert {(r.doc_id, r.a, r.b, r.weight, r.degree) for r in found} == {("d", 1, 3, 4.0, 5), ("d", 3, 1, 4.0, 5)}


def test_chunk_graph_agrees_with_a_plain_one(spark):
    """Edges of every pair of chunks, for names of any frequency, and the best two-hop paths."""
    draw = random.Random(4)
    mentions = sorted({(d, draw.choice("abcdefgh"), draw.randrange(30)) for d in ("x", "y") for _ in range(70)})
    relations = [(d, s, t, float(i % 4 + 1)) for i, (d, s, t) in enumerate((d, s, t) for d in ("x", "y") for s, t in ("ab", "bc", "cd", "ef", "ga"))]
    m = spark.createDataFrame(mentions, "doc_id string, name string, chunk_id int")
    r = spark.createDataFrame(relations, "doc_id string, source string, target string, weight double")
    edges, degree = {}, {}
    for d, s, t, _ in relations:
        for n in (s, t):
            degree[d, n] = degree.get((d, n), 0) + 1
    for d, s, t, w in relations:
        for a in [c for e, n, c in mentions if (e, n) == (d, s)]:
            for b in [c for e, n, c in mentions if (e, n) == (d, t)]:
                if a != b:
                    best = (w, degree[d, s] + degree[d, t])
                    for k in ((d, a, b), (d, b, a)):
                        edges[k] = max(edges.get(k, (0, 0)), best)
    found = graph.chunk_edges(r, m, ("doc_id",))
    assert {(x.doc_id, x.a, x.b): (x.weight, x.degree) for x in found.collect()} == edges
    two = {}
    for (d, a, via), (w1, d1) in edges.items():
        for (e, via2, b), (w2, d2) in edges.items():
            if d == e and via == via2 and a != b and (d, a, b) not in edges:
                two[d, a, b] = max(two.get((d, a, b), (0, 0)), (w1 * w2 * 0.5, max(d1, d2)))
    hops = graph.two_hop(found, scope=("doc_id",)).collect()
    assert {(x.doc_id, x.a, x.b): (x.weight, x.degree) for x in hops} == two and two


def test_stored_configurations_are_brought_within_bounds():
    assert chunking.persisted({}) == (chunking.Config(), True)
    got, same = chunking.persisted({"size": 10, "overlap": "500", "child_size": 9000, "parent_size": True, "max_tokens": None})
    assert not same and got == chunking.Config(size=64, overlap=32, child_size=8192, parent_size=8192)
    assert chunking.persisted({"overlap": -1, "child_overlap": 192})[0] == chunking.Config(overlap=0, child_overlap=192)


def test_embedders_and_counters_are_arguments(spark):
    import pandas as pd

    units = spark.createDataFrame([(0, i, t) for i, t in enumerate(["a a", "a a a", "b", "b b", "a"])], "segment int, pos int, text string")
    embed = lambda texts: pd.Series([[float(t.count("a")), float(t.count("b"))] for t in texts])
    out = chunking.embedded(units, embed, "letters-1")
    assert {r.model_signature for r in out.collect()} == {"letters-1"}
    cut = chunking.semantic_segments(out, 60.0, 1).orderBy("start_at").collect()
    assert [(r.start_at, r.end_at) for r in cut] == [(0, 2), (2, 4), (4, 5)]
    hard = out.withColumn("hard", F.col("pos") == 3)
    assert [(r.start_at, r.end_at) for r in chunking.semantic_segments(hard, 60.0, 3).orderBy("start_at").collect()] == [(0, 3), (3, 5)]
    words = chunking.size_stats(units.withColumn("content", F.col("text")), counter=lambda c: F.size(F.split(c, " "))).first()
    assert (words.tokens_total, words.tokens_max) == (9, 3)


def test_strings_are_found_where_they_stand(spark, monkeypatch):
    texts = ["banana and ananas", "", None, "aaaa", "über ñandú ana"]
    strings = ["ana", "a", "aa", "nas", "ñan", "zz", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([(i, s) for i, s in enumerate(strings)] + [(99, "ana"), (100, None)], "string_id int, string string")
    expected = {
        (d, i, t.find(s), t.count(s), len(t))
        for d, t in enumerate(texts) for i, s in [*enumerate(strings), (99, "ana")] if t and s and s in t
    }
    for chars in (lexical.BLOCK_CHARS, 3):
        monkeypatch.setattr(lexical, "BLOCK_CHARS", chars)
        assert {tuple(r) for r in lexical.occurrences(docs, wanted).collect()} == expected
    assert lexical.occurrences(docs, wanted.where("false")).count() == 0


def test_best_documents_are_those_of_all_scores(spark, sf, monkeypatch):
    docs = model.documents(spark, sf)
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000))  # ties
    asked = model.queries(spark, sf).unionByName(spark.createDataFrame([(900, ""), (901, "zzzz none")], "query_id long, query string"))
    scores = {}
    for r in lexical.bm25_scores(docs, asked).collect():
        scores.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
    expected = {q: [i for _, i in sorted(rows)[:7]] for q, rows in scores.items()}
    for terms, step in ((lexical.BLOCK_TERMS, lexical.DOC_BATCH), (100, 5)):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
        monkeypatch.setattr(lexical, "DOC_BATCH", step)
        found = {}
        for r in lexical.bm25_top_k(docs, asked, 7).orderBy("rank").collect():
            found.setdefault(r.query_id, []).append(r.doc_id)
        assert found == expected and len(found) == 40


def test_positions_count_on_over_parts(spark, monkeypatch):
    rows = [(g, f"{i:03d}") for i in range(200) for g in (["a"] * 3 + ["b"])[i % 4 :]]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "kind string, slug string").repartition(7)
    expected, seen = set(), {}
    for g, s in rows:
        seen[g] = seen.get(g, 0) + 1
        expected.add((g, s, seen[g]))
    for bound in (tables.BROADCAST_ROWS, 0):
        monkeypatch.setattr(tables, "BROADCAST_ROWS", bound)
        assert {(r.kind, r.slug, r.position) for r in tables.positions(df, "kind", "slug").collect()} == expected


def test_ego_and_changes(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "slug string")
    assert {(r.slug, r.hops) for r in graph.ego(links, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.src, r.change) for r in graph.link_changes(links, links.where("src <> 'a'")).collect()} == {("a", "removed")}


def test_links_are_put_in_once():
    out = wiki.inject_links("# Alpha Beta\nalpha beta and Alpha\n```\nAlpha\n```\nAlpha Beta", [("Alpha", "a"), ("Alpha Beta", "ab")])
    assert out == "# Alpha Beta\n[[ab|alpha beta]] and [[a|Alpha]]\n```\nAlpha\n```\nAlpha Beta"


def test_history_budget(spark):
    rows = [(1, r, "u" * 40, "a" * 40) for r in range(1, 6)]
    t = spark.createDataFrame(rows, "conv_id int, request int, user_text string, assistant_text string")
    n = T.tokens_for_usage(F.col("user_text")) + T.tokens_for_usage(F.col("assistant_text"))
    assert sorted(r.request for r in history.budget_tail(t, n, 45).collect()) == [4, 5]
    assert history.budget_tail(t, n, 10).count() == 0


def test_as_of_has_no_later_match(spark):
    left = spark.createDataFrame([(1, 5, 50), (1, 1, 10), (2, 9, 90)], "k int, t int, id int")
    right = spark.createDataFrame([(1, 3, 7), (1, 5, 8), (1, 6, 9)], "k int, t int, rid int")
    out = {r.id: r.match_id for r in history.as_of(left, right, "k", "t", "t", "rid").collect()}
    assert out == {50: 8, 10: None, 90: None}


def test_recovery_and_supersession(spark):
    rows = [(1, 1, "pending", 1), (2, 1, "running", 2), (3, 1, "pending", 3), (4, 2, "pending", 1), (5, 1, "completed", 0)]
    tasks = spark.createDataFrame(rows, "task_id int, knowledge_id int, status string, created_at int")
    docs = spark.createDataFrame([(1,)], "knowledge_id int")
    assert {r.task_id: r.decision for r in history.recover(tasks, docs).collect()} == {1: "superseded", 2: "keep", 3: "superseded", 4: "invalid"}
    assert {r.task_id for r in history.superseded(tasks).collect()} == {1, 3}


def test_order_of_rows_does_not_matter(spark):
    draw = random.Random(1)
    rows = [(q, str(i), i) for q in range(3) for i in range(1, 20)]
    a = fusion.per_document_cap(spark.createDataFrame(rows, "query_id int, id string, rank int").withColumn("doc_id", F.col("rank") % 4), 2)
    draw.shuffle(rows)
    b = fusion.per_document_cap(spark.createDataFrame(rows, "query_id int, id string, rank int").withColumn("doc_id", F.col("rank") % 4), 2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


# sources, sinks, tools


def test_parsers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 2)
    docx, pptx, xlsx = io.BytesIO(), io.BytesIO(), io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(pptx, "w") as z:
        for i in (2, 10):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>text {i}</a:t></a:r></a:p></p>')
    with zipfile.ZipFile(xlsx, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    md = "before ![pic](data:image/png;base64," + base64.b64encode(png).decode() + ") after ![r](http://x/y.png) ![l](local.png)"
    files = {"a.json": b'{"a":1}', "b.json": b"{broken", "c.csv": b"x,y\n1,2\n", "d.html": b"<p>t<script>no</script></p>", "e.md": md.encode(), "f.docx": docx.getvalue(), "g.pptx": pptx.getvalue(), "h.xlsx": xlsx.getvalue(), "i.png": png, "j.doc": b"old", "k.docx": b"broken", "l.mp3": b"no", "m.txt": b"  "}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    out = {}
    for r in parse.read_files(spark, str(tmp_path)).orderBy("path", "block_index").collect():
        out.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert json.loads(out["a.json"][0].text) == {"a": 1} and "\n" in out["a.json"][0].text
    assert out["b.json"][0].text == "{broken" and out["c.csv"][0].text == "x | y\n1 | 2" and out["d.html"][0].text.split() == ["t"]
    assert [b.kind for b in out["e.md"]] == ["text", "image", "text", "image", "warning", "text"]
    assert [(b.text, b.metadata) for b in out["f.docx"]] == [("Head", {"heading": "2"}), ("a | b", {"table": "1"})]
    assert [b.metadata["slide"] for b in out["g.pptx"]] == ["2", "10"]
    assert out["h.xlsx"][0].text == "name: x | 2" and out["h.xlsx"][0].metadata["source"] == "cached,literal"
    assert out["i.png"][0].metadata["width"] == "3" and out["j.doc"][0].warning and out["k.docx"][0].warning
    assert "l.mp3" not in out and "m.txt" not in out
    with pytest.raises(ValueError):
        parse.parse_bytes("x", b"", "other")
    assert parse.read_dataset(spark, str(tmp_path / "missing"), "a int").count() == 0
    assert parse.read_text(spark, str(tmp_path / "m.txt")).count() == 0


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "c", "q")], "id int, v string, part string")
    up = sinks.upsert(t, spark.createDataFrame([(2, "B", "p"), (4, "d", "q")], t.schema), ["id"])
    assert {r.id: r.v for r in up.collect()} == {1: "a", 2: "B", 3: "c", 4: "d"}
    assert sinks.delete(t, t.where("id = 1"), ["id"]).count() == 2
    assert {r.v for r in sinks.update(t, F.col("id") == 1, {"v": F.lit("z")}).collect()} == {"z", "b", "c"}
    path = str(tmp_path / "out")
    sinks.write_partitioned(t, path, ["part"])
    sinks.write_partitioned(t.where("part = 'q'").withColumn("v", F.lit("new")), path, ["part"])
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "a", 2: "b", 3: "new"}
    assert sinks.index_state("m:64", "m:64", 3) == "ready" and sinks.index_state("m:64", None, 3) == "needs_rebuild"


def test_tools(spark, sf):
    t = tools.builtin()
    t.add(tools.Tool("grep", "second", lambda *a: None))
    assert t.call("grep", spark, sf, terms="the and", limit=3).count() == 3  # the first registration wins
    assert t.call("search", spark, sf, query="idiot trash").count() > 0
    assert t.call("statistics", spark, sf, kind="documents").first().n > 100
    for bad in ({}, {"terms": 3}, {"terms": "x", "other": 1}):
        with pytest.raises(ValueError):
            t.call("grep", spark, sf, **bad)


# streaming


def test_log_numbers_events_and_ends(spark, tmp_path):
    rows = [("m", i, k, str(i)) for i, k in enumerate(["token", "token", "complete", "token"])] + [("n", 0, "error", "x")]
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    spark.createDataFrame(rows, "message_id string, sent_at int, kind string, payload string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("message_id string, sent_at int, kind string, payload string").parquet(src)
    log = jobs.run_to_memory(jobs.numbered_log(stream), "log_test", "append", ck)
    out = sorted((r.message_id, r.offset, r.kind, r.terminal) for r in log.collect())
    assert out == [("m", 0, "token", False), ("m", 1, "token", False), ("m", 2, "complete", True), ("n", 0, "error", True)]
    assert [r.offset for r in jobs.replay(log, "m", 1).collect()] == [1, 2]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_results_of_streams_stand_in_files(spark, tmp_path, mode):
    """Not in the memory of the driver; of complete results the last one counts."""
    src = str(tmp_path / "src")
    spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long").repartition(4).write.parquet(src)
    stream = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(src)
    rows = stream.groupBy("k").count() if mode == "complete" else stream
    out = jobs.run_to_memory(rows, f"files_{mode}", mode, str(tmp_path / "ck"))
    assert out.inputFiles()
    if mode == "complete":
        assert sorted(map(tuple, out.collect())) == [(0, 10), (1, 10), (2, 10)]
    else:
        assert sorted(r.id for r in out.collect()) == list(range(30))


def test_first_sight_and_queue(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("r", "i", "body"), ("r", "i", "body"), ("r", "j", "b")], "run_id string, item_id string, body string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("run_id string, item_id string, body string").parquet(src)
    seen = jobs.run_to_memory(jobs.seen_before(stream), "seen_test", "append", str(tmp_path / "ck"))
    assert sorted((r.item_id, r.first, r.body) for r in seen.collect()) == [("i", False, None), ("i", True, "body"), ("j", True, "b")]
    ops, got = str(tmp_path / "ops"), []
    spark.createDataFrame([("k", 1, "a", 1), ("k", 2, "b", 2), ("l", 3, "c", 1)], "dedup_key string, op_id int, op string, created_at int").coalesce(1).write.parquet(ops)
    queue = spark.readStream.schema("dedup_key string, op_id int, op string, created_at int").parquet(ops)
    jobs.drain(queue, lambda df, n: got.append(sorted((r.dedup_key, r.op) for r in df.collect())), str(tmp_path / "ck2")).awaitTermination()
    assert got == [[("k", "b"), ("l", "c")]]


def test_plans(spark, sf):
    """Scans read what a query needs, and top-k is cut before the shuffle."""
    docs = model.documents(spark, sf).where("lang = 'en'").select("doc_id")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "text" not in plan
    from corpusq import registry

    plan = registry.queries()["bm25_topk"](spark, sf)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
