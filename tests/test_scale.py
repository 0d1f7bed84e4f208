"""Steps whose work or memory must not outgrow their input."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusq import registry
from corpusq.operators import chunking, graph, lexical, retrieval_context, vector, wiki
from corpusq.plans import chat


def test_usage_insert_large_ids(spark, sf, tmp_path):
    """The length of an error does not follow the event's id: ids of billions are written as others are."""
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_type <> 'error'").limit(3)
    events.withColumn("event_id", F.col("event_id") + 3_000_000_000).write.parquet(str(tmp_path / "events.parquet"))
    rows = registry.queries()["usage_insert"](spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {r.error for r in rows} == {"e" * 500}


class Step:
    """Stands for a table: keeps the function that a task would run over its batches."""

    def __init__(self, schema):
        self.schema = StructType.fromDDL(schema)

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, _):
        return run


def test_chunks_leave_in_bounded_batches():
    """A large batch of documents leaves as many small ones, with the same chunks."""
    texts = [f"Line {i} of a text.\n" * 400 for i in range(600)] + [None, ""]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    out = list(chunking.fixed_chunks(Step("doc_id long, text string"))(iter([batch])))
    assert max(sum(map(len, b.column(4).to_pylist())) for b in out) <= 1.3 * chunking.BATCH_CHARS
    rows = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))]
    assert rows == [(i, k, a, b, t[a:b].strip()) for i, t in enumerate(texts) if t for k, (a, b) in enumerate(chunking.fixed_windows(t))]


def test_wide_chunks_leave_in_bounded_batches(spark):
    """A document of many short chunks leaves as many batches, and one may go on over batches that come in."""
    short = [f"Part {i}. " * (1 + i % 40) for i in range(9000)]
    rows = [(1, i, t) for i, t in enumerate(short)] + [(2, 0, "alone"), (3, 0, "a" * 400), (3, 1, "a" * 9), (3, 2, "b"), (None, 0, "x"), (None, 1, "y")]
    batches = [pa.record_batch(dict(zip(("doc_id", "chunk_index", "content"), map(list, zip(*rows[k : k + 4000]))))) for k in range(0, len(rows), 4000)]
    out = list(retrieval_context.expand_short(Step("doc_id long, chunk_index int, content string"))(iter(batches)))
    assert max(sum(map(len, b.column(2).to_pylist())) for b in out) <= retrieval_context.BATCH_CHARS + 2000 and len(out) > 5
    found = {(d, i): x for b in out for d, i, x in zip(*(c.to_pylist() for c in b.columns))}
    assert len(found) == len(rows) and found[1, 39] == short[39]
    n = next(n for n in range(9000) if sum(map(len, short[:n])) >= 850)
    assert found[1, 0] == "\n".join(short[:n]) and n > 5
    assert (found[2, 0], found[3, 0], found[3, 1], found[3, 2]) == ("alone", "a" * 400, "\n".join(["a" * 400, "a" * 9, "b"]), "\n".join(["a" * 400, "a" * 9, "b"]))
    assert (found[None, 0], found[None, 1]) == ("x\ny", "x\ny")


def test_graph_of_many_blocks(spark):
    """A document of several blocks of chunks has the edges and paths of a plain graph, and shuffles no pairs or paths."""
    draw = random.Random(7)
    mentions = sorted({(1, draw.choice("abcdef"), draw.randrange(0, 700, 7)) for _ in range(90)})
    relations = [(1, s, t, w) for s, t, w in (("a", "b", 1.1), ("b", "c", 2.3), ("d", "e", 3.7), ("e", "f", 1.1), ("c", "d", 5.0))]
    m = spark.createDataFrame(mentions, "doc_id long, name string, chunk_id int")
    r = spark.createDataFrame(relations, "doc_id long, source string, target string, weight double")
    degree = {n: sum(n in x[1:3] for x in relations) for n in "abcdef"}
    edges, two = {}, {}
    for _, s, t, w in relations:
        for a in [c for _, n, c in mentions if n == s]:
            for b in [c for _, n, c in mentions if n == t and c != a]:
                for k in ((a, b), (b, a)):
                    edges[k] = max(edges.get(k, (0, 0)), (w, degree[s] + degree[t]))
    for (a, v), (w1, d1) in edges.items():
        for (x, b), (w2, d2) in edges.items():
            if x == v and a != b and (a, b) not in edges:
                two[a, b] = max(two.get((a, b), (0, 0)), (round(w1 * w2 * 0.5, 9), max(d1, d2)))
    every = graph.chunk_edges(r, m, ("doc_id",))
    assert {(x.a, x.b): (x.weight, x.degree) for x in every.collect()} == edges
    hops = graph.two_hop(every, scope=("doc_id",))
    assert {(x.a, x.b): (x.weight, x.degree) for x in hops.collect()} == two and two
    few = graph.top_neighbours(graph.chunk_edges(r, m, ("doc_id",), 3), 3, ("doc_id",)).collect()
    best = lambda found: {k for a in {a for a, _ in found} for k in sorted((k for k in found if k[0] == a), key=lambda k: (-found[k][0], -found[k][1], k[1]))[:3]}
    assert {(x.a, x.b) for x in few} == best(edges)
    few = graph.top_neighbours(graph.two_hop(every, scope=("doc_id",), most=3), 3, ("doc_id",)).collect()
    assert {(x.a, x.b) for x in few} == best(two)


PIECES = ["Anna", "anna", "ANNA Bell", "Bell", "[[", "]]", "|", " ", "_", "é", "É", "\u017f", "k", "\u212a", "x1", ".", "\u2014"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.lists(st.sampled_from(PIECES[:4] + PIECES[9:15]), min_size=1, max_size=3).map("".join))
def test_first_mention_agrees_with_one_pattern(line, name):
    pattern = re.compile(r"(\[\[[^\]]*\]\])|(?<![\w])(" + re.escape(name) + r")(?![\w])", re.IGNORECASE)
    assert wiki._first_mention(line, line.lower(), name) == next((m.start() for m in pattern.finditer(line) if m[2]), -1)


def test_links_of_many_names_need_no_patterns(monkeypatch):
    """No pattern is compiled for a name of plain letters."""
    names = [(f"Name{k}", f"entity/name{k}") for k in range(60)]
    monkeypatch.setattr(wiki.re, "compile", lambda *_: pytest.fail("compiled"))
    out = wiki.inject_links(" ".join(n for n, _ in names), names)
    assert out == " ".join(f"[[{s}|{n}]]" for n, s in names)


def test_graph_search_meets_no_more_of_a_larger_graph(spark, monkeypatch):
    """What meets the queries is as much with a hub of 40 chunks as with one of 400; a mention given twice counts once."""
    frame, sizes = spark.createDataFrame, []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: sizes[-1].setdefault(name, real(df, name)) if name == "visited-chunks" else real(df, name))
    for n in (40, 400):
        sizes.append({})
        mentions = [("s", "Hub", i) for i in range(n)] * 2 + [("s", f"N{i}", i) for i in range(n)]
        out = graph.search(
            frame([(q, "hub") for q in range(5)], "query_id int, term string"),
            frame([("s", "Hub", n)] + [("s", f"N{i}", 1) for i in range(n)], "kb_id string, name string, frequency long"),
            frame([("s", "Hub", f"N{i}") for i in range(n)] + [("s", "N0", "Hub")], "kb_id string, source string, target string"),
            frame(mentions, "kb_id string, name string, id int"), frame([(0, 0), (0, 2), (1, 1)], "query_id int, id int"), 3, most=20,
        )
        found = {q: [r.id for r in sorted(out.where(f"query_id = {q}").collect(), key=lambda r: r.position)] for q in range(3)}
        assert found == {0: [1, 3, 4], 1: [0, 2, 3], 2: [0, 1, 2]}
    rows = [s["visited-chunks"].count() for s in sizes]
    assert rows[0] == rows[1] <= 2 * (3 + 2) + 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abAé1", min_size=2, max_size=3), min_size=1, max_size=4, unique=True), st.text("abAé1 -\n", max_size=40))
def test_words_hold_what_their_text_holds(terms, text):
    """Terms are found word by word as in the whole text."""
    runs, held = lexical._word_terms(terms)
    found = dict.fromkeys(range(len(terms)), 0)
    for word in runs.findall(text):
        for k, n in zip(*held(word)):
            found[k] += n
    assert found == {k: text.count(x) * len(x) for k, x in enumerate(terms)}


@pytest.mark.parametrize("block,known", [(500_000, 1_000_000), (4, 1)])
def test_substring_scores_as_a_plain_version(spark, monkeypatch, block, known):
    """A word that comes again is not searched again; blocks, ids that repeat and nulls change nothing."""
    monkeypatch.setattr(lexical, "BLOCK_CHARS", block)
    monkeypatch.setattr(lexical, "KNOWN", known)
    texts = [(1, "banana Ananas x" * 3), (2, None), (3, ""), (4, "none" + "a" * 90), (1, "an an"), (None, "bana"), (5, "xyz")]
    asked = [(7, "ana AN a"), (8, "nan, an"), (9, ""), (10, None)]
    expected: dict = {}
    for q, words in ((7, ("ana", "an")), (8, ("nan", "an"))):
        for i, text in texts:
            n = sum((text or "").lower().count(w) * len(w) for w in words)
            if n:
                expected[q, i] = expected.get((q, i), 0) + n
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = lexical.substring_scores(docs, spark.createDataFrame(asked, "query_id long, query string")).collect()
    assert {(r.query_id, r.doc_id): r.score for r in out} == expected and len(out) == len(expected)


class Sent(Step):
    """A step whose broadcasts stay where they are."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))


def _most_mb(run, batch):
    """What a task's function makes of a batch, and the MB that it holds at most."""
    tracemalloc.start()
    try:
        rows = [r for b in run(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_neighbours_of_many_queries_in_bounded_tables(spark):
    """A whole block of queries is compared with as many vectors at once as a table of fixed size has room for."""
    draw = np.random.default_rng(3)
    own, others = draw.integers(0, 9, (vector.QUERY_BLOCK, 4)).astype(float), draw.integers(0, 9, (2_500, 4)).astype(float)
    batch = pa.record_batch({"vec_id": range(len(others)), "embedding": others.tolist()})
    rows, mb = _most_mb(vector._block_top_k(Sent("vec_id long, embedding array<double>"), np.arange(len(own)), own, 3, False), batch)
    assert mb < 150
    for q in (0, 77, 4_095):
        distances = np.sqrt(np.square(others - own[q]).sum(1))
        assert [v for x, v, _ in rows if x == q] == np.lexsort((np.arange(len(others)), distances))[:3].tolist()


def test_scores_of_many_terms_in_bounded_tables(spark):
    """Documents are scored as many at once as a table of fixed size has room for."""
    block = [(t // 30, t, 1.0 + t % 7) for t in range(15_000)]
    held = [[t for t in (d, d, d + 31, 14_000)] for d in range(1_500)]
    batch = pa.record_batch({"doc_id": range(1_500), "dl": [4] * 1_500, "held": held})
    rows, mb = _most_mb(lexical._best_of_block(Sent("doc_id long, dl long, held array<long>"), block, 4.0, 2, "doc_id"), batch)
    assert mb < 130
    part = {n: n * (lexical.K1 + 1) / (n + lexical.K1) for n in (1, 2)}
    for q in (0, 1, 40):
        scores = {}
        for d, terms in enumerate(held):
            scores[d] = sum(part[terms.count(t)] * (1.0 + t % 7) for t in set(terms) if t // 30 == q)
        best = sorted((d for d in scores if scores[d] > 0), key=lambda d: (-round(scores[d], 9), d))[:2]
        assert sorted(d for x, d, _ in rows if x == q) == sorted(best)


def test_queries_of_one_word_in_bounded_blocks(spark, monkeypatch):
    """Many queries of few words are dealt to blocks by the size of their table, not by their words alone."""
    n, cells, inner = 3_000, [], lexical._best_of_block

    def block_of(held, block, *rest):
        cells.append(len({r[0] for r in block}) * len({r[1] for r in block}))
        return inner(held, block, *rest)

    monkeypatch.setattr(lexical, "_best_of_block", block_of)
    asked = spark.createDataFrame([(i, f"word{i}") for i in range(n)], "query_id long, query string")
    docs = spark.createDataFrame([(d, "", " ".join(f"word{i}" for i in range(d, n, 10))) for d in range(10)], "doc_id long, title string, text string")
    found = {r.query_id: r.doc_id for r in lexical.bm25_top_k(docs, asked, 2).collect()}
    assert max(cells) <= 4_000_000 and found == {i: i % 10 for i in range(n)}


def test_chat_cuts_few_texts_at_once(spark, sf, monkeypatch):
    """Texts reach the chunker a thousand at a time, and the setting goes back afterwards."""
    name, seen, inner = "spark.sql.execution.arrow.maxRecordsPerBatch", [], chat.written
    before = spark.conf.get(name)

    def put(df, table):
        seen.append(spark.conf.get(name))
        return inner(df, table)

    monkeypatch.setattr(chat, "written", put)
    chat.chat_chunks(spark, sf)
    assert seen == [chat.TEXTS] and int(chat.TEXTS) < int(before) and spark.conf.get(name) == before
