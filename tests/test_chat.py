"""The chat pipeline and the graph search against plain versions."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusq.functions.text import expand_query
from corpusq.operators import graph, search

CHUNKS = "id long, doc_id long, chunk_index int, parent_id long, start_at int, end_at int, content string"


def _tokens(text):
    return set(re.findall(r"[^\W_]+", text.lower()))


def _redundant(a, b):
    short, long = sorted((a, b), key=len)
    x, y = _tokens(a), _tokens(b)
    return (len(short) >= 80 and short in long) or bool(x and y and len(x & y) / min(len(x), len(y)) >= 0.85)


def _jaccard(a, b):
    a, b = _tokens(a), _tokens(b)
    return len(a & b) / len(a | b) if a and b else 0.0


class World:
    """Random documents of flat chunks (even ids) and of families of three (odd ids), lists and graphs."""

    def __init__(self, seed, n_docs=14, n_queries=6):
        r = self.r = random.Random(seed)
        self.words = [f"w{i}" for i in range(60)]
        self.texts, self.chunks = {}, {}
        for doc in range(n_docs):
            text = ""
            for i in range(r.randint(1, 7)):
                n = r.choice((8, 30, 120))
                piece = " ".join(r.choices(self.words, k=n))
                if r.random() < 0.2 and self.chunks:
                    piece = r.choice(list(self.chunks.values()))[6]
                key = doc * 100 + i
                self.chunks[key] = (key, doc, i, doc * 100 + i // 3 if doc % 2 else None, len(text), len(text) + len(piece), piece)
                text += piece + "\n"
            self.texts[doc] = text
        ids = list(self.chunks)
        self.queries = {q: "what is " + ", ".join(r.choices(self.words, k=4)) + "?" for q in range(n_queries)}
        pick = lambda n: r.sample(ids + [999999], min(n, len(ids)))
        self.keyword = {q: pick(r.choice((0, 2, 12))) for q in self.queries}
        self.vector = {q: pick(r.choice((0, 3, 12))) for q in self.queries}
        self.variant = {(q, v): pick(6) for q in self.queries for v in range(5)}
        self.graph = {q: pick(8) for q in self.queries}
        same = [(a, b) for a in ids for b in ids if a != b and a // 100 == b // 100]
        self.direct = r.sample(same, len(same) // 3)
        self.indirect = [e for e in r.sample(same, len(same) // 3) if e not in self.direct]


def _ranked(edges):
    out, n = [], defaultdict(int)
    for a, b in edges:
        n[a] += 1
        out.append((a, b, n[a]))
    return out


def _plain(w, k, variants):
    out = {}
    for q, text in w.queries.items():
        wanted = _tokens(text)
        ranks = [{c: i for i, c in enumerate(x[q], 1)} for x in (w.keyword, w.vector)]
        score = {c: sum(1 / (60 + x[c]) for x in ranks if c in x) for c in {*ranks[0], *ranks[1]}}
        best = lambda c: min(x[c] for x in ranks if c in x)
        hits = [c for c in sorted(score, key=lambda c: (-score[c], best(c), c)) if c in w.chunks][: 2 * k]
        parent = lambda c: ("p", w.chunks[c][3]) if w.chunks[c][3] is not None else ("c", c)
        for v in range(variants[q]):
            if len({parent(c) for c in hits}) >= k:
                break
            hits += [c for c in w.variant[q, v][: 2 * k] if c not in hits and c in w.chunks]
        share = {c: round(len(_tokens(w.chunks[c][6]) & wanted) / len(wanted), 6) for c in hits}
        ranked = sorted(hits, key=lambda c: (-share[c], hits.index(c)))
        added = [c for c in w.graph[q] if c not in hits and c in w.chunks][:k]
        everything, beside = [*ranked, *added], []
        for edges in (w.direct, w.indirect):
            table = _ranked(edges)
            for a in everything:
                beside += [b for x, b, _ in sorted(table, key=lambda e: e[2]) if x == a and b not in everything and b not in beside]
        seconds = added + beside[: min(3, k)]

        def widened(c):
            _, doc, i, family, _, _, own = w.chunks[c]
            if family is not None or len(own) >= 350:
                return own
            flat = [x[6] for x in sorted(w.chunks.values()) if x[1] == doc]
            front, back, size = [], [], len(own)
            for j in [*range(i - 1, -1, -1), *range(i + 1, len(flat))]:
                if size < 850 and flat[j] not in own:
                    (front if j < i else back).append(flat[j])
                    size += len(flat[j])
            return "\n".join([*front[::-1], own, *back])

        def contexts(order, shown):
            groups = {}
            for c in order:
                groups.setdefault(parent(c), []).append(c)
            kept = []
            for key, children in groups.items():
                body = shown(children[0])
                if key[0] == "p":
                    family = [x for x in w.chunks.values() if x[3] == key[1]]
                    body = w.texts[family[0][1]][min(x[4] for x in family) : max(x[5] for x in family)].strip()
                if not any(_redundant(body, x[2]) for x in kept):
                    kept.append((children[0], children, body))
            return kept

        documents, graphs = contexts(ranked, widened), contexts(seconds, lambda c: w.chunks[c][6])
        merged, rest = defaultdict(list), []
        for g in graphs:
            home = next((d for d in documents if _redundant(g[2], d[2])), None)
            merged[home[0]].append(g[0]) if home else rest.append(g)
        if len(documents) > 2 * k:
            low, high = (f(share[d[0]] for d in documents) for f in (min, max))
            scaled = [(share[d[0]] - low) / (high - low) if high > low else 1.0 for d in documents]
            chosen = []
            while len(chosen) < 2 * k:
                near = lambda i: max((_jaccard(documents[i][2], documents[j][2]) for j in chosen), default=0.0)
                chosen.append(max((i for i in range(len(documents)) if i not in chosen), key=lambda i: (0.7 * scaled[i] - 0.3 * near(i), -i)))
            documents = [documents[i] for i in sorted(chosen)]

        def capped(rows):
            n, kept = defaultdict(int), []
            for row in rows:
                n[w.chunks[row[0]][1]] += 1
                kept += [row] if n[w.chunks[row[0]][1]] <= max(2, k) else []
            return kept

        documents, rest, turns = capped(documents), capped(rest), []
        for i in range(max(len(documents), len(rest))):
            turns += [("document", *documents[i], merged[documents[i][0]])] if i < len(documents) else []
            turns += [("graph", *rest[i], [])] if i < len(rest) else []
        out[q] = turns[:k]
    return out


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 5)])
def test_chat_as_a_plain_version(spark, seed, k):
    w, calls = World(seed), []
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    ranked = lambda lists: [(q, c, i) for q, x in lists.items() for i, c in enumerate(x, 1)]
    asked = frame(list(w.queries.items()), "query_id long, query string")
    variants = {r.query_id: r.n for r in asked.select("query_id", F.size(expand_query(F.col("query"))).alias("n")).collect()}

    def recall(keyed, most):
        rows = keyed.select("query_id.query_id", "query_id.variant").collect()
        calls.extend({r.query_id for r in rows})
        found = frame([(r.query_id, r.variant, c, i) for r in rows for i, c in enumerate(w.variant[r.query_id, r.variant][:most], 1)], "q long, v int, id long, rank int")
        return found.select(F.struct(F.col("q").alias("query_id"), F.col("v").alias("variant")).alias("query_id"), "id", "rank")

    def graphs(seen, most):
        known = defaultdict(set)
        for r in seen.collect():
            known[r.query_id].add(r.id)
        rows = [(q, c, i) for q, x in w.graph.items() for i, c in enumerate([c for c in x if c not in known[q] and c in w.chunks][:most], 1)]
        return frame(rows, "query_id long, id long, position int")

    edges = lambda near, hits: tuple(frame(_ranked(e), "a long, b long, rank int") for e in (w.direct, w.indirect))
    out = search.chat(
        asked, frame(ranked(w.keyword), "query_id long, id long, rank int"), frame(ranked(w.vector), "query_id long, id long, rank int"),
        frame(list(w.chunks.values()), CHUNKS), frame(list(w.texts.items()), "doc_id long, text string"), recall, graphs, edges, k,
    )
    found = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.position)):
        assert r.position == len(found[r.query_id]) + 1
        found[r.query_id].append((r.cohort, r.id, r.child_ids, r.text, r.merged or []))
    expected = _plain(w, k, variants)
    for q in w.queries:
        assert found[q] == [(c, i, children, body, m) for c, i, children, body, m in expected[q]]
    assert 0 < len(set(calls)) < len(w.queries)  # only queries with too few parents ask for variants
    assert any(x[0] == "graph" for rows in found.values() for x in rows)


def test_chat_without_hits_or_chunks(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    hits = "query_id long, id long, rank int"
    none = lambda *_: frame([], "query_id struct<query_id:long,variant:int>, id long, rank int")
    edges = lambda near, hits: (frame([], "a long, b long, rank int"),) * 2
    for queries in ([], [(1, "alpha beta"), (2, ""), (3, None)]):
        out = search.chat(
            frame(queries, "query_id long, query string"), frame([], hits), frame([(2, 5, 1)] if queries else [], hits),
            frame([(5, 1, 0, None, 0, 3, "abc")], CHUNKS), frame([(1, "abc")], "doc_id long, text string"),
            none, lambda *_: frame([], "query_id long, id long, position int"), edges, 3,
        )
        assert [(r.query_id, r.id, r.text, r.score) for r in out.collect()] == ([(2, 5, "abc", 0.0)] if queries else [])


@pytest.mark.parametrize("seed,k,most", [(1, 4, 200), (2, 3, 5), (3, 50, 7)])
def test_graph_search_as_a_plain_version(spark, seed, k, most):
    r = random.Random(seed)
    names = [f"{r.choice('ABC')}{r.choice('xyz')}{i}" for i in range(30)] + ["Hub"]
    relations = {(r.choice("st"), *sorted(r.sample(names, 2))) for _ in range(60)} | {("s", "Hub", n) for n in names if n > "Hub"}
    mentions = {(r.choice("st"), r.choice(names), r.randint(0, 80)) for _ in range(400)} | {("s", "Hub", i) for i in range(0, 80, 2)}
    frequency = defaultdict(int)
    for scope, name, _ in mentions:
        frequency[scope, name] += 1
    terms = {(q, r.choice(["hub", "A", "bx", "Cy1", "nothing"])) for q in range(6) for _ in range(2)}
    seen = {(q, r.randint(0, 80)) for q in range(6) for _ in range(10)}
    expected = set()
    for q in range(6):
        wanted, found = [t.lower() for x, t in terms if x == q], []
        for scope in "st":
            both = {e for s, a, b in relations if s == scope for e in ((a, b), (b, a))}
            rows = sorted((-frequency[scope, a], a, b) for a, b in both if frequency[scope, a] and any(t in a.lower() for t in wanted))[:most]
            for name in dict.fromkeys(n for _, a, b in rows for n in (a, b)):
                found += [i for s, n, i in sorted(mentions, key=lambda m: m[2]) if (s, n) == (scope, name) and (q, i) not in seen and i not in found]
        expected |= {(q, i, p) for p, i in enumerate(found[:k], 1)}
    frame = lambda rows, schema: spark.createDataFrame([*rows], schema)
    out = graph.search(
        frame(terms | {(0, None)}, "query_id int, term string"),
        frame({(s, n, f) for (s, n), f in frequency.items()} | {(None, "Hub", 9)}, "kb_id string, name string, frequency long"),
        frame(relations | {(None, "Hub", "x")}, "kb_id string, source string, target string"),
        frame(mentions | {(None, "Hub", 99)}, "kb_id string, name string, id int"), frame(seen, "query_id int, id int"), k, most=most,
    )
    assert {(x.query_id, x.id, x.position) for x in out.collect()} == expected and expected
