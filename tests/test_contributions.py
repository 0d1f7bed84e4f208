"""The contribution state: deltas against a plain dictionary and a rebuild from scratch."""

import random

from pyspark.sql import functions as F

from corpusq.operators import contributions as C

SCHEMA = (
    "slug string, doc_id int, seq long, action string, title string, page_type string, summary string, aliases array<string>, "
    "doc_title string, description string, details string, chunks array<int>"
)


def _batches(seed, n=4, docs=12):
    draw, out, seq = random.Random(seed), [], 0
    for _ in range(n):
        rows = []
        for _ in range(draw.randrange(10, 40)):
            seq += 1
            slug, doc = f"s{draw.randrange(6)}", draw.randrange(docs)
            if draw.random() < 0.4:
                rows.append((slug, doc, seq, "retract", *[None] * 8))
            else:
                chunks = [draw.randrange(30) for _ in range(draw.randrange(3))]
                rows.append((slug, doc, seq, "upsert", draw.choice(["", f"T{seq}"]), "entity", None, [f"a{draw.randrange(5)}"], f"d{doc}", "x", f"v{draw.randrange(2)}", chunks))
        out.append(rows)
    return out


class Plain:
    """The same rules, one delta after another."""

    def __init__(self):
        self.docs, self.pages = {}, {}

    def apply(self, rows):
        for slug in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == slug), key=lambda r: r[2])
            adds = [r for r in own if r[3] == "upsert"]
            page, docs = self.pages.get(slug), self.docs.setdefault(slug, {})
            if page is None and not adds:
                continue
            before = dict(docs)
            for r in own:
                if r[3] == "retract":
                    docs.pop(r[1], None)
            for r in adds:
                docs[r[1]] = r[8:]
            if not docs:
                self.pages.pop(slug, None)
                continue
            old = page or {"title": None, "aliases": set(), "version": 0}
            title = (adds[0][4] or old["title"]) if adds else old["title"]
            aliases = old["aliases"] | {a for r in adds for a in r[7]}
            same = page is not None and docs == before and title == old["title"] and aliases == old["aliases"]
            self.pages[slug] = {"title": title, "aliases": aliases, "version": old["version"] + (not same)}

    def figures(self):
        return {
            s: (p["title"], sorted(p["aliases"]), p["version"], len(self.docs[s]), len({c for d in self.docs[s].values() for c in d[3]})) for s, p in self.pages.items()
        }

    def refs(self):
        return {s: list(d) for s, d in self.docs.items() if d}


def _figures(state):
    return {r.slug: (r.title, r.aliases, r.version, r.n_docs, r.n_chunks) for r in C.figures(state).collect()}


def _refs(rows, column):
    out = {}
    for r in sorted(rows, key=lambda r: (r.slug, r.position)):
        out.setdefault(r.slug, []).append(r[column])
    return out


def test_deltas_are_those_of_a_plain_state_and_of_a_rebuild(spark):
    state, plain = None, Plain()
    gone = raised = 0
    for k, rows in enumerate(_batches(3), 1):
        df = spark.createDataFrame(rows, SCHEMA)
        had = set(plain.pages)
        state = C.apply(C.empty(df) if state is None else state, df, k)
        plain.apply(rows)
        gone += len(had - set(plain.pages))
        raised += sum(p["version"] > 1 for p in plain.pages.values())
        assert _figures(state) == plain.figures()
        assert _refs(C.source_refs(state).collect(), "doc_id") == plain.refs()
    assert raised
    chunks = {s: list(dict.fromkeys(c for d in docs.values() for c in d[3])) for s, docs in plain.docs.items()}
    assert _refs(C.chunk_refs(state).collect(), "chunk") == {s: c for s, c in chunks.items() if c}
    # what is left, given at once to an empty state, gives the same contributions
    left = [(s, d, n, "upsert", "T", "entity", None, [], *row) for s, docs in plain.docs.items() for n, (d, row) in enumerate(docs.items())]
    scratch = spark.createDataFrame(left, SCHEMA)
    rebuilt = C.apply(C.empty(scratch), scratch)
    columns = [*C.KEY, *C.PAYLOAD]
    assert sorted(map(str, rebuilt.contributions.select(columns).collect())) == sorted(map(str, state.contributions.select(columns).collect()))
    assert {k: v[3:] for k, v in _figures(rebuilt).items()} == {k: v[3:] for k, v in _figures(state).items()}


def test_versions_rise_only_where_something_changed(spark):
    row = ("s", 1, 1, "upsert", "T", "entity", "", ["a"], "d", "x", "v", [1])
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    state = C.apply(C.empty(df(row)), df(row, ("t", 1, 2, *row[3:])), 1)
    same = C.apply(state, df(("s", 1, 9, *row[3:]), ("t", 5, 3, "retract", *[None] * 8)), 2)
    assert {s: f[2] for s, f in _figures(same).items()} == {"s": 1, "t": 1}
    other = C.apply(same, df(("s", 1, 10, *row[3:10], "w", [1])), 3)
    assert {s: f[2] for s, f in _figures(other).items()} == {"s": 2, "t": 1}
    dropped = C.apply(other, df(("t", 1, 11, "retract", *[None] * 8), ("u", 1, 12, "retract", *[None] * 8), (None, 1, 1, *row[3:]), ("s", None, 1, *row[3:]), ("s", 4, 1, "keep", *row[4:])), 4)
    assert set(_figures(dropped)) == {"s"}
    closed = C.State(dropped.contributions, dropped.pages.withColumn("deleted", F.lit(True)))
    assert _figures(C.apply(closed, df(("s", 7, 20, *row[3:])), 5)) == {}
    assert C.apply(C.empty(df(row)), df(row).limit(0)).pages.count() == 0
