"""Block sources and the chunking plan against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusq.operators import blocks as B
from corpusq.operators.chunking import Config
from corpusq.plans.blocks import word_vectors

SCHEMA = "doc_id int, block_index int, kind string, text string, page int, slide int, sheet string, headers array<string>, level int, title string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def _row(doc, i, kind, text, page=None, slide=None, sheet=None, headers=None, level=None, title=None):
    return (doc, i, kind, text, page, slide, sheet, headers, level, title)


def _source(rows):
    return "\n\n".join(r[3] for r in sorted(rows, key=lambda r: r[1]) if r[2] != "image" and r[3])


def _random_blocks(seed, docs=12):
    draw, rows = random.Random(seed), []
    words = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    for doc in range(docs):
        shape = doc % 4
        for i in range(draw.randrange(1, 25)):
            if draw.random() < 0.12:
                rows.append(_row(doc, i, "image", None))
            elif shape == 0:
                head = "#" * draw.randrange(1, 5) + " " + words(2) if draw.random() < 0.4 else ""
                rows.append(_row(doc, i, "paragraph", "\n".join(filter(None, [draw.choice(["", words(3)]), head, words(draw.randrange(1, 9))])), title="Doc"))
            elif shape == 1:
                rows.append(_row(doc, i, "record", words(4), sheet=f"S{i // 5}", headers=["a", " ", "b"][: 1 + i % 3]))
            elif shape == 2:
                rows.append(_row(doc, i, "paragraph", words(6), page=1 + i // 4 if i % 7 else None, slide=2 if i == 6 else None))
            else:
                rows.append(_row(doc, i, "text", words(draw.randrange(1, 12))))
    return [r for r in rows if any(x[0] == r[0] and x[3] for x in rows)]


def _plain_units(rows):
    """(start, end, kind, context parts, hard, block, block_start) of a document by a plain walk."""
    units, at, stack, media, first = [], 0, [], False, True
    for r in sorted(rows, key=lambda r: r[1]):
        if r[2] == "image" or not r[3]:
            media = media or r[2] == "image"
            continue
        at += 0 if first else 2
        lines, pieces, held = r[3].split("\n"), [], ""
        heads = [line.startswith("#") for line in lines]
        for k, line in enumerate(lines):
            if heads[k]:
                pieces += [(held, False)] * bool(held) + [(line, True)]
                held = "\n" if k + 1 < len(lines) else ""
            else:
                held += line + ("\n" if k + 1 < len(lines) else "")
        pieces += [(held, False)] * bool(held)
        local = 0
        for k, (text, head) in enumerate(pieces):
            if head:
                level = len(text) - len(text.lstrip("#"))
                stack = stack[: level - 1] + [text.lstrip("#").strip()]
            kind = "heading" if head else "paragraph" if any(heads) else r[2]
            place = f"Slide {r[5]}" if r[5] is not None else f"Page {r[4]}" if r[4] is not None else ""
            names = " | ".join(h.strip() for h in r[7] or [] if h.strip())
            units.append((at + local, at + local + len(text), kind, (" > ".join(stack), place, r[6] or "Records", names), media and k == 0, r[1], local, r[9] or ""))
            local += len(text)
        at, media, first = at + len(r[3]), False, False
    return units


def _plain_strategy(units, rows):
    if any(u[2] == "heading" for u in units):
        return "heading"
    if any(u[2] == "record" for u in units):
        return "record"
    if any(u[2] in ("paragraph", "text_box") for u in units) or any(r[4] is not None or r[5] is not None for r in rows if r[3]):
        return "layout"
    return "recursive"


def _join(*parts):
    return " > ".join(p for p in parts if p)


def _plain_packed(units, strategy, size, boundaries=()):
    """Spans with headers for units that are no larger than ``size``."""
    out, held, last = [], None, None
    for k, u in enumerate(units):
        title, (trail, place, sheet, names) = u[7], u[3]
        key = {"heading": u[2] == "heading", "layout": place, "record": (sheet, names)}.get(strategy)
        header = {"heading": _join(title, trail), "layout": _join(title, place), "record": _join(title, sheet, names)}.get(strategy, title)
        fresh = u[4] or (key if strategy == "heading" else key != last) or k in boundaries
        if held and not fresh and u[1] - held[0] <= size:
            held = (held[0], u[1], held[2])
        else:
            out += [held] if held else []
            held = (u[0], u[1], header)
        last = key
    return out + ([held] if held else [])


def _by_doc(rows):
    docs = {}
    for r in rows:
        docs.setdefault(r[0], []).append(r)
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_units_and_structural_chunks_are_those_of_a_plain_walk(spark, seed):
    rows = _random_blocks(seed)
    docs = _by_doc(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    units = {}
    for u in B.atomic_units(df).orderBy("doc_id", "unit").collect():
        units.setdefault(u.doc_id, []).append((u.start_at, u.end_at, u.kind, u.hard, u.block_index, u.block_start))
    plain = {d: _plain_units(r) for d, r in docs.items()}
    assert units == {d: [(*u[:3], *u[4:7]) for u in us] for d, us in plain.items() if us}
    texts = {r.doc_id: r.text for r in B.sources(df).collect()}
    assert texts == {d: _source(r) for d, r in docs.items() if _source(r)}

    size = 120
    chunks = {}
    for c in B.chunk_plan(df, Config(size=size, overlap=0)).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(c.doc_id, []).append(c)
    assert set(chunks) == set(texts)
    structural = 0
    for d, found in chunks.items():
        expected = _plain_strategy(plain[d], docs[d])
        packed = _plain_packed(plain[d], expected, size)
        inside = [texts[d][a:b].strip() for a, b, _ in packed]
        tiny = sum(len(t) < 30 for t in inside)
        wrong = ["empty_chunk"] * ("" in inside) + ["excessive_tiny_chunks"] * (len(packed) >= 4 and 2 * tiny > len(packed))
        if expected != "recursive" and not wrong:
            structural += 1
            assert [(c.start_at, c.end_at, c.context) for c in found] == packed
            assert {c.strategy for c in found} == {expected} and found[0].reasons == []
        elif expected != "recursive":
            assert [tuple(x) for x in found[0].reasons][0] == (expected, ";".join(wrong))
            assert found[0].strategy in ("recursive", None)
        block_texts = {r[1]: r[3] for r in docs[d]}
        for c in found:
            if c.strategy is None:
                continue
            assert texts[d][c.start_at : c.end_at] == c.content
            pieces = "".join(block_texts[b.block_index][b.start_at : b.end_at] for b in c.blocks)
            assert pieces.replace("\n", "") == c.content.replace("\n", "") and pieces
    assert structural >= 5


def _plain_semantic(units, text, size, window, percentile):
    segments, k = [], 0
    for i, u in enumerate(units):
        k += i > 0 and u[4]
        segments.append(k)
    inputs = ["\n".join(text[u[0] : u[1]] for u, s in list(zip(units, segments))[i : i + window] if s == segments[i]) for i in range(len(units))]
    vectors = word_vectors(pd.Series(inputs)).tolist()
    if any(v is None for v in vectors):
        return None
    distances = {}
    for i in range(1, len(units)):
        if segments[i] == segments[i - 1]:
            a, b = np.array(vectors[i - 1]), np.array(vectors[i])
            distances[i] = 1 - max(-1.0, min(1.0, a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b))))
    far = {i for i, d in distances.items() if d >= np.percentile(list(distances.values()), percentile) - 1e-12}
    least, kept = max(8, min(64, size // 4)), []
    weight = lambda a, b: sum(len(text[u[0] : u[1]].strip()) for u in units[a:b])
    hard = [i for i in range(1, len(units)) if units[i][4]]
    for begin, end in zip([0, *hard], [*hard, len(units)]):
        own, start = [], begin
        for i in sorted(far):
            if start < i < end and begin < i and weight(start, i) >= least:
                own.append(i)
                start = i
        if own and weight(own[-1], end) < least:
            own.pop()
        kept += own
    return kept


def test_semantic_chunks_are_those_of_a_plain_version(spark):
    rows = [r for r in _random_blocks(5, 16)]
    docs = _by_doc(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    size = 200
    out = B.chunk_plan(df, Config(size=size, overlap=0), "semantic", embed=word_vectors, signature="m:16", window=2, percentile=70)
    found = {}
    for c in out.orderBy("doc_id", "chunk_index").collect():
        found.setdefault(c.doc_id, []).append(c)
    semantic = 0
    for d, chunks in found.items():
        text, units = _source(docs[d]), _plain_units(docs[d])
        kept = _plain_semantic(units, text, size, 2, 70)
        if kept is None:
            assert tuple(chunks[0].reasons[0]) == ("semantic", "invalid_vector_dimension")
        elif chunks[0].strategy == "semantic":
            semantic += 1
            assert [(c.start_at, c.end_at, c.context) for c in chunks] == _plain_packed(units, "semantic", size, set(kept))
        else:
            assert chunks[0].reasons[0].strategy == "semantic" and chunks[0].reasons[0].reason.split(";")[0] in ("empty_chunk", "excessive_tiny_chunks")
    assert semantic >= 6


def test_each_stage_takes_what_the_one_before_gave_up(spark):
    long = "word " * 60
    rows = [
        _row(1, 0, "text", long + "poison"),  # the model fails on it
        _row(2, 0, "text", long.replace("word", "fine")), _row(2, 1, "text", long),
        _row(3, 0, "code", "x" * 900), _row(3, 1, "text", "tail " * 20),  # too many tokens for any strategy
        _row(4, 0, "heading", "A", level=1), _row(4, 1, "heading", "B", level=2), _row(4, 2, "heading", "C", level=2), _row(4, 3, "heading", "D", level=1),
        _row(5, 0, "image", None), _row(5, 1, "text", ""), _row(6, 0, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6, "doc_id")

    def embed(texts):
        if texts.str.contains("poison").any():
            raise RuntimeError("down")
        return texts.map(lambda t: [float(len(t)), 1.0])

    def plan(**more):
        got = {}
        settings = {"embed": embed, "signature": "m:2"} | more
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a document to a call
        try:
            for c in B.chunk_plan(df, Config(size=512, overlap=0, max_tokens=200), "semantic", **settings).collect():
                got.setdefault(c.doc_id, (c.strategy, [tuple(r) for r in c.reasons], c.chunk_index))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        return got

    got = plan()
    assert set(got) == {1, 2, 3, 4}  # documents without text have no source
    assert got[1][:2] == ("recursive", [("semantic", "embedding_error")])
    assert got[2][:2] == ("semantic", [])
    over = "token_limit_exceeded"
    assert got[3] == (None, [("semantic", over), ("recursive", over)], None)
    # four headings alone are tiny pieces under their own strategy, one piece under the others
    assert got[4][0] == "semantic" and got[4][1] == []
    assert plan(embed=None)[4][:2] == ("recursive", [("semantic", "missing_embedding_callable"), ("heading", "excessive_tiny_chunks")])
    assert plan(signature=" ")[1][1][0] == ("semantic", "missing_model_signature")
    assert plan(signature="m")[1][1][0] == ("semantic", "invalid_model_signature_dimension")
    assert plan(signature="m:3")[2][1][0] == ("semantic", "invalid_vector_dimension")
    assert plan(embed=lambda t: t.map(lambda _: [0.0, 0.0]))[2][1][0] == ("semantic", "invalid_vector_zero_norm")
    assert plan(embed=lambda t: t.map(lambda _: [float("nan"), 0.0]))[2][1][0] == ("semantic", "invalid_vector_non_finite")
    assert plan(embed=lambda t: [])[2][1][0] == ("semantic", "invalid_vector_count")

    def slow(texts):
        raise TimeoutError

    assert plan(embed=slow)[2][1][0] == ("semantic", "embedding_timeout")
    with pytest.raises(ValueError):
        B.chunk_plan(df, requested="other")


def test_nested_plan_keeps_children_inside_parents(spark):
    df = spark.createDataFrame(_random_blocks(9), SCHEMA)
    out = B.chunk_plan(df, Config(size=512, overlap=0, parent_size=300, child_size=100, child_overlap=20), nested=True).where("strategy is not null")
    both = {}
    for c in out.collect():
        both.setdefault(c.doc_id, []).append(c)
    assert both
    for chunks in both.values():
        parents = [c for c in sorted(chunks, key=lambda c: c.chunk_index) if c.chunk_type == "parent_text"]
        children = [c for c in chunks if c.chunk_type == "text"]
        assert parents and children
        for c in children:
            p = parents[c.parent_index]
            assert p.start_at <= c.start_at < c.end_at <= p.end_at and c.context == p.context


def test_empty_blocks(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert B.chunk_plan(df, requested="semantic", embed=word_vectors, signature="m:16").count() == 0
    few = df.select("doc_id", "block_index", "kind", "text", F.lit("mine").alias("unit"))
    assert B.atomic_units(few).count() == 0


def test_units_and_vectors_of_a_document_are_taken_together(spark):
    """Units by column are those by row, of a slice too; the first fault is that of the vectors one by one."""
    import pyarrow as pa

    rows = [[{"unit": k, "title": None if k % 2 else "t", "hard": k == 1} for k in range(n)] for n in (2, 0, 3)]
    units = pa.array(rows, type=pa.list_(pa.struct({"unit": pa.int64(), "title": pa.string(), "hard": pa.bool_()})))
    assert [B.unit_rows(u) for u in units] == rows and [B.unit_rows(u) for u in units.slice(1)] == rows[1:]
    good = [[1.0, 2.0], [0.0, 3.0]]
    for bad in (None, "embedding_error", [1.0], [0.0, 0.0], [float("nan"), 1.0], "12", [[1.0, 2.0]], ["a", "b"]):
        for vectors in ([*good, bad, "late"], [bad, *good], [bad], [bad, bad]):
            assert B.first_fault(vectors, 2) == next(f for f in (B.fault_of(v, 2) for v in vectors) if f)
    assert B.first_fault(good, 2) is None and B.first_fault([], 2) is None
