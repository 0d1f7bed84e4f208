"""Batched extraction: calls, attribution and faults that stay in their batch."""

import json
import random

from pyspark.sql import functions as F

from corpusq.operators import extraction as X

SCHEMA = "doc_id int, chunk_index int, content string"


def _chunks(spark, sizes, parts=3):
    rows = [(d, i * 2, f"Doc{d} chunk{i} {'Shared' if i % 2 else ''}") for d, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def _words(texts):
    return [{"chunk_key": k, "entities": [{"name": w, "attributes": [k, "x"]} for w in t.split()]} for k, t in texts.items()]


def test_a_hundred_and_seven_chunks_take_twenty_two_calls(spark):
    out = X.extract(_chunks(spark, {1: 107}), _words)
    assert out.count() == 22 and out.agg(F.sum("calls")).first()[0] == 22
    assert X.failures(out).count() == 0
    sizes = sorted(r[0] for r in out.select(F.size("chunk_indexes")).collect())
    assert sizes == [2] + [5] * 21
    found = {(r.chunk_index, r.name) for r in X.entities(out).collect()}
    assert {i for i, n in found if n == "Shared"} == {2 * i for i in range(107) if i % 2}
    assert all(n in ("Doc1", "Shared", f"chunk{i // 2}") for i, n in found) and len(found) == 107 * 2 + 53


def test_a_failed_batch_loses_its_own_chunks_only_and_reruns_agree(spark):
    sizes = {1: 12, 2: 4, 3: 1}

    def fails(texts):
        if any("Doc1 chunk7" in t for t in texts.values()):
            raise ValueError("no model")
        return "not a list" if any("Doc2" in t for t in texts.values()) else json.dumps(_words(texts))

    results = []
    for parts in (1, 5):
        out = X.extract(_chunks(spark, sizes, parts), fails)
        rows = sorted((r.doc_id, r.chunk_index, r.name, tuple(r.attributes)) for r in X.entities(out).collect())
        results.append((rows, sorted(tuple(r) for r in X.failures(out).collect())))
    assert results[0] == results[1]
    rows, failed = results[0]
    assert failed == [(1, 1, 5, 1, "ValueError: no model"), (2, 0, 4, 2, "no_list")]
    assert {(d, i) for d, i, *_ in rows} == {(1, 2 * i) for i in (0, 1, 2, 3, 4, 10, 11)} | {(3, 0)}


def test_a_second_try_may_give_a_list(spark, tmp_path):
    mark = tmp_path / "tried"

    def flaky(texts):
        if not mark.exists():
            mark.write_text("")
            return None
        return _words(texts)

    out = X.extract(_chunks(spark, {1: 2}), flaky).collect()
    assert [(r.calls, r.error, len(r.found)) for r in out] == [(2, None, 5)]


def test_attribution_leaves_out_what_belongs_to_no_chunk():
    items = [
        {"chunk_key": "c001", "entities": [{"name": " A ", "attributes": [1, "u", 1]}, {"name": "A", "attributes": ["v"]}, {"name": ""}, "B", {"title": "C"}]},
        {"chunk_key": "c009", "entities": [{"name": "D"}]}, "c001", {"entities": [{"name": "E"}]}, {"chunk_key": "c002", "nodes": [{"name": "F"}]},
    ]
    got = X.attributed(items, {"c001": 0, "c002": 1})
    assert got == [{"place": 0, "name": "A", "attributes": ["1", "u", "v"]}, {"place": 1, "name": "F", "attributes": []}]
    assert X.parsed('so: [{"a": 1}] end') == [{"a": 1}] and X.parsed("[1") is None and X.parsed({"a": 1}) is None and X.parsed(None) is None


def test_odd_chunks(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, ""), (2, 0, "Name here")], SCHEMA).withColumn("batch", F.lit("mine"))
    out = X.extract(df, _words)
    assert sorted(r.name for r in X.entities(out).collect()) == ["Name", "here"]
    assert X.extract(df.where("false"), _words).count() == 0
    assert [r.name for r in X.plain_entities(df).collect()] == ["Name"]
