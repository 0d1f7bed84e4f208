"""The pipeline against plain versions of its stages, each on its own input."""

import corpus_pipeline
from corpusq.llm import quality
from corpusq.llm.shared import cut, table

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = lambda d: {r.doc_id: r.text for r in d.collect()}
    before = rows(docs)
    inputs = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        inputs.append(rows(docs))
    accepted, exact, near, clean = inputs

    scores = quality.quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert set(accepted) == {r.doc_id for r in scores.where("predicted = 1").collect()}

    first = {}
    for i in sorted(accepted):
        first.setdefault(brute.normal(accepted[i]), i)
    assert set(exact) == set(first.values())

    classes, _ = brute.near_classes(exact.items())
    assert set(near) == {i for i in exact if classes[i] == i}

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    marked = brute.contamination(near.items(), items)
    assert set(clean) == {i for i in near if not marked[i][3]}
    assert set(clean) <= set(before)

    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies and set(copies) <= set(clean) and max(copies.values()) <= 3


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
    assert corpus_pipeline.run(spark, SF).count() > 0
