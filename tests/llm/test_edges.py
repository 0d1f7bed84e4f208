"""Every operator and stage on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusq.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    language_model,
    licenses,
    mixing,
    near_dup,
    quality,
    secrets,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ("__id", "__sha", "__keep", "copy_no", "size", "node", "norm", "spans", "items", "prefix", "place", "token", "h1", "class", "rank")
LONG = "wordy text that goes on and on " * 20_000


def _rows():
    return [
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (3, "One  two three\nfour five six seven", "en", None, 34),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, "   \n\t ", "en", "b", 6),
        (7, LONG, "en", "c", len(LONG)),
        (None, "no id here but some words stand in it", "en", "a", 10),
        (None, None, "en", "a", 0),
        (8, 'token = "abcdefghijkl0123"\nidiot', "en", "c", 20),
        (9, "é" * 50, "fr", "c", 50),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(1, 1, 0), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("mine"))


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "four five six"), (1, "four five six"), (None, "some words stand"), (2, None), (3, "")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("item", F.lit("mine"))


OPERATORS = {
    "secrets": lambda d, x, b: secrets.find_secrets(d),
    "mix_plan": lambda d, x, b: mixing.mix_plan(d),
    "licences": lambda d, x, b: licenses.find_licences(d),
    "decontaminate": lambda d, x, b: decontaminate.decontaminate(d, b),
    "quality": lambda d, x, b: quality.quality_scores(d, x),
    "exact": lambda d, x, b: exact_dedup.exact_dedup(d),
    "near": lambda d, x, b: near_dup.near_duplicates(d),
    "toxicity": lambda d, x, b: toxicity.toxicity_scores(d, x),
    "lm": lambda d, x, b: language_model.lm_scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(name, docs, empty, labels, benchmark):
    assert OPERATORS[name](docs, labels, benchmark).count() == len(_rows())
    assert OPERATORS[name](empty, labels, benchmark).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxicity"])
@pytest.mark.parametrize("which", ["none", "one class"])
def test_poor_labels(name, which, docs, labels, benchmark):
    few = labels.where("false") if which == "none" else labels.where("quality = 1 and toxic = 0 and doc_id is not null")
    scores = [r.score for r in OPERATORS[name](docs, few, benchmark).collect()]
    assert len(scores) == len(_rows()) and all(0 <= s <= 1 for s in scores)


def test_scores_are_probabilities(docs, labels, benchmark):
    for name in ("quality", "toxicity"):
        for r in OPERATORS[name](docs, labels, benchmark).collect():
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out in (True, False)


@pytest.mark.parametrize("step", range(5))
def test_stages_keep_columns(step, spark, docs, empty, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    _, stage = corpus_pipeline.STAGES[step]
    for table in (docs, empty):
        out = stage(spark, table, str(tmp_path))
        assert out.columns[: len(table.columns)] == table.columns
        assert len(out.columns) == len(table.columns) + (step == 4)
        kept = out.select("doc_id", "n_chars").collect()
        assert len(kept) <= 3 * table.count()
        if "place" in table.columns and kept:
            assert {r.place for r in out.select("place").collect()} == {"mine"}


def test_exact_dedup_decisions(docs):
    by = {}
    for r in exact_dedup.exact_dedup(docs).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].keep_id == 1 and by[1][0].kept and by[1][0].group_size == 3
    assert [r.kept for r in by[2]] == [False, False]
    assert by[3][0].kept  # a capital letter makes another text
    assert by[5][0].keep_id == 4 and by[5][0].group_size == 3 and not by[5][0].kept
    assert by[4][0].kept and by[6][0].kept  # white space alone is one space, not empty
    assert all(r.kept == (r.keep_id is None) for r in by[None])


def test_near_duplicates_of_odd_rows(docs):
    rows = near_dup.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].class_id == by[2].class_id == by[3].class_id == 1
    assert by[1].n_copies == 4 and by[1].n_links == 0
    assert [by[i].class_id for i in (4, 5, 6)] == [4, 5, 6]
    assert all(r.class_id is None for r in rows if r.doc_id is None)


def test_pages(spark):
    html = "<html><body><nav><a>menu</a></nav><article><p>one &amp; two</p><p>three</article><footer>f</footer>"
    rows = [(1, "http://h/a", html), (1, "http://h/a", html), (2, None, html), (3, "http://h/b", None), (None, "not a url", ""), (4, "http://h/c", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("path", F.lit(1))
    out = html_text.extract(pages).collect()
    assert sorted(r.text for r in out if r.page_id in (1, 2)) == ["one & two\nthree"] * 3
    assert all(r.text == "" and r.n_chars == 0 for r in out if r.page_id in (3, None))
    assert [r.n_chars for r in out if r.page_id == 4] == [len(LONG.strip())]
    assert html_text.extract(pages.where("false")).count() == 0
