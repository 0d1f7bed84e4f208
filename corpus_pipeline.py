"""The training-data pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of documents; the last returns the mixed documents,
each row as often as it was taken, numbered by ``copy_no``.

For all stages: an empty table gives an empty result; very long texts are read
whole; further columns, whatever their names, pass through; rows are judged by
their own text, so rows that repeat a doc_id with other texts go their own ways.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusq.llm.decontaminate import drop_contaminated
from corpusq.llm.exact_dedup import drop_exact_duplicates
from corpusq.llm.mixing import mix
from corpusq.llm.near_dup import drop_near_duplicates
from corpusq.llm.quality import drop_low_quality
from corpusq.llm.shared import cut, keep, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like others; rows with a null doc_id are
    judged but never train; a score of exactly 0.5 is accepted; repeated rows go
    or stay together; without labels of both classes the class that there is
    decides, and without any all rows stay.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest doc_id.

    Null counts as empty text, so of such rows one document stays; a group whose
    ids are all null keeps all its rows; with ids, rows without one go; repeated
    rows of the document that stays all stay.
    """
    return drop_exact_duplicates(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id.

    Texts without words and rows with a null doc_id are near to nothing and stay;
    a pair at exactly the threshold is linked; repeated rows of the document that
    stays all stay.
    """
    return drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null texts, texts without words and, with an empty benchmark, all texts are
    clean; exactly a twentieth of hit words is contaminated; ids play no part, so
    rows with a null or a repeated id are judged each by its text.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix of sources, repeated as often as they are taken.

    Exactly the copies that the plan of op2 names; null texts and texts without
    words are never taken; the null source is a source of its own; documents of
    equal size are told apart by hashes of id and text; repeated rows are dealt
    the copies of their group.
    """
    return mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: The classifier and the join have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.  What a stage writes for itself
    goes once its result is written, and at the end all results but that which the
    last stage reads."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as inputs:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as own:
                docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
                keep(own)
        inputs.pop()  # the last stage reads it when its result is asked for
    return STAGES[-1][1](spark, docs, sf_dir)
