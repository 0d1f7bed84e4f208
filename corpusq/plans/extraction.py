"""Entities extracted in batches."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from corpusq import model
from corpusq.operators import chunking, extraction
from corpusq.plans.chunks import SQL_CHUNKS
from corpusq.registry import query

_NAME = re.compile(r"[A-Z][a-z]+")


def name_extractor(texts: dict[str, str]) -> str:
    """A plain stand-in for a model: words of A-Z and a-z that start with a capital,
    as JSON behind a remark.  It fails where its texts' lengths add up to a multiple of
    nine and says something else where that leaves one."""
    size = sum(map(len, texts.values()))
    if size % 9 == 0:
        raise RuntimeError("overloaded")
    if size % 9 == 1:
        return "nothing to say"
    found = [{"chunk_key": k, "entities": [{"name": n} for n in _NAME.findall(t)]} for k, t in texts.items()]
    return "Here: " + json.dumps([*found, {"chunk_key": "c999", "entities": [{"name": "Nobody"}]}])


#: Batches of five chunks of a document with what the stand-in makes of them.
SQL_BATCHES = f"""{SQL_CHUNKS}, b AS (SELECT doc_id, chunk_index, content, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1) // 5 AS batch FROM c),
s AS (SELECT doc_id, batch, count(*) AS n_chunks, sum(length(content)) % 9 AS state FROM b GROUP BY ALL)"""


def _extracted(spark, sf_dir):
    chunks = chunking.fixed_chunks(model.read(spark, sf_dir, "documents"))
    return extraction.extract(chunks, name_extractor)


@query(
    "batched_entities",
    f"""WITH {SQL_BATCHES} SELECT DISTINCT doc_id, chunk_index, unnest(regexp_extract_all(content, '[A-Z][a-z]+')) AS name FROM b JOIN s USING (doc_id, batch) WHERE state > 1""",
)
def batched_entities(spark, sf_dir):
    """The names of every chunk, by calls for five chunks of a document at a time."""
    return extraction.entities(_extracted(spark, sf_dir)).drop("attributes")


@query(
    "failed_batches",
    f"""WITH {SQL_BATCHES} SELECT doc_id, batch, n_chunks, CASE state WHEN 0 THEN 1 ELSE 2 END AS calls,
      CASE state WHEN 0 THEN 'RuntimeError: overloaded' ELSE 'no_list' END AS error FROM s WHERE state <= 1""",
)
def failed_batches(spark, sf_dir):
    """The batches that gave nothing, and why."""
    return extraction.failures(_extracted(spark, sf_dir))
