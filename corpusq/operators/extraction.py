"""Entities of chunks, extracted in small batches whose faults stay their own.

Chunks of a document are taken in order, ``BATCH`` to a call.  A batch is one row of
a few texts, so calls spread over tasks whatever the size of a document, and a
failed call costs its batch alone: that gives no entities and says why.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusq.functions.text import candidate_names
from corpusq.tables import written

BATCH = 5
#: Calls for a batch until one gives a list.
TRIES = 2
#: Calls whose results leave a task in one batch.
CALLS = 256

#: A function from {chunk key: text} to a list of {"chunk_key", "entities": [{"name",
#: "attributes"}]}, or that list as JSON, perhaps inside other text.
Extractor = Callable[[dict[str, str]], object]

_RESULT = "found array<struct<place:int,name:string,attributes:array<string>>>, calls int, error string"


def batches(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """doc_id, batch, members (place, chunk_index, content): a row for each ``size``
    chunks of a document, in the order of the chunks.  The chunks of a document meet
    once; their numbers and their batches are made in that place."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index")) - 1
    placed = chunks.select("doc_id", "chunk_index", "content").withColumn("nth", nth)
    numbered = placed.withColumn("batch", F.floor(F.col("nth") / size)).withColumn("place", F.pmod("nth", F.lit(size)))
    member = F.struct("place", "chunk_index", "content")
    return numbered.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(member)).alias("members"))


def parsed(value: object) -> list | None:
    """The list that an extractor gave, as such or as JSON; None if it gave none."""
    if isinstance(value, str):
        begin, end = value.find("["), value.rfind("]")
        try:
            value = json.loads(value[begin : end + 1]) if 0 <= begin < end else None
        except ValueError:
            return None
    return value if isinstance(value, list) else None


def attributed(items: list, places: dict[str, int]) -> list[dict]:
    """(place, name, attributes) of what a call found: entries under another key, and
    those that are no mapping or have no name, are left out; a name counts once in
    a chunk, with all attributes that it is given there."""
    found: dict[tuple[int, str], list[str]] = {}
    for item in items:
        if not isinstance(item, dict) or item.get("chunk_key") not in places:
            continue
        for entity in item.get("entities") or item.get("nodes") or []:
            name = str(entity.get("name") or "").strip() if isinstance(entity, dict) else ""
            if name:
                known = found.setdefault((places[item["chunk_key"]], name), [])
                known += map(str, entity.get("attributes") or [])
    return [{"place": p, "name": n, "attributes": list(dict.fromkeys(a))} for (p, n), a in found.items()]


def extract(chunks: DataFrame, extractor: Extractor, size: int = BATCH, tries: int = TRIES) -> DataFrame:
    """doc_id, batch, chunk_indexes, found, calls, error: one row per batch, written,
    so a rerun of what follows calls nothing again.  ``error`` says why a batch has no
    result (the fault's type and text, or ``no_list``); then ``found`` is empty."""

    def call(own: list[str]) -> tuple[list[dict], int, str | None]:
        keys = {f"c{k + 1:03d}": k for k in range(len(own))}
        items, error, calls = None, None, 0
        while items is None and calls < tries:
            calls += 1
            try:
                items = parsed(extractor({key: own[k] or "" for key, k in keys.items()}))
                error = None if items is not None else "no_list"
            except Exception as fault:  # contained: the batch is recorded as failed
                error = f"{type(fault).__name__}: {fault}"
                break
        return attributed(items or [], keys), calls, error

    grouped = batches(chunks, size)
    indexes = F.transform("members", lambda m: m["chunk_index"]).alias("chunk_indexes")
    asked = grouped.select("doc_id", "batch", indexes, F.transform("members", lambda m: m["content"]).alias("texts"))
    typed = StructType([*asked.schema.fields[:3], *StructType.fromDDL(_RESULT).fields])
    out_schema = to_arrow_schema(typed)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, CALLS):
                own = part.slice(at, CALLS)
                results = zip(*map(call, own.column(3).to_pylist()))
                made = [pa.array(c, type=f.type) for c, f in zip(results, list(out_schema)[3:])]
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(own.columns, list(out_schema)[:3])], *made], schema=out_schema)

    return written(asked.mapInArrow(run, typed), "extracted")


def entities(extracted: DataFrame) -> DataFrame:
    """doc_id, chunk_index, name, attributes of every chunk's entities."""
    hits = extracted.select("doc_id", "chunk_indexes", F.explode("found").alias("f"))
    chunk = F.element_at("chunk_indexes", F.col("f.place") + 1)
    return hits.select("doc_id", chunk.alias("chunk_index"), "f.name", "f.attributes")


def failures(extracted: DataFrame) -> DataFrame:
    """doc_id, batch, n_chunks, calls, error of the batches that failed."""
    return extracted.where("error is not null").select("doc_id", "batch", F.size("chunk_indexes").alias("n_chunks"), "calls", "error")


def plain_entities(chunks: DataFrame) -> DataFrame:
    """The same rows without a model: capitalised names, in built-in expressions."""
    names = F.explode(F.array_distinct(candidate_names(F.col("content")))).alias("name")
    return chunks.select("doc_id", "chunk_index", names).withColumn("attributes", F.array().cast("array<string>"))
