"""Parent contexts of hits: collapse, fallbacks, edited text, clipped windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CONTEXT_CHARS = 4096
#: Parents that are written over at once.
PARENTS = 256
#: Chunks that are taken from a batch at once, and characters of those that leave a task in one.
ROWS, BATCH_CHARS = 1_024, 1_000_000


def collapse_siblings(hits: DataFrame) -> DataFrame:
    """One row per query and parent: the best-ranked child, its rank, the score
    and all child ids in rank order; hits without parent stand for themselves."""
    key = F.coalesce(F.concat(F.lit("p"), F.col("parent_id").cast("string")), F.concat(F.lit("c"), F.col("id").cast("string")))
    child = F.struct("rank", "id")
    out = hits.withColumn("group_key", key).groupBy("query_id", "group_key").agg(
        F.min(child).alias("best"),
        F.min_by("score", child).alias("score"),
        F.first("parent_id").alias("parent_id"),
        F.array_sort(F.collect_list(child)).alias("children"),
    )
    order = W.partitionBy("query_id").orderBy("best.rank", "best.id")
    return out.select(
        "query_id", "parent_id", F.col("best.id").alias("id"), F.col("best.rank").alias("child_rank"), "score",
        F.transform("children", lambda c: c["id"]).alias("child_ids"),
        F.row_number().over(order).alias("rank"),
    )


def evidence_window(length: Column, start: Column, end: Column, first_start: Column, first_end: Column, cap: int = CONTEXT_CHARS) -> tuple[Column, Column]:
    """(from, to) of a window of at most ``cap`` characters: centred on the union
    of the evidence where that fits, else on the first piece, held inside the text."""
    fits = end - start <= cap
    centre = F.when(fits, start + end).otherwise(first_start + first_end)
    begin = F.greatest(F.lit(0), F.least(F.floor((centre - cap) / 2), length - cap))
    begin = F.when(length <= cap, F.lit(0)).otherwise(begin).cast("long")
    return begin, F.least(length, begin + cap).cast("long")


def resolve_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (with parent_id, tenant_id, kb_id, doc_id, start_at, end_at) left-joined to
    parents (parent_id, p_type, p_tenant_id, p_kb_id, p_doc_id, p_start, p_end) with
    ``fallback``: why a parent cannot be used, or null."""
    joined = hits.join(parents, "parent_id", "left")
    scope = (F.col("tenant_id") == F.col("p_tenant_id")) & (F.col("kb_id") == F.col("p_kb_id")) & (F.col("doc_id") == F.col("p_doc_id"))
    inside = (F.col("start_at") >= F.col("p_start")) & (F.col("end_at") <= F.col("p_end")) & (F.col("start_at") < F.col("end_at"))
    reason = (
        F.when(F.col("parent_id").isNull(), F.lit(None).cast("string"))
        .when(F.col("p_type").isNull(), F.lit("missing_parent"))
        .when(F.col("p_type") != "parent_text", F.lit("invalid_parent_type"))
        .when(~scope, F.lit("parent_scope_mismatch"))
        .when(~inside, F.lit("invalid_source_range"))
    )
    return joined.withColumn("fallback", reason)


def live_only(hits: DataFrame, live: DataFrame) -> DataFrame:
    """Fail closed: hits that match no live chunk of the scope are dropped."""
    return hits.join(live.select("id").distinct(), "id", "left_semi")


def widened(texts: list[str], at: int, short: int, enough: int) -> str:
    """The text at a place of a document's chunks, with its neighbours' if it is short."""
    own = texts[at]
    if len(own) >= short:
        return own
    front: list[str] = []
    size, back = len(own), []
    for parts, places in ((front, range(at - 1, -1, -1)), (back, range(at + 1, len(texts)))):
        for j in places:
            if size >= enough:
                break
            if texts[j] not in own:
                parts.append(texts[j])
                size += len(texts[j])
    return "\n".join([*reversed(front), own, *back])


def expand_short(chunks: DataFrame, short: int = 350, enough: int = 850) -> DataFrame:
    """Chunks shorter than ``short`` with text of their neighbours: those before
    are put in front until ``enough`` characters are there, then those after
    behind; a neighbour that stands in the chunk itself is passed over.  Chunks
    are sorted by document where they meet, and a task holds the texts of one
    document and the rows of one batch that goes out."""
    typed = StructType.fromDDL(f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, chunk_index int, expanded string")
    out_schema = to_arrow_schema(typed)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[int], list[str]]]:
        key, places, texts = None, [], []
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                for doc_id, index, text in zip(*(c.to_pylist() for c in batch.slice(begin, ROWS).columns)):
                    if texts and doc_id != key:
                        yield key, places, texts
                        places, texts = [], []
                    key = doc_id
                    places.append(index)
                    texts.append(text)
        if texts:
            yield key, places, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for doc_id, places, texts in documents(batches):
            for at, index in enumerate(places):
                rows.append((doc_id, index, widened(texts, at, short, enough)))
                size += len(rows[-1][2])
                if size >= BATCH_CHARS:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    columns = chunks.select("doc_id", "chunk_index", "content")
    return columns.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index").mapInArrow(run, typed)


def overlay_edits(parent: str, offset: int, edits: list[tuple[int, int, str, int]]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Parent text with edited children written over their source ranges, newest
    first, none over another; and the map of source spans to spans of the result.
    ``edits``: (start, end, text, version) in source positions."""
    taken: list[tuple[int, int, str]] = []
    for start, end, text, _ in sorted(edits, key=lambda e: (-e[3], e[0])):
        if offset <= start < end <= offset + len(parent) and all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, text))
    out, spans, at, size = [], [], offset, 0
    for start, end, text in [*sorted(taken), (offset + len(parent), offset + len(parent), "")]:
        for piece, a, b in ((parent[at - offset : start - offset], at, start), (text, start, end)):
            if b > a:
                out.append(piece)
                spans.append((a, b, size, size + len(piece)))
                size += len(piece)
        at = end
    return "".join(out), spans


def rendered_span(spans: list[tuple[int, int, int, int]], start: int, end: int) -> tuple[int, int] | None:
    """Where a source range stands in the overlaid text; edited pieces count whole."""
    found = []
    for a, b, c, d in spans:
        if start < b and end > a:
            same = b - a == d - c
            found.append((c + max(0, start - a), c + min(b, end) - a) if same else (c, d))
    return (min(f[0] for f in found), max(f[1] for f in found)) if found else None


def overlay(parents: DataFrame, edits: DataFrame) -> DataFrame:
    """(parent_id, text): parents (parent_id, p_start, content) with the edits
    (parent_id, start_at, end_at, content, version) of their children written in."""
    lists = edits.groupBy("parent_id").agg(
        F.collect_list(F.struct("start_at", "end_at", F.col("content").alias("edit"), "version")).alias("edits")
    )
    joined = parents.join(lists, "parent_id", "left").select("parent_id", "p_start", "content", "edits")
    typed = StructType.fromDDL(f"parent_id {parents.schema['parent_id'].dataType.simpleString()}, text string")
    out_schema = to_arrow_schema(typed)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARENTS):
                ids, starts, texts, edits = (c.to_pylist() for c in batch.slice(at, PARENTS).columns)
                out = [
                    overlay_edits(text, int(start), [(e["start_at"], e["end_at"], e["edit"], e["version"]) for e in own or []])[0]
                    for start, text, own in zip(starts, texts, edits)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((ids, out), out_schema)], schema=out_schema)

    return joined.mapInArrow(write, typed)
