"""Documents made of blocks: one source text with a map back to every block, and
a chunking plan that falls back stage by stage.

``blocks`` has doc_id, block_index, kind and text, and where they are known page,
slide, sheet, headers (array of strings), level and title.  Blocks of kind
``image`` carry no text; nothing is packed across one.

Units, groups and their headers are windows over the units of a document, in SQL.
Only the packing is sequential; it is a map over documents in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusq.operators.chunking import Config, breadcrumbs, merge_spans, protected_ranges, recursive_spans, runs

MEDIA = "image"
SEPARATOR = "\n\n"
#: Kinds that are never cut, and kinds that mark a page layout.
PROTECTED = ("table", "code", "formula", "link", "image_reference")
LAYOUT = ("paragraph", "text_box")
STRATEGIES = ("heading", "record", "layout", "recursive")

_HEADING = r"(?dm)(?=^#{1,6}[ \t]+.)"
_OPTIONAL = {"page": "int", "slide": "int", "sheet": "string", "headers": "array<string>", "level": "int", "title": "string"}


def _complete(blocks: DataFrame) -> DataFrame:
    extra = [
        (F.col(c) if c in blocks.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _OPTIONAL.items()
    ]
    return blocks.select("doc_id", "block_index", F.coalesce("kind", F.lit("text")).alias("kind"), "text", *extra)


def _with_text(blocks: DataFrame) -> DataFrame:
    """Blocks that have text, by their order in the document: ``nth`` (from 0),
    ``base`` (offset in the source) and ``hard`` (media since the block before)."""
    before = W.partitionBy("doc_id").orderBy("block_index")
    media = F.count(F.when(F.col("kind") == MEDIA, 1)).over(before)
    kept = _complete(blocks).withColumn("media", media).where((F.col("kind") != MEDIA) & (F.length("text") > 0))
    nth = F.row_number().over(before) - 1
    sizes = F.coalesce(F.sum(F.length("text")).over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return kept.select(
        "*", nth.alias("nth"), (sizes + len(SEPARATOR) * nth).cast("long").alias("base"),
        (F.col("media") > F.coalesce(F.lag("media").over(before), F.lit(0))).alias("hard"),
    ).drop("media")


def sources(blocks: DataFrame) -> DataFrame:
    """doc_id, text: the texts of a document's blocks in order, a blank line between them."""
    texts = F.sort_array(F.collect_list(F.struct("block_index", "text")))
    kept = blocks.where((F.coalesce("kind", F.lit("text")) != MEDIA) & (F.length("text") > 0))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(texts, lambda b: b["text"]), SEPARATOR).alias("text"))


def atomic_units(blocks: DataFrame) -> DataFrame:
    """One row per unit: doc_id, unit (from 0), start_at, end_at in the source,
    block_index and block_start (offset in the block), kind, level, heading, hard,
    content and what the block says of page, slide, sheet, headers and title.

    Markdown headings inside a block are units of their own; what stands around
    them are paragraphs."""
    own = F.col("kind") == "heading"
    pieces = F.when(own, F.array("text")).otherwise(F.split("text", _HEADING))
    piece = F.col("piece")
    line = F.regexp_extract(piece, r"(?d)\A(#{1,6}[ \t]+[^\n]+)", 1)
    is_heading = ~own & (F.length(line) > 0)
    split = F.when(
        is_heading,
        F.array(
            F.struct(F.lit("heading").alias("kind"), line.alias("text")),
            F.struct(F.lit("paragraph").alias("kind"), F.expr("substring(piece, {0})".format("length(line) + 1")).alias("text")),
        ),
    ).otherwise(F.array(F.struct(F.when(F.col("several"), "paragraph").otherwise(F.col("kind")).alias("kind"), piece.alias("text"))))
    placed = _with_text(blocks).select("*", pieces.alias("pieces")).withColumn(
        "several", ~own & (F.col("pieces").getItem(0).rlike(r"(?d)\A#{1,6}[ \t]+.") | (F.size("pieces") > 1))
    )
    exploded = placed.select("*", F.posexplode("pieces").alias("p", "piece")).withColumn("line", line)
    parts = exploded.select(
        "doc_id", "block_index", "nth", "base", "hard", "page", "slide", "sheet", "headers", "title",
        F.col("level").alias("own_level"), "p", F.posexplode(split).alias("q", "part"),
    ).where(F.length("part.text") > 0)
    order = W.partitionBy("doc_id").orderBy("block_index", "p", "q")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    size = F.length("part.text")
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + len(SEPARATOR) * F.col("nth")
    first = F.row_number().over(W.partitionBy("doc_id", "block_index").orderBy("p", "q")) == 1
    marks = F.length(F.regexp_extract("part.text", r"\A(#{1,6})[ \t]", 1))
    heading = F.col("part.kind") == "heading"
    named = F.regexp_extract("part.text", r"(?d)\A#{1,6}[ \t]+([^\n]+?)[ \t]*\z", 1)
    return parts.select(
        "doc_id", (F.row_number().over(order) - 1).alias("unit"), start.cast("long").alias("start_at"),
        (start + size).cast("long").alias("end_at"), "block_index", (start - F.col("base")).cast("long").alias("block_start"),
        F.col("part.kind").alias("kind"),
        F.when(heading, F.coalesce(F.when(marks > 0, marks), F.least(F.greatest("own_level", F.lit(1)), F.lit(6)), F.lit(1))).cast("int").alias("level"),
        F.when(heading, F.trim(F.when(F.length(named) > 0, named).otherwise(F.col("part.text")))).alias("heading"),
        (F.col("hard") & first).alias("hard"), "page", "slide", "sheet", "headers", "title",
        F.col("part.text").alias("content"),
    )


def _strategy_rank() -> Column:
    kind = F.col("kind")
    return (
        F.when(kind == "heading", 3)
        .when(kind == "record", 2)
        .when(kind.isin(*LAYOUT) | F.col("page").isNotNull() | F.col("slide").isNotNull(), 1)
        .otherwise(0)
    )


def with_strategy(units: DataFrame) -> DataFrame:
    """Units with ``structural``: heading where their document has one, else record,
    else layout, else recursive."""
    names = F.array(*[F.lit(s) for s in ("recursive", "layout", "record", "heading")])
    best = F.max(_strategy_rank()).over(W.partitionBy("doc_id"))
    return units.withColumn("structural", F.element_at(names, best + 1))


def _context(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: F.length(p) > 0), " > ")


def grouped(units: DataFrame) -> DataFrame:
    """Units (with ``structural``, their document's strategy) and the group they may
    be packed in, with its context header: sections under a heading, runs of a page
    or slide, runs of (sheet, headers), or all of the document.

    A heading stands at most one step below the open ones: of depths d before and
    level L its depth is min(d + 1, L).  With t headings so far that is t plus the
    least of 0 and all L - t so far, which is a running minimum."""
    order = W.partitionBy("doc_id").orderBy("unit")
    title = F.coalesce("title", F.lit(""))
    heading = F.col("kind") == "heading"
    nth = F.count(F.when(heading, 1)).over(order)
    own = units.withColumnsRenamed({"level": "__level", "title": "__title"}).withColumn("nth", nth)
    least = F.min(F.when(heading, F.col("__level") - F.col("nth"))).over(order)
    deep = own.withColumns({"level": F.when(heading, F.col("nth") + F.least(F.lit(0), least)), "title": F.col("heading")})
    trail = breadcrumbs(deep, order="unit").withColumnRenamed("path", "trail").drop("level", "title")
    base = trail.withColumnsRenamed({"__level": "level", "__title": "title"})

    place = F.when(F.col("slide").isNotNull(), F.concat(F.lit("Slide "), F.col("slide"))).otherwise(
        F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page"))).otherwise("")
    )
    named = F.filter(F.transform(F.coalesce("headers", F.array().cast("array<string>")), lambda h: F.trim(h)), lambda h: F.length(h) > 0)
    keyed = base.withColumns({"place": place, "names": F.array_join(named, " | "), "holder": F.coalesce("sheet", F.lit("Records"))})
    is_ = lambda s: F.col("structural") == s
    key = F.when(is_("layout"), F.col("place")).when(is_("record"), F.concat_ws("\n", "holder", "names"))
    numbered = runs(keyed.withColumn("key", F.coalesce(key, F.lit(""))), "key", "doc_id", "unit")
    return numbered.select(
        *units.columns,
        F.when(is_("heading"), F.col("nth")).otherwise(F.col("run")).cast("int").alias("section"),
        F.when(is_("heading"), _context(title, F.coalesce("trail", F.lit(""))))
        .when(is_("layout"), _context(title, F.col("place")))
        .when(is_("record"), _context(title, F.col("holder"), F.col("names")))
        .otherwise(_context(title)).alias("context"),
    )


# packing, one document at a time

Unit = tuple[int, int, int, str, bool, bool]  # start, end, section, context, protected, hard
Draft = tuple[int, int, str]


def packed(text: str, units: list[Unit], size: int, overlap: int, shielded: list[tuple[int, int]]) -> list[Draft]:
    """Consecutive units of a section in pieces of at most ``size``; a larger unit
    is cut, one that is protected stays whole."""
    out: list[Draft] = []
    held: list[Unit] = []

    def close() -> None:
        if held:
            out.append((held[0][0], held[-1][1], held[0][3]))
            held.clear()

    for unit in units:
        start, end, section, context, protected, hard = unit
        if held and (hard or section != held[0][2]):
            close()
        if end - start > size and not protected:
            close()
            out += [(a, b, context) for a, b in recursive_spans(text, start, end, size, overlap, within(shielded, start, end))]
            continue
        if held and end - held[0][0] > size:
            close()
        held.append(unit)
    close()
    return out


def within(ranges: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The sorted disjoint ranges that have a part in [start, end)."""
    out = []
    for k in range(max(0, bisect_right(ranges, (start, start)) - 1), len(ranges)):
        if ranges[k][0] >= end:
            break
        if ranges[k][1] > start:
            out.append(ranges[k])
    return out


def unpacked(text: str, units: list[Unit], size: int, overlap: int, shielded: list[tuple[int, int]]) -> list[Draft]:
    """Cuts that only hard boundaries stop."""
    out, begin = [], 0
    for k in range(1, len(units) + 1):
        if k == len(units) or units[k][5]:
            start, end = units[begin][0], units[k - 1][1]
            spans = recursive_spans(text, start, end, size, overlap, within(shielded, start, end))
            out += [(a, b, units[begin][3]) for a, b in spans]
            begin = k
    return out


def least_size(size: int) -> int:
    return max(8, min(64, size // 4))


def issues(text: str, drafts: list[Draft], size: int, max_tokens: int) -> list[str]:
    """What is wrong with a document's chunks, rules in order."""
    if not drafts:
        return ["empty_output"]
    found = {}
    reach, last, tiny = 0, -1, 0
    for a, b, _ in drafts:
        inside = text[a:b].strip()
        if not inside:
            found["empty_chunk"] = None
        if a < last:
            found["unordered_source_range"] = None
        if max_tokens and (b - a + 3) // 4 > max_tokens:
            found["token_limit_exceeded"] = None
        if a > reach and text[reach:a].strip():
            found["incomplete_source_coverage"] = None
        reach, last, tiny = max(reach, b), a, tiny + (len(inside) < least_size(size))
    if text[reach:].strip():
        found["incomplete_source_coverage"] = None
    if len(drafts) >= 4 and 2 * tiny > len(drafts):
        found["excessive_tiny_chunks"] = None
    return list(found)


def consolidated(text: str, units: list[Unit], far: set[int], size: int) -> list[int]:
    """The semantic boundaries (unit numbers) that leave pieces of a least size
    between them; hard boundaries are apart."""
    weights = [len(text[u[0] : u[1]].strip()) for u in units]
    hard = [k for k, u in enumerate(units) if k and u[5]]
    least, kept = least_size(size), []
    for begin, end in zip([0, *hard], [*hard, len(units)]):
        own, start, weight = [], begin, 0
        for k in range(begin, end):
            if k > start and k in far and weight >= least:
                own.append(k)
                start, weight = k, 0
            weight += weights[k]
        if own and weight < least:
            own.pop()
        kept += own
    return kept


def _drafted(stage: str, text: str, rows: list[dict], marks: list[int], config: Config, nested: bool):
    """(drafts of (start, end, context, parent), issues) of a document by one strategy."""
    shielded = merge_spans(protected_ranges(text) + [(u["start_at"], u["end_at"]) for u in rows if u["kind"] in PROTECTED])
    # a chunk larger than its token limit could never pass, so pieces are no larger
    size = piece_size(config, nested)
    overlap = 0 if nested else min(config.overlap, size // 2)
    fenced = set(shielded)
    title = lambda u: u["title"] or ""
    plain = [
        (u["start_at"], u["end_at"], u["section"], u["context"], u["kind"] in PROTECTED or (u["start_at"], u["end_at"]) in fenced, u["hard"])
        for u in rows
    ]
    if stage == "recursive":
        drafts = unpacked(text, [(*u[:3], title(r), *u[4:]) for u, r in zip(plain, rows)], size, overlap, shielded)
    elif stage == "semantic":
        kept = consolidated(text, plain, set(marks), size)
        by = [(*u[:2], bisect_right(kept, k), title(r), *u[4:]) for k, (u, r) in enumerate(zip(plain, rows))]
        drafts = packed(text, by, size, overlap, shielded)
    else:
        drafts = packed(text, plain, size, overlap, shielded)
    wrong = issues(text, drafts, size, config.max_tokens)
    if not nested:
        return [(a, b, c, None) for a, b, c in drafts], wrong
    inner = min(config.child_size, 4 * config.max_tokens or 8192)
    children = [
        (c, d, context, p)
        for p, (a, b, context) in enumerate(drafts)
        for c, d in recursive_spans(text, a, b, inner, min(config.child_overlap, inner // 2), within(shielded, a, b))
    ]
    more = issues(text, [c[:3] for c in children], inner, config.max_tokens)
    return [(a, b, c, None) for a, b, c in drafts] + children, list(dict.fromkeys(more + wrong))


def piece_size(config: Config, nested: bool) -> int:
    return min(config.parent_size if nested else config.size, 4 * config.max_tokens or 8192)


def _traced(rows: list[dict], start: int, end: int, starts: list[int]) -> list[dict]:
    """The blocks under a span, each with the part of it that the span covers."""
    out: list[dict] = []
    for k in range(max(0, bisect_right(starts, start) - 1), len(rows)):
        u = rows[k]
        if u["start_at"] >= end:
            break
        a, b = max(start, u["start_at"]), min(end, u["end_at"])
        if a >= b:
            continue
        shift = u["block_start"] - u["start_at"]
        if out and out[-1]["block_index"] == u["block_index"]:
            out[-1]["end_at"] = b + shift
        else:
            out.append({"block_index": u["block_index"], "start_at": a + shift, "end_at": b + shift})
    return out


# the semantic stage

#: Maps texts to as many vectors; texts of several documents come in one call.
Embed = Callable[[pd.Series], Sequence]
#: Texts in one call of the model.
CALL = 256


def dimension_of(signature: str) -> int:
    """The number behind the colon of ``model:dimension``; 0 if there is none."""
    size = signature.rpartition(":")[2].strip()
    return int(size) if ":" in signature and size.isdecimal() else 0


def window_texts(rows: list[dict], window: int) -> tuple[list[str], list[int]]:
    """For each unit the texts of it and those after it, up to ``window`` of its
    segment, and the segment's number; a segment ends where media stand."""
    segments, n = [], 0
    for k, u in enumerate(rows):
        n += k > 0 and u["hard"]
        segments.append(n)
    texts = []
    for k in range(len(rows)):
        own = [rows[j]["content"] for j in range(k, min(k + window, len(rows))) if segments[j] == segments[k]]
        texts.append("\n".join(own))
    return texts, segments


def called(embed: Embed, texts: list[str]) -> list:
    """Vectors of all texts, ``CALL`` to a call; the reason in place of the vectors of
    a call that fails, so a fault of the model is one of its documents, not of the job."""
    out: list = []
    for k in range(0, len(texts), CALL):
        part = texts[k : k + CALL]
        try:
            made: list = list(embed(pd.Series(part)))
            out += made if len(made) == len(part) else ["invalid_vector_count"] * len(part)
        except TimeoutError:
            out += ["embedding_timeout"] * len(part)
        except Exception:
            out += ["embedding_error"] * len(part)
    return out


def fault_of(vector: object, dimension: int) -> str | None:
    if isinstance(vector, str):
        return vector
    try:
        values = np.asarray(vector, dtype=float)
    except (TypeError, ValueError):
        return "invalid_vector_dimension"
    if values.shape != (dimension,):
        return "invalid_vector_dimension"
    if not np.isfinite(values).all():
        return "invalid_vector_non_finite"
    return None if values.any() else "invalid_vector_zero_norm"


def first_fault(vectors: list, dimension: int) -> str | None:
    """The fault of the first vector that has one; sound ones are looked at together."""
    try:
        m = np.asarray(vectors, dtype=float)
    except (TypeError, ValueError):
        m = np.zeros(0)
    if m.shape == (len(vectors), dimension) and np.isfinite(m).all() and m.any(axis=1).all():
        return None
    return next((f for f in (fault_of(v, dimension) for v in vectors) if f), None)


def unit_rows(units: pa.ListScalar) -> list[dict]:
    """The units of a document, taken column by column."""
    own = units.values
    names = [f.name for f in own.type]
    return [dict(zip(names, row)) for row in zip(*(c.to_pylist() for c in own.flatten()))]


def far_units(vectors: list, segments: list[int], percentile: float) -> list[int]:
    """Units whose window is as far from the one before, in their segment, as the
    percentile of the document's distances."""
    m = np.array(vectors, dtype=float)
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    distances = 1 - np.clip((m[1:] * m[:-1]).sum(axis=1), -1, 1)
    same = np.flatnonzero(np.array(segments[1:]) == np.array(segments[:-1]))
    if not len(same):
        return []
    return (same[distances[same] >= np.percentile(distances[same], percentile)] + 1).tolist()


_DRAFTS = (
    "array<struct<start_at:long,end_at:long,context:string,parent_index:int,content:string,"
    "blocks:array<struct<block_index:{index},start_at:long,end_at:long>>>>"
)
#: Windows of documents that are embedded together.
AT_ONCE = 4 * CALL


def _planned(
    ready: DataFrame, config: Config, nested: bool, problem: str | None, embed: Embed | None, dimension: int,
    window: int, percentile: float, requested: str, content: bool,
) -> DataFrame:
    """doc_id, strategy, reasons, drafts: every document through its stages, each
    only where the one before gave up."""
    kind, index = ready.schema["doc_id"].dataType.simpleString(), ready.schema["units"].dataType.elementType["block_index"].dataType.simpleString()
    typed = StructType.fromDDL(f"doc_id {kind}, strategy string, reasons array<struct<strategy:string,reason:string>>, drafts {_DRAFTS.format(index=index)}")
    out_schema = to_arrow_schema(typed)

    def planned(doc_id: object, structural: str, rows: list[dict], vectors: list | None, segments: list[int] | None) -> dict:
        text, at = [], 0
        for u in rows:
            text += [SEPARATOR] * (u["start_at"] > at) + [u["content"]]
            at = u["end_at"]
        text = "".join(text)
        reasons, marks, stages = [], [], []
        if requested == "semantic":
            fault = problem or first_fault(vectors or [], dimension)
            if fault:
                reasons.append({"strategy": "semantic", "reason": fault})
            else:
                marks = far_units(vectors, segments, percentile)
                stages.append("semantic")
        stages += [structural] if structural == "recursive" else [structural, "recursive"]
        starts = [u["start_at"] for u in rows]
        for stage in stages:
            drafts, wrong = _drafted(stage, text, rows, marks, config, nested)
            if not wrong:
                cut = [
                    {"start_at": a, "end_at": b, "context": c, "parent_index": p, "content": text[a:b] if content else None, "blocks": _traced(rows, a, b, starts)}
                    for a, b, c, p in drafts
                ]
                return {"doc_id": doc_id, "strategy": stage, "reasons": reasons, "drafts": cut}
            reasons.append({"strategy": stage, "reason": ";".join(wrong)})
        return {"doc_id": doc_id, "strategy": None, "reasons": reasons, "drafts": []}

    def together(docs: list[tuple]) -> list[dict]:
        """Some documents, embedded in common calls."""
        if requested != "semantic" or problem:
            return [planned(*d, None, None) for d in docs]
        made = [window_texts(d[2], window) for d in docs]
        vectors, at, out = called(embed, [t for texts, _ in made for t in texts]), 0, []
        for d, (texts, segments) in zip(docs, made):
            out.append(planned(*d, vectors[at : at + len(texts)], segments))
            at += len(texts)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for at in range(batch.num_rows):  # some documents at a time, so memory is that of the largest
                held.append((batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), unit_rows(batch.column(2)[at])))
                n += len(held[-1][2])
                if n >= AT_ONCE or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_pylist(together(held), schema=out_schema)
                    held, n = [], 0

    return ready.select("doc_id", "structural", "units").mapInArrow(run, typed)


def chunk_plan(
    blocks: DataFrame, config: Config = Config(), requested: str = "auto", nested: bool = False, embed: Embed | None = None,
    signature: str = "", window: int = 3, percentile: float = 90.0, content: bool = True,
) -> DataFrame:
    """doc_id, strategy, reasons, chunk_index, chunk_type, parent_index, start_at,
    end_at, context, content, blocks: the chunks of every document by the first
    strategy whose chunks have no issues.

    The strategies are, in turn: ``semantic`` if that is requested, the requested or
    the document's structural one, and ``recursive``.  A document goes on to a stage
    only if the one before gave it up, and ``reasons`` (strategy, reason) says why.
    One that all give up has one row without a strategy; one without text has no
    source and no row.  ``content`` may be left out, as offsets say where it stands
    in ``sources``.

    Blocks meet once, by document; units, groups and the stages follow in that place,
    so texts are shuffled once whatever the stages."""
    if requested not in ("auto", "semantic", *STRATEGIES):
        raise ValueError(f"there is no strategy {requested}")
    units = with_strategy(atomic_units(blocks))
    if requested not in ("auto", "semantic"):
        units = units.withColumn("structural", F.lit(requested))
    fields = ("unit", "start_at", "end_at", "block_index", "block_start", "kind", "hard", "title", "section", "context", "content")
    ready = grouped(units).groupBy("doc_id", "structural").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("units"))
    dimension = dimension_of(signature)
    problem = (
        "missing_embedding_callable" if embed is None
        else "missing_model_signature" if not signature.strip()
        else None if dimension else "invalid_model_signature_dimension"
    )
    chunks = _planned(ready, config, nested, problem, embed, dimension, window, percentile, requested, content)
    out = chunks.select("doc_id", "strategy", "reasons", F.posexplode_outer("drafts").alias("chunk_index", "c"))
    kind = F.when(F.col("c").isNotNull(), F.when(F.lit(nested) & F.col("c.parent_index").isNull(), "parent_text").otherwise("text"))
    return out.select("doc_id", "strategy", "reasons", "chunk_index", kind.alias("chunk_type"), "c.parent_index", "c.start_at", "c.end_at", "c.context", "c.content", "c.blocks")
