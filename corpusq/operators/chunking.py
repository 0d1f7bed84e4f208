"""Chunking: documents to chunks with exact offsets.

A document is cut on its own, so chunking is a map over rows in Arrow batches:
no shuffle, and memory of one batch.  Where a cut depends only on neighbours
(breadcrumbs, runs, distances) it is a window over the units of a document.
Offsets count code points of the document text; a chunk's text is exactly the
text between its offsets unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusq.functions.text import tokens_for_chunks
from corpusq.functions.vectors import cosine_distance

Span = tuple[int, int]

#: Characters of the documents whose chunks leave a task in one batch.
BATCH_CHARS = 1_000_000


@dataclass(frozen=True)
class Config:
    """Sizes in characters; checked and held within their ranges."""

    size: int = 512
    overlap: int = 80
    parent_size: int = 2048
    child_size: int = 384
    child_overlap: int = 64
    max_tokens: int = 2048

    def __post_init__(self):
        if not 64 <= self.size <= 8192 or not 64 <= self.child_size <= 8192:
            raise ValueError("chunk sizes lie between 64 and 8192")
        if self.parent_size < self.child_size:
            raise ValueError("a parent is not smaller than its children")
        for overlap, size in ((self.overlap, self.size), (self.child_overlap, self.child_size)):
            if not 0 <= overlap <= size // 2:
                raise ValueError("an overlap is at most half of the size")


_BOUNDS = {"size": (64, 8192), "child_size": (64, 8192), "parent_size": (64, 8192), "max_tokens": (1, 8192)}


def persisted(raw: dict) -> tuple[Config, bool]:
    """A stored configuration brought within its bounds, and whether it needed
    no change: what is no whole number becomes the default, sizes are clamped, a
    parent is made as large as a child, an overlap is cut to half of its size."""
    values, same = {}, True
    for name, default in vars(Config()).items():
        value = raw.get(name, default)
        try:
            if isinstance(value, bool):
                raise ValueError
            number = int(value)
        except (TypeError, ValueError, OverflowError):
            number, same = default, False
        low, high = _BOUNDS.get(name, (0, number if number > 0 else 0))
        values[name] = min(max(number, low), high)
        same = same and values[name] == number
    limits = {"parent_size": ("child_size", 1, max), "overlap": ("size", 2, min), "child_overlap": ("child_size", 2, min)}
    for name, (other, part, choose) in limits.items():
        held = choose(values[name], values[other] // part)
        same, values[name] = same and held == values[name], held
    return Config(**values), same


def fixed_windows(text: str, size: int = 512, overlap: int = 80) -> list[Span]:
    """Windows of about ``size`` that end after a line or a full stop where one
    lies in their last two thirds; a short tail joins the window before it."""
    n, third = len(text), size // 3
    tail = max(overlap, min(128, size // 4))
    spans, start = [], 0
    while start < n:
        end = min(start + size, n)
        mark = max(text.rfind(c, start, end) for c in "\n。")
        end = mark + 1 if mark > start + third else end
        end = n if n - end < tail else end
        spans.append((start, end))
        start = n if end == n else max(end - overlap, start + 1)
    return [(a, b) for a, b in spans if text[a:b].strip()]


_PROTECTED = re.compile(r"```.*?(?:```|\Z)|\$\$.*?\$\$|\$[^$\n]+\$|!?\[[^\]\n]*\]\([^)\n]*\)", re.DOTALL)
# Preferred places to cut, best first; the cut is after the match.
_CUTS = [re.compile(p) for p in (r"\n[ \t]*\n", r"\n", r"[.!?。！？；](?=\s|$)|[。！？；]", r"\s")]


def protected_ranges(text: str) -> list[Span]:
    """Code fences, formulas, links and images, as disjoint ranges."""
    return merge_spans([m.span() for m in _PROTECTED.finditer(text)])


def merge_spans(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def recursive_spans(text: str, begin: int, end: int, size: int, overlap: int, shielded: list[Span] | None = None) -> list[Span]:
    """Cuts of text[begin:end] at the best mark in the second half of each
    piece, never inside a shielded range (one longer than a piece stays whole)."""
    shielded = protected_ranges(text) if shielded is None else shielded
    inside = lambda at: next(((a, b) for a, b in shielded if a < at < b), None)
    spans, start = [], begin
    while end - start > size:
        stop = start + size
        for pattern in _CUTS:
            marks = [m.end() for m in pattern.finditer(text, start + size // 2, stop) if not inside(m.end())]
            if marks:
                stop = marks[-1]
                break
        else:
            held = inside(stop)
            if held:
                stop = held[0] if held[0] > start else min(held[1], end)
        spans.append((start, stop))
        following = stop - overlap if stop - overlap > start else stop
        held = inside(following)
        start = held[0] if held and held[0] > start else following if not held else stop
    if start < end:
        spans.append((start, end))
    return spans


@dataclass(frozen=True)
class Unit:
    """An atomic piece of a document: its span, heading path and layout key."""

    start: int
    end: int
    path: tuple[str, ...] = ()
    key: str = ""
    hard: bool = False  # nothing is packed across its start


_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*$")


def units_of(text: str) -> list[Unit]:
    """Paragraphs with the headings above them; a heading starts a new unit."""
    units: list[Unit] = []
    path: list[tuple[int, str]] = []
    fences = [s for s in protected_ranges(text) if text.startswith("```", s[0])]
    start, at = None, 0
    for line in text.splitlines(keepends=True):
        fenced = any(a < at < b for a, b in fences)
        heading = None if fenced else _HEADING.match(line.rstrip("\n"))
        if start is not None and (heading or (not line.strip() and not fenced)):
            units.append(Unit(start, at, tuple(t for _, t in path)))
            start = None
        if heading:
            level = len(heading[1])
            path = [p for p in path if p[0] < level] + [(level, heading[2].strip())]
            units.append(Unit(at, at + len(line), tuple(t for _, t in path), hard=True))
        elif line.strip() and start is None:
            start = at
        at += len(line)
    if start is not None:
        units.append(Unit(start, at, tuple(t for _, t in path)))
    return units


def pack(text: str, units: list[Unit], size: int, max_tokens: int) -> list[tuple[int, int, tuple[str, ...]]]:
    """Consecutive units in pieces of at most ``size`` characters and
    ``max_tokens``; a larger unit is cut recursively."""
    out: list[tuple[int, int, tuple[str, ...]]] = []
    current: list[Unit] = []

    def close():
        if current:
            out.append((current[0].start, current[-1].end, current[0].path))
            current.clear()

    for unit in units:
        if unit.end - unit.start > size:
            close()
            out += [(a, b, unit.path) for a, b in recursive_spans(text, unit.start, unit.end, size, 0)]
            continue
        if current:
            n = unit.end - current[0].start
            new_group = unit.hard or unit.path[: len(current[0].path)] != current[0].path or unit.key != current[0].key
            if new_group or n > size or (n + 3) // 4 > max_tokens:
                close()
        current.append(unit)
    close()
    return out


_PAGE = re.compile(r"^(?:Slide|Page) \d+\b.*$", re.MULTILINE)


def layout_units(text: str) -> list[Unit]:
    """Units keyed by the slide or page line above them."""
    marks = [(m.start(), m.group().strip()) for m in _PAGE.finditer(text)]
    units = []
    for u in units_of(text):
        above = [name for at, name in marks if at <= u.start]
        units.append(Unit(u.start, u.end, (above[-1],) if above else (), above[-1] if above else "Document", u.hard))
    return units


def strategy_of(text: str) -> str:
    """heading, layout or recursive, by what the text shows."""
    if any(u.hard for u in units_of(text)):
        return "heading"
    return "layout" if _PAGE.search(text) else "recursive"


def structural_spans(text: str, config: Config, strategy: str = "auto") -> list[tuple[int, int, str, str]]:
    """(start, end, context header, strategy) of a document.  When a structural
    cut gives nothing, the recursive one stands in."""
    chosen = strategy_of(text) if strategy == "auto" else strategy
    if chosen == "fixed":
        return [(a, b, "", chosen) for a, b in fixed_windows(text, config.size, config.overlap)]
    if chosen in ("heading", "layout"):
        units = units_of(text) if chosen == "heading" else layout_units(text)
        pieces = pack(text, units, config.size, config.max_tokens)
        if pieces:
            return [(a, b, " > ".join(path), chosen) for a, b, path in pieces]
        chosen = "recursive"
    return [(a, b, "", chosen) for a, b in recursive_spans(text, 0, len(text), config.size, config.overlap) if text[a:b].strip()]


def _map_chunks(docs: DataFrame, kernel: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    typed = StructType.fromDDL(f"doc_id {kind}, chunk_index int, {columns}")
    out_schema = to_arrow_schema(typed)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns):  # a document at a time, so memory is that of a batch and of what goes out
                own = text.as_py() or ""
                rows += [(doc_id.as_py(), i, *chunk) for i, chunk in enumerate(kernel(own))]
                size += len(own)
                if rows and size >= BATCH_CHARS:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return docs.select("doc_id", "text").mapInArrow(run, typed)


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 80) -> DataFrame:
    """doc_id, chunk_index, start_at, end_at, content (stripped)."""
    return _map_chunks(
        docs,
        lambda t: [(a, b, t[a:b].strip()) for a, b in fixed_windows(t, size, overlap)],
        "start_at int, end_at int, content string",
    )


def structural_chunks(docs: DataFrame, config: Config = Config(), strategy: str = "auto") -> DataFrame:
    """doc_id, chunk_index, start_at, end_at, context_header, strategy, content."""
    return _map_chunks(
        docs,
        lambda t: [(a, b, h, s, t[a:b]) for a, b, h, s in structural_spans(t, config, strategy)],
        "start_at int, end_at int, context_header string, strategy string, content string",
    )


def hierarchy(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Parents without overlap and children inside each: chunk_type
    (parent_text or text), parent_index of a child, offsets, content."""

    def kernel(text: str) -> list[tuple]:
        out = []
        parents = [(a, b) for a, b in recursive_spans(text, 0, len(text), config.parent_size, 0) if text[a:b].strip()]
        for p, (a, b) in enumerate(parents):
            out.append(("parent_text", p, a, b, text[a:b]))
            out += [
                ("text", p, c, d, text[c:d])
                for c, d in recursive_spans(text, a, b, config.child_size, config.child_overlap)
                if text[c:d].strip()
            ]
        return out

    return _map_chunks(docs, kernel, "chunk_type string, parent_index int, start_at int, end_at int, content string")


def size_stats(chunks: DataFrame, keys: list[str] | None = None, counter: Callable[[Column], Column] = tokens_for_chunks) -> DataFrame:
    """Count, total, least, most and mean of characters and of tokens by a counter; zeros without rows."""
    n = F.length("content")
    tokens = counter(F.col("content"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    figures = [F.count(F.lit(1)).alias("n_chunks")]
    for name, value in (("chars", n), ("tokens", tokens)):
        figures += [
            zero(F.sum(value)).cast("long").alias(f"{name}_total"),
            zero(F.min(value)).cast("long").alias(f"{name}_min"),
            zero(F.max(value)).cast("long").alias(f"{name}_max"),
            F.round(zero(F.avg(value)), 4).alias(f"{name}_mean"),
        ]
    return chunks.groupBy(*(keys or [])).agg(*figures)


def violations(
    chunks: DataFrame, docs: DataFrame, max_tokens: int = 2048, counter: Callable[[Column], Column] = tokens_for_chunks
) -> DataFrame:
    """(doc_id, rule, n): chunks that are empty, out of order, not their text's
    substring or too long by the counter, and documents with uncovered text."""
    w = W.partitionBy("doc_id").orderBy("chunk_index")
    placed = chunks.withColumn("before_start", F.lag("start_at").over(w)).withColumn(
        "reach", F.max("end_at").over(w.rowsBetween(W.unboundedPreceding, -1))
    )
    full = placed.join(docs.select("doc_id", "text"), "doc_id")
    gap = F.expr("substring(text, coalesce(reach, 0) + 1, start_at - coalesce(reach, 0))")
    rules = {
        "empty": F.length(F.trim("content")) == 0,
        "order": F.coalesce(F.col("start_at") <= F.col("before_start"), F.lit(False)),
        "substring": F.expr("trim(BOTH ' \n\t\r' FROM substring(text, start_at + 1, end_at - start_at)) <> trim(BOTH ' \n\t\r' FROM content)"),
        "tokens": counter(F.col("content")) > max_tokens,
        "uncovered": (F.col("start_at") > F.coalesce("reach", F.lit(0))) & (F.length(F.regexp_replace(gap, r"\s", "")) > 0),
    }
    names = F.array_compact(F.array(*[F.when(bad, F.lit(r)) for r, bad in rules.items()]))
    return full.select("doc_id", F.explode(names).alias("rule")).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def tiny_documents(chunks: DataFrame, chars: int = 64) -> DataFrame:
    """Documents of four chunks or more of which over half are tiny."""
    n_tiny = F.count(F.when(F.length("content") < chars, 1))
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), n_tiny.alias("n_tiny"))
    return counts.where((F.col("n") >= 4) & (2 * F.col("n_tiny") > F.col("n")))


def hierarchy_violations(both: DataFrame) -> DataFrame:
    """Children that do not lie inside their parent."""
    parents = both.where("chunk_type = 'parent_text'").select(
        "doc_id", "parent_index", F.col("start_at").alias("p_start"), F.col("end_at").alias("p_end")
    )
    children = both.where("chunk_type = 'text'")
    joined = children.join(parents, ["doc_id", "parent_index"], "left")
    return joined.where("p_start is null or start_at < p_start or end_at > p_end")


def neighbour_links(chunks: DataFrame) -> DataFrame:
    """Index of the chunk before and after, in a document."""
    w = W.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("prev_index", F.lag("chunk_index").over(w)).withColumn("next_index", F.lead("chunk_index").over(w))


def sliding_text(units: DataFrame, window: int, by: str = "segment", order: str = "pos") -> DataFrame:
    """Each unit's text with the next ``window`` - 1 of its segment, by lines."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(0, window - 1)
    return units.withColumn("window_text", F.array_join(F.collect_list("text").over(w), "\n"))


def consecutive_distance(units: DataFrame, vector: str = "embedding", by: str = "segment", order: str = "pos") -> DataFrame:
    """Cosine distance of a unit's vector to the one before it in its segment."""
    w = W.partitionBy(by).orderBy(order)
    return units.withColumn("distance", cosine_distance(F.lag(vector).over(w), F.col(vector)))


def breakpoints(distances: DataFrame, percentile: float = 90.0, by: str = "segment", order: str = "pos") -> DataFrame:
    """Units whose distance reaches the percentile (linear interpolation) of its segment."""
    limits = distances.groupBy(by).agg(F.percentile("distance", percentile / 100).alias("limit"))
    return distances.join(limits, by).where(F.col("distance") >= F.col("limit")).select(by, order, "distance", "limit")


def consolidate(breaks: list[int], hard: list[int], n_units: int, least: int) -> list[int]:
    """Breaks that leave at least ``least`` units between them; hard ones always stay."""
    kept: list[int] = []
    for b in sorted(set(breaks) | set(hard)):
        if b <= 0 or b >= n_units:
            continue
        if b in hard:
            while kept and kept[-1] not in hard and b - kept[-1] < least:
                kept.pop()
            kept.append(b)
        elif b - (kept[-1] if kept else 0) >= least:
            kept.append(b)
    return kept


def embedded(units: DataFrame, embed: Callable[[pd.Series], pd.Series], signature: str) -> DataFrame:
    """Units (with text) and the vector that ``embed``, a function from a batch of
    texts to one of vectors, gives each; ``model_signature`` names the model."""
    vector = pandas_udf(embed, "array<double>")
    return units.withColumn("embedding", vector("text")).withColumn("model_signature", F.lit(signature))


def semantic_segments(units: DataFrame, percentile: float = 90.0, least: int = 3) -> DataFrame:
    """(segment, start_at, end_at): the units (segment, pos from 0, embedding and
    where wanted hard) of a segment cut at large distances and at hard boundaries,
    in pieces of ``least`` units or more.  A segment is a document's units."""
    hard = F.col("hard") if "hard" in units.columns else F.lit(False)
    far = breakpoints(consecutive_distance(units), percentile).select("segment", "pos", F.lit(True).alias("far"))
    marked = units.select("segment", "pos", hard.alias("hard")).join(far, ["segment", "pos"], "left")
    kind = units.schema["segment"].dataType.simpleString()

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        n = len(frame)
        breaks = [int(p) for p, x in zip(frame["pos"], frame["far"]) if x is True]
        kept = consolidate(breaks, [int(p) for p, x in zip(frame["pos"], frame["hard"]) if x], n, least)
        starts = [0, *kept]
        return pd.DataFrame({"segment": [frame["segment"].iloc[0]] * len(starts), "start_at": starts, "end_at": [*kept, n]})

    return marked.groupBy("segment").applyInPandas(cut, f"segment {kind}, start_at long, end_at long")


def semantic_cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Units whose vectors the cache lacks under the same content, model, version, window and percentile."""
    return wanted.join(cache, ["content_hash", "model_signature", "version", "window", "percentile"], "left_anti")


def needs_reindex(effective: DataFrame, current: DataFrame) -> DataFrame:
    """kb_id whose last effective configuration differs from the current one."""
    a = effective.select("kb_id", F.col("config").alias("was"))
    return current.join(a, "kb_id", "left").where(~F.col("config").eqNullSafe(F.col("was"))).select("kb_id", "was", "config")


def records_with_header(rows: DataFrame, by: str = "sheet", order: str = "row") -> DataFrame:
    """Non-empty rows with the header of their sheet (its first non-empty row)
    and the first and last filled column."""
    filled = rows.where(F.exists("cells", lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0))
    w = W.partitionBy(by).orderBy(order)
    used = F.filter(F.sequence(F.lit(1), F.size("cells")), lambda i: F.length(F.trim(F.element_at("cells", i))) > 0)
    out = filled.withColumn("header", F.first("cells").over(w)).withColumn("nth", F.row_number().over(w))
    return out.where("nth > 1").withColumn("first_column", F.array_min(used)).withColumn("last_column", F.array_max(used)).drop("nth")


def runs(rows: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """Number of the run of equal keys that each row belongs to."""
    w = W.partitionBy(by).orderBy(order)
    change = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("run", F.sum(change).over(w.rowsBetween(W.unboundedPreceding, 0)))


def breadcrumbs(headings: DataFrame, levels: int = 6, by: str = "doc_id", order: str = "pos") -> DataFrame:
    """Path of the open headings at each row: the last of each level since the
    last of a higher one.  ``headings`` has level (null for text) and title."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    at = [F.max(F.when(F.col("level") == k, F.struct(order, "title"))).over(w) for k in range(1, levels + 1)]
    out = headings
    for k, c in enumerate(at, 1):
        out = out.withColumn(f"__h{k}", c)
    parts = []
    for k in range(1, levels + 1):
        higher = [F.col(f"__h{j}.{order}") for j in range(1, k)]
        open_ = F.col(f"__h{k}").isNotNull()
        for h in higher:
            open_ = open_ & (h.isNull() | (h < F.col(f"__h{k}.{order}")))
        parts.append(F.when(open_, F.col(f"__h{k}.title")))
    path = F.array_join(F.array_compact(F.array(*parts)), " > ")
    return out.withColumn("path", path).drop(*[f"__h{k}" for k in range(1, levels + 1)])
