"""Match ranges: where hits stand in the text that a query gets, and rows cut to a cap.

An interval is a struct with two positions, the second exclusive; the algebra
(merge, clip to a window, shift) works on arrays of them as column expressions, so
rows stay where they are.  Cutting a row that is cut already changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "max_context_chars"
WINDOW_TYPE = (
    "struct<parent_start_at:long,parent_end_at:long,source_start_at:long,source_end_at:long,rendered_start_at:long,"
    "rendered_end_at:long,item_start_at:long,item_end_at:long,clipped:boolean,clip_reason:string,max_context_chars:long>"
)
RANGE_TYPE = (
    "struct<child_id:{id},start_at:long,end_at:long,rendered_start_at:long,rendered_end_at:long,"
    "context_start_at:long,context_end_at:long,visible:boolean,clipped:boolean>"
)
SPANS = "array<struct<a:long,b:long>>"


def spans(intervals: Column, start: str, end: str) -> Column:
    """Intervals as (a, b), those without a position left out."""
    whole = F.filter(intervals, lambda x: x[start].isNotNull() & x[end].isNotNull())
    return F.transform(whole, lambda x: F.struct(x[start].cast("long").alias("a"), x[end].cast("long").alias("b")))


def merged(intervals: Column) -> Column:
    """Sorted disjoint intervals that cover the same positions; empty ones go."""
    ordered = F.array_sort(F.filter(intervals, lambda x: x["a"] < x["b"]))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= x["a"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(ordered, F.array().cast(SPANS), add)


def clipped(intervals: Column, start: Column, end: Column) -> Column:
    """What of the intervals lies in a window."""
    held = F.transform(intervals, lambda x: F.struct(F.greatest(x["a"], start).alias("a"), F.least(x["b"], end).alias("b")))
    return F.filter(held, lambda x: x["a"] < x["b"])


def shifted(intervals: Column, by: Column) -> Column:
    return F.transform(intervals, lambda x: F.struct((x["a"] + by).alias("a"), (x["b"] + by).alias("b")))


def window_of(total: Column, cap: int, evidence: Column) -> tuple[Column, Column]:
    """(from, to) of a window of at most ``cap``: centred on all evidence where that
    fits, else on the first piece or at its start; held inside the text."""
    cap = max(0, cap)
    seen = F.filter(evidence, lambda x: x["b"] > x["a"])
    low, high = F.array_min(F.transform(seen, lambda x: x["a"])), F.array_max(F.transform(seen, lambda x: x["b"]))
    first = F.try_element_at(seen, F.lit(1))
    centred = lambda a, b: a - F.floor((F.lit(cap) - (b - a)) / 2)
    begin = (
        F.when(low.isNull(), F.lit(0))
        .when(high - low <= cap, centred(low, high))
        .when(first["b"] - first["a"] >= cap, first["a"])
        .otherwise(centred(first["a"], first["b"]))
    )
    held = F.greatest(F.lit(0), F.least(begin, total - cap)).cast("long")
    start = F.when((total <= cap) | F.lit(cap == 0), F.lit(0)).otherwise(held).cast("long")
    return start, F.when(total <= cap, total).otherwise(start + cap).cast("long")


def match_range(child_id: Column, start: Column, end: Column, rendered_start: Column, rendered_end: Column, window_start: Column, window_end: Column) -> Column:
    """A hit's source range, where it stands in the rendered text and in the window
    of it, and whether the window shows it, whole or in part."""
    a, b = F.greatest(rendered_start, window_start), F.least(rendered_end, window_end)
    visible = b > a
    return F.struct(
        child_id.alias("child_id"), start.cast("long").alias("start_at"), end.cast("long").alias("end_at"),
        rendered_start.cast("long").alias("rendered_start_at"), rendered_end.cast("long").alias("rendered_end_at"),
        F.when(visible, a - window_start).cast("long").alias("context_start_at"),
        F.when(visible, b - window_start).cast("long").alias("context_end_at"),
        visible.alias("visible"), (~visible | (a > rendered_start) | (b < rendered_end)).alias("clipped"),
    )


def context_window(segments: Column, parent_start: Column, parent_end: Column, start: Column, end: Column, total: Column, cap: int) -> Column:
    """What a window of a parent's rendered text shows of its source.  ``segments``
    maps source to rendered spans: (source_start, source_end, rendered_start,
    rendered_end, edited); an edited one that shows at all counts whole."""
    shown = F.filter(segments, lambda s: (s["rendered_start"] < end) & (s["rendered_end"] > start))

    def source(s: Column) -> Column:
        exact = ~s["edited"] & (s["rendered_end"] - s["rendered_start"] == s["source_end"] - s["source_start"])
        shift = s["source_start"] - s["rendered_start"]
        return F.struct(
            F.when(exact, shift + F.greatest(start, s["rendered_start"])).otherwise(s["source_start"]).cast("long").alias("a"),
            F.when(exact, shift + F.least(end, s["rendered_end"])).otherwise(s["source_end"]).cast("long").alias("b"),
        )

    ranges = F.transform(shown, source)
    cut = (start > 0) | (end < total)
    return F.struct(
        parent_start.cast("long").alias("parent_start_at"), parent_end.cast("long").alias("parent_end_at"),
        F.coalesce(F.array_min(F.transform(ranges, lambda x: x["a"])), parent_start).cast("long").alias("source_start_at"),
        F.coalesce(F.array_max(F.transform(ranges, lambda x: x["b"])), parent_start).cast("long").alias("source_end_at"),
        start.cast("long").alias("rendered_start_at"), end.cast("long").alias("rendered_end_at"),
        F.lit(None).cast("long").alias("item_start_at"), F.lit(None).cast("long").alias("item_end_at"),
        cut.alias("clipped"), F.when(cut, REASON).otherwise("").alias("clip_reason"), F.lit(max(0, cap)).cast("long").alias("max_context_chars"),
    ).cast(WINDOW_TYPE)


def capped(rows: DataFrame, cap: int) -> DataFrame:
    """Rows (content, matched_ranges, context_window and the source's start_at and
    end_at, all of which may be null) with at most ``cap`` characters of content.

    The window is placed by the ranges; ranges move with it and say whether they
    still show.  A row that had a window keeps it, narrowed; another gets one of its
    own.  A second cut to the same or a larger cap leaves content and ranges alone."""
    cap = max(0, cap)
    content, ranges, old = F.coalesce("content", F.lit("")), F.col("matched_ranges"), F.col("context_window")
    size = F.length(content).cast("long")
    long = size > cap
    start, end = window_of(size, cap, F.coalesce(spans(ranges, "context_start_at", "context_end_at"), F.array().cast(SPANS)))
    start, end = F.when(long, start).otherwise(F.lit(0)).cast("long"), F.when(long, end).otherwise(size)
    placed = rows.withColumns({"__size": size, "__from": start, "__to": end})
    size, start, end = F.col("__size"), F.col("__from"), F.col("__to")
    cut = (start > 0) | (end < size)

    def moved(r: Column) -> Column:
        known = r["context_start_at"].isNotNull() & r["context_end_at"].isNotNull()
        a, b = F.greatest(r["context_start_at"], start), F.least(r["context_end_at"], end)
        visible = b > a
        lost = F.coalesce(r["clipped"], F.lit(False)) | ~visible | (a > r["context_start_at"]) | (b < r["context_end_at"])
        return (
            r.withField("context_start_at", F.when(known & visible, a - start))
            .withField("context_end_at", F.when(known & visible, b - start))
            .withField("visible", F.when(known, visible).otherwise(r["visible"]))
            .withField("clipped", F.when(known, lost).otherwise(r["clipped"]))
        )

    base = F.coalesce(old["rendered_start_at"], F.lit(0))
    last = F.when(F.coalesce(old["rendered_end_at"], F.lit(0)) == 0, base).otherwise(old["rendered_end_at"])
    exact = F.coalesce(old["source_end_at"] - old["source_start_at"] == last - base, F.lit(False))
    clipped_now = F.coalesce(old["clipped"], F.lit(False)) | cut
    narrowed = (
        old.withField("source_start_at", F.when(exact, old["source_start_at"] + start).otherwise(old["source_start_at"]))
        .withField("source_end_at", F.when(exact, old["source_start_at"] + end).otherwise(old["source_end_at"]))
        .withField("rendered_start_at", base + start)
        .withField("rendered_end_at", base + end)
        .withField("item_start_at", old["item_start_at"] + start)
        .withField("item_end_at", old["item_start_at"] + end)
        .withField("clipped", clipped_now)
        .withField("clip_reason", F.when(clipped_now, F.lit(REASON)).otherwise(old["clip_reason"]))
    )
    kept = F.when(long, narrowed).otherwise(old).withField("max_context_chars", F.lit(cap).cast("long"))
    source_start, source_end = F.coalesce("start_at", F.lit(0)).cast("long"), F.coalesce(F.col("end_at").cast("long"), size)
    same = source_end - source_start == size
    fresh = F.struct(
        source_start.alias("parent_start_at"), source_end.alias("parent_end_at"),
        F.when(same, source_start + start).otherwise(source_start).alias("source_start_at"),
        F.when(same, source_start + end).otherwise(source_end).alias("source_end_at"),
        start.alias("rendered_start_at"), end.alias("rendered_end_at"), start.alias("item_start_at"), end.alias("item_end_at"),
        cut.alias("clipped"), F.when(cut, REASON).otherwise("").alias("clip_reason"), F.lit(cap).cast("long").alias("max_context_chars"),
    )
    text = F.coalesce("content", F.lit(""))
    return placed.withColumns(
        {
            "content": F.when(cut, text.substr(start.cast("int") + 1, (end - start).cast("int"))).otherwise(text),
            "matched_ranges": F.when(long, F.transform(ranges, moved)).otherwise(ranges),
            "context_window": F.when(old.isNotNull(), kept).otherwise(fresh),
        }
    ).drop("__size", "__from", "__to")
