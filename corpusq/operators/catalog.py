"""Catalog listing: filters, pages, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PER_PAGE = 200


def bounded(value, low: int, high: int, default: int, clamp_default: bool = False) -> int:
    """A whole number within bounds; the default, clamped on request, when it is none."""
    try:
        return min(max(int(value), low), high)
    except (TypeError, ValueError):
        return min(max(default, low), high) if clamp_default else default


def contains(c: str | Column, text: str) -> Column:
    """Case-insensitive substring."""
    return F.lower(c).contains(text.lower())


def document_filter(
    keyword: str | None = None,
    columns: tuple[str, ...] = ("title", "text"),
    tag: str | None = None,
    statuses: list[str] | None = None,
    file_types: list[str] | None = None,
    source: str | None = None,
    start: str | None = None,
    end: str | None = None,
    json_path: tuple[str, str] | None = None,
) -> Column:
    """A predicate from the parts that are given; all true when none is.  The
    keyword is looked for in any of the columns or in a JSON path; a file type
    is a suffix or a document type; the time range includes both ends."""
    parts: list[Column] = []
    if keyword:
        places = [contains(c, keyword) for c in columns]
        if json_path:
            places.append(contains(F.get_json_object(json_path[0], json_path[1]), keyword))
        parts.append(F.coalesce(reduce(lambda a, b: a | b, places), F.lit(False)))
    if tag:
        parts.append(F.col("tag_id") == tag)
    if statuses:
        parts.append(F.col("status").isin(statuses))
    if file_types:
        parts.append(F.col("file_type").isin(file_types) | F.col("type").isin(file_types))
    if source:
        parts.append(F.col("kb_id") == source)
    if start:
        parts.append(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        parts.append(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def consistent_chunks(chunks: DataFrame, documents: DataFrame, bases: DataFrame, tenant: int) -> DataFrame:
    """Chunks (tenant_id, deleted, doc_id, kb_id) of a tenant that are alive and whose
    document (d_tenant, d_deleted, d_kb_id) and base (b_tenant, b_deleted) are alive
    and the tenant's too; chunk and document must name the same base."""
    own = chunks.where((F.col("tenant_id") == tenant) & ~F.col("deleted"))
    of_document = documents.where((F.col("d_tenant") == tenant) & ~F.col("d_deleted")).select("doc_id", "d_kb_id")
    of_base = bases.where((F.col("b_tenant") == tenant) & ~F.col("b_deleted")).select("kb_id")
    return own.join(of_document, "doc_id").where("kb_id = d_kb_id").join(of_base, "kb_id", "left_semi")


def base_filter(creator: str | None = None, user: int | None = None, keyword: str | None = None, kind: str | None = None) -> Column:
    """A predicate on knowledge bases: mine or others', a keyword in name or
    description, a type; wiki also takes bases that have a wiki, and no base is a
    question base."""
    parts: list[Column] = []
    if creator == "mine" and user is not None:
        parts.append(F.col("creator_id") == user)
    elif creator == "others" and user is not None:
        parts.append(F.col("creator_id") != user)
    if keyword:
        parts.append(contains("kb_id", keyword) | contains("description", keyword))
    if kind == "faq":
        parts.append(F.lit(False))
    elif kind:
        parts.append((F.col("type") == "wiki") | F.col("wiki_enabled") if kind == "wiki" else F.col("type") == kind)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def offset_page(df: DataFrame, order: list[Column], page: int | None = 1, page_size: int = 20, offset: int | None = None) -> DataFrame:
    """Rows of one page; ``offset`` counts only when ``page`` is absent."""
    size = bounded(page_size, 1, MOST_PER_PAGE, 20)
    skip = (max(page, 1) - 1) * size if page is not None else max(offset or 0, 0)
    return df.orderBy(*order).offset(skip).limit(size)


def keyset_page(df: DataFrame, key: str, before, tie: str, size: int = 20) -> DataFrame:
    """The newest ``size`` rows before a key, oldest first, with ``has_more``."""
    older = df.where(F.col(key) < F.lit(before)) if before is not None else df
    page = older.orderBy(F.desc(key), F.desc(tie)).limit(size)
    full = page.select(F.count(F.lit(1)).alias("n")).scalar()
    return page.withColumn("has_more", full >= size).orderBy(key, tie)


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, group: str, key: str, values: list[str]) -> DataFrame:
    """One column per fixed value, zero where a group has none."""
    wide = df.groupBy(group).pivot(key, values).agg(F.count(F.lit(1)))
    return wide.select(group, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias(v) for v in values])


def having_more(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Groups of ``least`` rows or more."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in order of a seeded hash of the key: a sample that reruns repeat."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)
