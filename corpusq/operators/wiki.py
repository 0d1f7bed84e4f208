"""Pages made from documents: contributions, retractions, indexes, cross links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusq.functions.text import candidate_names, view_slug
from corpusq.operators.catalog import contains
from corpusq.tables import positions


def contributions(docs: DataFrame, least_length: int = 4) -> DataFrame:
    """(slug, name, doc_id) of the names that documents mention."""
    names = docs.select("doc_id", F.explode(candidate_names(F.col("text"))).alias("name"))
    kept = names.where(F.length("name") >= least_length)
    return kept.select(F.concat(F.lit("entity/"), view_slug(F.col("name"))).alias("slug"), "name", "doc_id")


def reduce_by_slug(parts: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(slug, title, n_docs, first_doc, version): contributions of a slug merged,
    its title the first name in order, its version one higher than before."""
    merged = parts.groupBy("slug").agg(
        F.min("name").alias("title"),
        F.count_distinct("doc_id").alias("n_docs"),
        F.min("doc_id").alias("first_doc"),
    )
    if versions is None:
        return merged.withColumn("version", F.lit(1))
    old = versions.select("slug", F.col("version").alias("old"))
    return merged.join(old, "slug", "left").withColumn("version", F.coalesce(F.col("old"), F.lit(0)) + 1).drop("old")


def retractions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, slug) that a document no longer contributes to."""
    return old.select("doc_id", "slug").distinct().join(new.select("doc_id", "slug").distinct(), ["doc_id", "slug"], "left_anti")


def citations(names: DataFrame, chunks: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, name, chunk_index): first chunks of the document that hold the
    name, or its first chunk where none does.  Names and chunks of a document meet in
    one row; all names are looked for in one pass over each chunk.  A null name is
    none; a document without chunks, and an empty name, cite nothing."""
    member = F.struct("chunk_index", F.coalesce("content", F.lit("")).alias("content"))
    lists = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(member)).alias("chunks"))
    wanted = names.where(F.length("name") > 0).groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    kind, index = (chunks.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_index"))
    typed = StructType.fromDDL(f"doc_id {kind}, name string, chunk_index {index}")
    out_schema = to_arrow_schema(typed)

    def cited(own: list[str], rows: list[dict]) -> list[tuple[str, int]]:
        machine = ahocorasick.Automaton()
        for name in own:
            machine.add_word(name, name)
        machine.make_automaton()
        places: dict[str, list[int]] = {name: [] for name in own}
        for row in rows:
            for name in {name for _, name in machine.iter(row["content"])}:
                if len(places[name]) < most:
                    places[name].append(row["chunk_index"])
        return [(name, at) for name, held in places.items() for at in held or [rows[0]["chunk_index"]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a document at a time, so memory is that of one
                doc_id, own, rows = (batch.column(c)[k].as_py() for c in range(3))
                found = [{"doc_id": doc_id, "name": name, "chunk_index": at} for name, at in cited(own, rows)]
                yield pa.RecordBatch.from_pylist(found, schema=out_schema)

    return wanted.join(lists, "doc_id").select("doc_id", "names", "chunks").mapInArrow(run, typed)


def visible(pages: DataFrame) -> DataFrame:
    """Pages that are not deleted and no index."""
    return pages.where("not deleted and page_type <> 'index' and slug <> 'index'")


def search(pages: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Visible pages whose title or content holds a text, by title, up to 200."""
    found = visible(pages).where(contains("title", text) | contains("content", text)) if text else visible(pages)
    return found.orderBy("title", "page_id").limit(min(max(limit, 1), 200))


def grouped_index(pages: DataFrame) -> DataFrame:
    """(kind, slug, position, line): the index as a row for each slug with its
    place in the list of its kind, which may be of any length."""
    line = F.concat(F.lit("- [["), F.col("slug"), F.lit("]]"))
    return positions(pages.select("kind", "slug"), "kind", "slug").withColumn("line", line)


def inject_links(text: str, names: list[tuple[str, str]], most: int = 80) -> str:
    """First mention of each name becomes a link to its slug, longest names
    first; headings, code fences and what is linked already stay as they are."""
    lines, fenced = text.split("\n"), False
    open_lines = []
    for line in lines:
        if line.lstrip().startswith("```"):
            fenced = not fenced
            open_lines.append(False)
        else:
            open_lines.append(not fenced and not line.lstrip().startswith("#"))
    low = [line.lower() for line in lines]
    used = 0
    for name, slug in sorted(names, key=lambda n: (-len(n[0]), n[0])):
        if used >= most or f"[[{slug}" in text:
            continue
        for i, line in enumerate(lines):
            if not open_lines[i]:
                continue
            begin = _first_mention(line, low[i], name)
            if begin >= 0:
                end = begin + len(name)
                lines[i] = f"{line[:begin]}[[{slug}|{line[begin:end]}]]{line[end:]}"
                low[i] = lines[i].lower()
                used += 1
                break
    return "\n".join(lines)


_LINK = re.compile(r"\[\[[^\]]*\]\]")
#: Signs for which ``lower`` may say less than a search without case.
_OTHER = re.compile("[^\x00-\xb4\xb6-\xff]")


def _first_mention(line: str, low: str, name: str) -> int:
    """Where a name first stands in a line as a word, without case and outside links; -1 if nowhere."""
    if not name or "[" in name or "]" in name or _OTHER.search(name) or _OTHER.search(line):
        pattern = re.compile(r"(\[\[[^\]]*\]\])|(?<![\w])(" + re.escape(name) + r")(?![\w])", re.IGNORECASE)
        return next((m.start() for m in pattern.finditer(line) if m[2]), -1)
    sought, size, links = name.lower(), len(name), None
    at = low.find(sought)
    while at >= 0:
        around = line[max(at - 1, 0) : at] + line[at + size : at + size + 1]
        if not any(c.isalnum() or c == "_" for c in around):
            links = [m.span() for m in _LINK.finditer(line)] if links is None else links
            if not any(a <= at < b for a, b in links):
                return at
        at = low.find(sought, at + 1)
    return -1


def cross_link(pages: DataFrame, most: int = 80) -> DataFrame:
    """Pages (slug, text, names: array of struct(name, slug)) with links put in."""

    @pandas_udf("string")
    def link(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series(
            [inject_links(t, [(n["name"], n["slug"]) for n in (own if own is not None else [])], most) for t, own in zip(texts, names)]
        )

    return pages.withColumn("text", link("text", "names"))


def citation_aliases(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases such as [c001] that stand in the page of their slug."""
    return pages.join(aliases, "slug").where(F.col("text").contains(F.concat(F.lit("["), "alias", F.lit("]"))))
