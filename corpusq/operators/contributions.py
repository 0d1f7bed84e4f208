"""What documents contribute to pages: a state that takes deltas.

The state is a table of contributions, one row for each (slug, doc_id), and a table
of pages, one row for each slug.  A page that a third of all documents contribute
to is many rows, never one large map, and a batch of deltas touches the rows of its
own documents; figures of a page are sums over its rows.

Deltas have slug, doc_id, seq and action: ``upsert`` adds a document's contribution
or replaces it, ``retract`` takes it away.  In a batch retractions come first, and
of several additions of a document the last counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.tables import positions, written

#: What a contribution says, and what a page is called after.
PAYLOAD = ("doc_title", "description", "details", "chunks")
HEADER = ("title", "page_type", "summary")
KEY = ["slug", "doc_id"]


class State(NamedTuple):
    """contributions: slug, doc_id, added (order in which documents joined the page)
    and the payload; pages: slug, the header, aliases, version and deleted."""

    contributions: DataFrame
    pages: DataFrame


def empty(deltas: DataFrame) -> State:
    """A state without pages, for deltas of this shape."""
    none = deltas.limit(0)
    rows = none.select(*KEY, F.struct(F.lit(0).cast("long").alias("batch"), F.col("seq").cast("long").alias("seq")).alias("added"), *PAYLOAD)
    pages = none.select("slug", *HEADER, "aliases", F.lit(0).cast("long").alias("version"), F.lit(False).alias("deleted"))
    return State(rows, pages)


def apply(state: State, deltas: DataFrame, batch: int = 1) -> State:
    """The state after a batch of deltas, written.

    A page's header is that of its first addition in the batch where that says
    something; aliases only grow.  A page without contributions is gone, one that
    was deleted takes nothing.  The version is one higher where a contribution,
    the header or the aliases changed, and only there.  Rows without slug or doc_id
    and actions of other names count for nothing."""
    open_pages = state.pages.where("not deleted")
    closed = state.pages.where("deleted").select("slug").distinct()
    valid = deltas.where("slug is not null and doc_id is not null and action in ('upsert', 'retract')")
    valid = written(valid.join(closed, "slug", "left_anti"), "deltas")
    added = valid.where("action = 'upsert'")

    payload = F.struct(*PAYLOAD)
    by_doc = added.groupBy(*KEY).agg(F.max_by(payload, "seq").alias("new"), F.min("seq").cast("long").alias("first"))
    gone = valid.where("action = 'retract'").select(*KEY).distinct().withColumn("retracted", F.lit(True))
    touched = by_doc.join(gone, KEY, "full")
    old = state.contributions.select(*KEY, "added", payload.alias("old"))
    met = written(touched.join(old, KEY, "left"), "touched")
    changed = F.when(F.col("new").isNotNull(), ~F.col("new").eqNullSafe(F.col("old"))).otherwise(F.col("old").isNotNull())
    # a document that is retracted and added again in the batch stands at the end
    stays = F.col("old").isNotNull() & F.col("retracted").isNull()
    place = F.when(stays, F.col("added")).otherwise(F.struct(F.lit(batch).cast("long").alias("batch"), F.col("first").alias("seq")))
    arrived = met.where("new is not null").select(*KEY, place.alias("added"), "new.*")
    kept = state.contributions.join(met.select(*KEY), KEY, "left_anti")
    contributions = written(kept.unionByName(arrived), "contributions")

    header = F.min_by(F.struct(*HEADER), F.struct("seq", "doc_id")).alias("header")
    named = added.groupBy("slug").agg(header, F.count(F.lit(1)).alias("n_added"))
    names = added.select("slug", F.explode("aliases").alias("alias")).where("alias is not null").distinct()
    names = names.groupBy("slug").agg(F.collect_set("alias").alias("more"))
    moved = met.groupBy("slug").agg(F.max(changed).alias("moved"))
    living = contributions.select("slug").distinct().withColumn("lives", F.lit(True))

    before = open_pages.withColumn("had", F.lit(True))
    said = lambda c: F.coalesce(F.when(F.length(F.col(f"header.{c}")) > 0, F.col(f"header.{c}")), F.col(c))
    joined = (
        before.join(named, "slug", "full").join(names, "slug", "left").join(moved, "slug", "left").join(living, "slug")
        .withColumn("all_aliases", F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))))
    )
    fresh = joined.select(
        "slug", *[said(c).alias(c) for c in HEADER], F.col("all_aliases").alias("aliases"),
        F.coalesce("version", F.lit(0)).cast("long").alias("was"),
        (
            F.coalesce("moved", F.lit(False)) | F.col("had").isNull() | (F.size("all_aliases") > F.coalesce(F.size("aliases"), F.lit(0)))
            | ~F.struct(*[said(c) for c in HEADER]).eqNullSafe(F.struct(*HEADER))
        ).alias("raised"),
    )
    version = (F.col("was") + F.col("raised").cast("long")).alias("version")
    pages = fresh.select("slug", *HEADER, "aliases", version, F.lit(False).alias("deleted"))
    return State(contributions, written(pages.unionByName(state.pages.where("deleted")), "pages"))


def figures(state: State) -> DataFrame:
    """slug, the header, aliases, version, n_docs and n_chunks of the pages there are."""
    rows = state.contributions.groupBy("slug").agg(F.count(F.lit(1)).alias("n_docs"))
    chunks = state.contributions.select("slug", F.explode("chunks").alias("chunk")).distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("n_chunks"))
    joined = state.pages.where("not deleted").join(rows, "slug").join(chunks, "slug", "left")
    return joined.select("slug", *HEADER, "aliases", "version", "n_docs", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


def source_refs(state: State) -> DataFrame:
    """slug, position, doc_id, doc_title: a page's documents in the order in which they joined."""
    placed = state.contributions.select("slug", F.struct("added", "doc_id").alias("place_in_page"), "doc_id", "doc_title")
    return positions(placed, "slug", "place_in_page").drop("place_in_page")


def chunk_refs(state: State) -> DataFrame:
    """slug, position, chunk: a page's chunks, each where it comes first."""
    listed = state.contributions.select("slug", "added", "doc_id", F.posexplode("chunks").alias("at", "chunk"))
    first = listed.groupBy("slug", "chunk").agg(F.min(F.struct("added", "doc_id", "at")).alias("place_in_page"))
    return positions(first, "slug", "place_in_page").drop("place_in_page")
