"""Mutations and sinks: tables are immutable, a change is a new table.

A batch replaces rows by key through an anti-join and a union; a persisted
table is partitioned, and only the partitions that a batch touches are
rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of equal keys replaced and new ones added."""
    kept = table.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes)


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def stale(index: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Index rows whose source is no longer there."""
    return index.join(live.select(key).distinct(), key, "left_anti")


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set where a condition holds (null counts as not)."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def soft_delete(table: DataFrame, gone: DataFrame, keys: list[str], now: str) -> DataFrame:
    """Rows of the keys marked with a time of deletion."""
    marked = gone.select(*keys).distinct().withColumn("__gone", F.lit(True))
    out = table.join(marked, keys, "left")
    at = F.when(F.col("__gone") & F.col("deleted_at").isNull(), F.to_timestamp_ntz(F.lit(now))).otherwise(F.col("deleted_at"))
    return out.withColumn("deleted_at", at).drop("__gone")


def orphan_parents(chunks: DataFrame) -> DataFrame:
    """Parents without an enabled child."""
    children = chunks.where("chunk_type = 'text' and is_enabled").select("doc_id", "parent_index").distinct()
    return chunks.where("chunk_type = 'parent_text'").join(children, ["doc_id", "parent_index"], "left_anti")


def write_partitioned(table: DataFrame, path: str, by: list[str]) -> None:
    """Write, replacing only the partitions that the table has rows of."""
    spread = table.repartition(*by)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def index_state(signature: str, stored: str | None, n_indexed: int) -> str:
    """ready when the stored model signature is the current one and rows are there."""
    return "ready" if stored == signature and n_indexed > 0 else "needs_rebuild"


def link_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with the id of their parent: parents first, then children that point at them."""
    ids = parents.select("doc_id", "parent_index", F.col("chunk_id").alias("context_parent_id"))
    return children.join(ids, ["doc_id", "parent_index"], "left")


def chunk_id(doc_id: Column, strategy: Column, chunk_type: Column, start: Column, end: Column) -> Column:
    """Identity that reruns repeat."""
    parts = [doc_id.cast("string"), strategy, chunk_type, start.cast("string"), end.cast("string")]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
