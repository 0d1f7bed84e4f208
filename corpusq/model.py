"""Entities of the retrieval engine and how the given tables become them.

Every adapter is a select over one table, or an equi-join of two, so filters
and column choices of the caller reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
SEARCHABLE_TYPES = ("text", "image_ocr", "image_caption")


#: Tables whose rows are long texts.
TEXTS = ("documents", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  Texts of an input that has no more splits than there are cores are
    dealt evenly, as one row group may be all of a small file; a large input is
    read where its splits are.  Columns and filters still reach the scan."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and table.rdd.getNumPartitions() <= cores:
        return table.repartition(cores)
    return table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kb_id, tenant_id, title, text, deleted, file_hash, n_chars; without labels."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("source").alias("kb_id"),
        F.pmod("doc_id", F.lit(4)).cast("int").alias("tenant_id"),
        F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("title"),
        "text",
        "lang",
        "n_chars",
        (F.pmod("doc_id", F.lit(17)) == 0).alias("deleted"),
    )


def enabled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``enabled``: not labelled toxic."""
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    flagged = toxic.withColumn("is_toxic", F.lit(True))
    joined = documents(spark, sf_dir).join(flagged, "doc_id", "left")
    return joined.withColumn("enabled", F.col("is_toxic").isNull()).drop("is_toxic")


def active() -> Column:
    """Not soft-deleted."""
    return ~F.col("deleted")


def searchable() -> Column:
    """Enabled and not deleted."""
    return F.col("enabled") & ~F.col("deleted")


def scoped(tenant_id: int, kb_ids: list[str] | None = None) -> Column:
    """Searchable within a tenant and, where given, some knowledge bases."""
    own = searchable() & (F.col("tenant_id") == tenant_id)
    return own & F.col("kb_id").isin(kb_ids) if kb_ids else own


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the benchmark items, whole."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, e_start, e_end, n): documents that hold a benchmark text,
    where it first stands, and their length.  Read once for all that follows."""
    from corpusq.operators.lexical import occurrences
    from corpusq.tables import written

    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("string_id"), F.col("text").alias("string"))
    held = occurrences(read(spark, sf_dir, "documents"), items)
    start = F.col("first")
    ends = held.join(items.select("string_id", F.length("string").cast("long").alias("size")), "string_id")
    return written(
        ends.select(
            F.col("string_id").alias("query_id"), "doc_id", start.alias("e_start"), (start + F.col("size")).alias("e_end"), F.col("length").alias("n")
        ),
        "passages",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model usage records from events."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = {"click": "chat", "view": "embedding", "purchase": "rerank", "signup": "vlm", "error": "extract"}
    pairs = [F.lit(x) for kv in kinds.items() for x in kv]
    prompt = F.floor("value").cast("long")
    done = F.pmod("event_id", F.lit(50)).cast("long")
    return e.select(
        "event_id",
        F.pmod("user_id", F.lit(4)).cast("int").alias("tenant_id"),
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(10)).cast("string")).alias("model_id"),
        F.create_map(*pairs)[F.col("event_type")].alias("model_type"),
        (F.pmod(k, F.lit(10)) != 0).alias("success"),
        prompt.alias("prompt_tokens"),
        F.least(k.cast("long"), prompt).alias("cached_tokens"),
        done.alias("completion_tokens"),
        (prompt + done).alias("total_tokens"),
        F.col("ts").alias("created_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task records from orders."""
    status = {"F": "completed", "O": "pending", "P": "running"}
    pairs = [F.lit(x) for kv in status.items() for x in kv]
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_custkey").alias("knowledge_id"),
        F.create_map(*pairs)[F.col("o_orderstatus")].alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


#: The same adapters as SQL, for oracles.
SQL_DOCUMENTS = """SELECT d.doc_id, source AS kb_id, (d.doc_id % 4)::INT AS tenant_id, lang || '-' || d.doc_id AS title, text,
  lang, n_chars, d.doc_id % 17 = 0 AS deleted, t.doc_id IS NULL AS enabled
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON d.doc_id = t.doc_id"""
SQL_USAGE = """SELECT event_id, (user_id % 4)::INT AS tenant_id, 'm' || (user_id % 10) AS model_id,
  CASE event_type WHEN 'click' THEN 'chat' WHEN 'view' THEN 'embedding' WHEN 'purchase' THEN 'rerank'
    WHEN 'signup' THEN 'vlm' WHEN 'error' THEN 'extract' END AS model_type,
  (props->>'$.k')::INT % 10 <> 0 AS success, floor(value)::BIGINT AS prompt_tokens,
  least((props->>'$.k')::BIGINT, floor(value)::BIGINT) AS cached_tokens, (event_id % 50)::BIGINT AS completion_tokens,
  floor(value)::BIGINT + (event_id % 50)::BIGINT AS total_tokens, ts AS created_at FROM events"""
SQL_TASKS = """SELECT o_orderkey AS task_id, o_custkey AS knowledge_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' END AS status,
  o_orderdate AS created_at FROM orders"""
