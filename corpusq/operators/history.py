"""Conversation windows and queue maintenance: latest, first, last and budgets per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusq.functions.text import strip_thinking


def requests(messages: DataFrame) -> DataFrame:
    """Adds ``request``: the number of user turns so far in the conversation."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return messages.withColumn("request", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))


def complete_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, request, user_text, assistant_text) of requests that have a user
    turn and a non-empty answer once thinking is removed."""
    answer = strip_thinking(F.col("text"))
    grouped = requests(messages).where("request > 0").groupBy("conv_id", "request").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("user_text"),
        F.max_by(answer, F.when((F.col("role") == "assistant") & (F.length(answer) > 0), F.col("turn"))).alias("assistant_text"),
    )
    return grouped.where("user_text is not null and assistant_text is not null")


def last_n(turns: DataFrame, n: int, by: str = "conv_id", order: str = "request") -> DataFrame:
    """The last n rows of each key, n from 1 to 20."""
    n = min(max(n, 1), 20)
    w = W.partitionBy(by).orderBy(F.desc(order))
    return turns.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def budget_tail(turns: DataFrame, tokens: Column, budget: int, by: str = "conv_id", order: str = "request") -> DataFrame:
    """The latest rows of each key whose tokens together stay within the budget."""
    w = W.partitionBy(by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def truncate_oldest(turns: DataFrame, tokens: Column, limit: int, share: float = 0.8, by: str = "conv_id", order: str = "request") -> DataFrame:
    """Keys over the limit lose their oldest rows until a share of it is left."""
    whole = F.sum(tokens).over(W.partitionBy(by))
    w = W.partitionBy(by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    out = turns.withColumn("total", whole).withColumn("used", F.sum(tokens).over(w))
    return out.where((F.col("total") <= limit) | (F.col("used") <= share * limit))


def of_tenant(messages: DataFrame, sessions: DataFrame, key: str, tenant: int, order: str, most: int) -> DataFrame:
    """The last ``most`` messages of each session (key, tenant_id) of a tenant."""
    own = sessions.where(F.col("tenant_id") == tenant).select(key)
    w = W.partitionBy(key).orderBy(F.desc(order))
    return messages.join(own, key, "left_semi").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def tool_groups(messages: DataFrame) -> DataFrame:
    """Adds ``group_no``: an assistant turn with calls and the tool turns after it share one."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return messages.withColumn("group_no", F.sum(F.when(F.col("role") == "tool", 0).otherwise(1)).over(w))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def after_boundary(messages: DataFrame, boundary: DataFrame) -> DataFrame:
    """Messages of a conversation from its snapshot's boundary on."""
    return messages.join(boundary, "conv_id").where(F.col("turn") >= F.col("boundary"))


def keep_plan(docs: DataFrame) -> DataFrame:
    """Adds ``keep`` to documents of one tenant, base and file hash: the first by
    (deleted, not completed, created, id) stays."""
    w = W.partitionBy("tenant_id", "kb_id", "file_hash").orderBy("deleted", "incomplete", "created_at", "doc_id")
    return docs.withColumn("keep", F.row_number().over(w) == 1)


def superseded(tasks: DataFrame) -> DataFrame:
    """Open tasks behind the first of their document: running before pending, then oldest."""
    open_ = tasks.where(F.col("status").isin("running", "pending"))
    w = W.partitionBy("knowledge_id").orderBy(F.when(F.col("status") == "running", 0).otherwise(1), "created_at", "task_id")
    return open_.withColumn("nth", F.row_number().over(w)).where("nth > 1").drop("nth")


def stale_leases(tasks: DataFrame, now: str, seconds: int = 90) -> DataFrame:
    """Running tasks whose last beat is older than the lease."""
    limit = F.to_timestamp_ntz(F.lit(now)) - F.expr(f"interval {seconds} seconds")
    return tasks.where((F.col("status") == "running") & (F.col("created_at") < limit))


def recover(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """Open tasks with ``decision``: invalid without document, keep for the first of
    a document (running before pending), superseded for the others."""
    open_ = tasks.where(F.col("status").isin("running", "pending"))
    known = documents.select("knowledge_id").distinct().withColumn("known", F.lit(True))
    w = W.partitionBy("knowledge_id").orderBy(F.when(F.col("status") == "running", 0).otherwise(1), "created_at", "task_id")
    joined = open_.join(known, "knowledge_id", "left").withColumn("nth", F.row_number().over(w))
    decision = F.when(F.col("known").isNull(), "invalid").when(F.col("nth") == 1, "keep").otherwise("superseded")
    return joined.withColumn("decision", decision).drop("known", "nth")


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, right_id: str) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides become one stream per key and the last right row is carried
    forward, so a key costs a sort and never a product of its rows."""
    l = left.select(F.col(by), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast("long").alias("__id"))
    r = right.select(F.col(by), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.col(right_id).cast("long").alias("__id"))
    w = W.partitionBy(by).orderBy("__t", "__side", "__id").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("match_id", F.last("__id", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__l.*", "match_id")


def merge_intervals(spans: DataFrame, by: str) -> DataFrame:
    """Unions of overlapping or touching spans [start_at, end_at) per key."""
    w = W.partitionBy(by).orderBy("start_at", "end_at")
    reach = F.max("end_at").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start_at") <= reach, 0).otherwise(1)
    marked = spans.withColumn("__new", new)
    numbered = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(by, "island").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"))
