"""History, queue, mutation and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import model
from corpusq.functions.text import tokens_for_usage
from corpusq.operators import history
from corpusq.registry import query
from corpusq.sources import sinks

SQL_TURNS = """r AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS request FROM conversations),
t AS (SELECT conv_id, request::BIGINT AS request, min_by(text, turn) FILTER (role = 'user') AS user_text,
  max_by(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS assistant_text FROM r WHERE request > 0 GROUP BY ALL),
turns AS (SELECT conv_id, request, user_text, trim(assistant_text) AS assistant_text FROM t WHERE user_text IS NOT NULL AND assistant_text IS NOT NULL)"""
TOKENS = "greatest(1, length(user_text) // 4) + greatest(1, length(assistant_text) // 4)"


def _turns(spark, sf_dir):
    return history.complete_turns(model.read(spark, sf_dir, "conversations"))


def _tokens():
    return tokens_for_usage(F.col("user_text")) + tokens_for_usage(F.col("assistant_text"))


@query("turn_completeness", f"WITH {SQL_TURNS} SELECT conv_id, request, md5(user_text) AS user_md5, md5(assistant_text) AS assistant_md5 FROM turns")
def turn_completeness(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "request", F.md5("user_text").alias("user_md5"), F.md5("assistant_text").alias("assistant_md5"))


@query("last_n_turns", f"WITH {SQL_TURNS} SELECT conv_id, request FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY request DESC) <= 2")
def last_n_turns(spark, sf_dir):
    return history.last_n(_turns(spark, sf_dir), 2).select("conv_id", "request")


@query(
    "token_budget_tail",
    f"""WITH {SQL_TURNS}, u AS (SELECT conv_id, request, (sum({TOKENS}) OVER (PARTITION BY conv_id ORDER BY request DESC))::BIGINT AS used FROM turns)
    SELECT * FROM u WHERE used <= 600""",
)
def token_budget_tail(spark, sf_dir):
    return history.budget_tail(_turns(spark, sf_dir), _tokens(), 600).select("conv_id", "request", "used")


@query(
    "truncate_oldest",
    f"""WITH {SQL_TURNS}, u AS (SELECT conv_id, request, (sum({TOKENS}) OVER (PARTITION BY conv_id))::BIGINT AS total,
      (sum({TOKENS}) OVER (PARTITION BY conv_id ORDER BY request DESC))::BIGINT AS used FROM turns)
    SELECT * FROM u WHERE total <= 800 OR used <= 0.8 * 800""",
)
def truncate_oldest(spark, sf_dir):
    return history.truncate_oldest(_turns(spark, sf_dir), _tokens(), 800).select("conv_id", "request", "total", "used")


@query(
    "tool_groups",
    """SELECT conv_id, turn, (sum(CASE WHEN role = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS group_no FROM conversations""",
)
def tool_groups(spark, sf_dir):
    return history.tool_groups(model.read(spark, sf_dir, "conversations")).select("conv_id", "turn", "group_no")


@query(
    "snapshot_boundary",
    """WITH b AS (SELECT conv_id, max(turn) - 2 AS boundary FROM conversations GROUP BY 1)
    SELECT conv_id, turn, boundary FROM conversations JOIN b USING (conv_id) WHERE turn >= boundary""",
)
def snapshot_boundary(spark, sf_dir):
    c = model.read(spark, sf_dir, "conversations")
    boundary = c.groupBy("conv_id").agg((F.max("turn") - 2).alias("boundary"))
    return history.after_boundary(c, boundary).select("conv_id", "turn", "boundary")


@query(
    "latest_op_wins",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_op_wins(spark, sf_dir):
    e = model.read(spark, sf_dir, "events")
    out = history.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return out.select("user_id", "event_type", "event_id", "value")


@query(
    "idempotent_requests",
    "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) = 1",
)
def idempotent_requests(spark, sf_dir):
    """First event of each request of a user, a request being told by its properties."""
    e = model.read(spark, sf_dir, "events")
    return history.latest(e, ["user_id", "props"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query(
    "superseded_tasks",
    f"""WITH t AS ({model.SQL_TASKS}) SELECT task_id, knowledge_id, status FROM t WHERE status IN ('running', 'pending')
    QUALIFY row_number() OVER (PARTITION BY knowledge_id ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, created_at, task_id) > 1""",
)
def superseded_tasks(spark, sf_dir):
    return history.superseded(model.tasks(spark, sf_dir)).select("task_id", "knowledge_id", "status")


@query(
    "stale_leases",
    f"WITH t AS ({model.SQL_TASKS}) SELECT task_id FROM t WHERE status = 'running' AND created_at < TIMESTAMP '{model.NOW}' - INTERVAL 90 SECOND",
)
def stale_leases(spark, sf_dir):
    return history.stale_leases(model.tasks(spark, sf_dir), model.NOW).select("task_id")


@query(
    "task_recovery",
    f"""WITH t AS ({model.SQL_TASKS}), k AS (SELECT DISTINCT c_custkey AS knowledge_id FROM customer WHERE c_acctbal >= 0)
    SELECT task_id, CASE WHEN k.knowledge_id IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY t.knowledge_id
      ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, created_at, task_id) = 1 THEN 'keep' ELSE 'superseded' END AS decision
    FROM t LEFT JOIN k ON k.knowledge_id = t.knowledge_id WHERE status IN ('running', 'pending')""",
)
def task_recovery(spark, sf_dir):
    known = model.read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("knowledge_id"))
    return history.recover(model.tasks(spark, sf_dir), known).select("task_id", "decision")


@query(
    "exact_dup_keep_plan",
    """SELECT doc_id, sha256(text) AS file_hash, row_number() OVER (PARTITION BY doc_id % 4, source, sha256(text) ORDER BY doc_id % 17 = 0, n_chars < 100, doc_id) = 1 AS keep FROM documents""",
)
def exact_dup_keep_plan(spark, sf_dir):
    d = model.documents(spark, sf_dir)
    rows = d.select("doc_id", "tenant_id", "kb_id", F.sha2("text", 256).alias("file_hash"), "deleted", (F.col("n_chars") < 100).alias("incomplete"), F.lit(0).alias("created_at"))
    return history.keep_plan(rows).select("doc_id", "file_hash", "keep")


@query(
    "asof_anchor",
    """SELECT p.event_id, p.user_id, v.event_id AS match_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    LEFT JOIN LATERAL (SELECT event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON true""",
)
def asof_anchor(spark, sf_dir):
    e = model.read(spark, sf_dir, "events")
    purchases, views = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'")
    return history.as_of(purchases, views, "user_id", "ts", "ts", "event_id").select("event_id", "user_id", "match_id")


@query(
    "interval_union",
    """WITH s AS (SELECT l_suppkey AS k, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::INT AS b FROM lineitem),
    m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
    SELECT k, min(a) AS start_at, max(b) AS end_at FROM g GROUP BY k, island""",
)
def interval_union(spark, sf_dir):
    """Union of the days that a supplier's shipments take."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01"))
    spans = model.read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), day.alias("start_at"), (day + F.col("l_quantity").cast("int")).alias("end_at")
    )
    return history.merge_intervals(spans, "k").select("k", "start_at", "end_at")


@query("stale_index_rows", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 <> 0)")
def stale_index_rows(spark, sf_dir):
    live = model.documents(spark, sf_dir).where(model.active()).select(F.col("doc_id").alias("vec_id"))
    return sinks.stale(model.read(spark, sf_dir, "embeddings").select("vec_id"), live, "vec_id")


@query(
    "index_upsert",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS version, md5(text) AS content_md5 FROM documents WHERE doc_id % 17 <> 0""",
)
def index_upsert(spark, sf_dir):
    """An index after a batch of changed rows has replaced its old ones and deleted documents have left it."""
    d = model.documents(spark, sf_dir)
    rows = d.select("doc_id", F.md5("text").alias("content_md5"))
    old = rows.withColumn("version", F.lit("old"))
    changed = rows.where("doc_id % 5 = 0").withColumn("version", F.lit("new"))
    merged = sinks.upsert(old, changed, ["doc_id"])
    return sinks.delete(merged, d.where("deleted").select("doc_id"), ["doc_id"]).select("doc_id", "version", "content_md5")


@query(
    "move_documents",
    "SELECT doc_id, CASE WHEN source = 'src1' AND n_chars > 500 THEN 'src2' ELSE source END AS kb_id FROM documents",
)
def move_documents(spark, sf_dir):
    d = model.documents(spark, sf_dir)
    return sinks.update(d, (F.col("kb_id") == "src1") & (F.col("n_chars") > 500), {"kb_id": F.lit("src2")}).select("doc_id", "kb_id")


@query(
    "span_states",
    """SELECT user_id, count(*) AS n_events, max_by(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last_type,
    datesub('second', min(ts), max(ts)) AS seconds FROM events GROUP BY 1""",
)
def span_states(spark, sf_dir):
    """State of every user's span: events, last kind and duration."""
    e = model.read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"),
    )
