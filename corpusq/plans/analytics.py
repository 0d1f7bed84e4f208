"""Usage and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import model
from corpusq.functions import text as T
from corpusq.operators import catalog, usage
from corpusq.registry import query

U = f"WITH u AS ({model.SQL_USAGE}), own AS (SELECT * FROM u WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' AND created_at <= TIMESTAMP '{model.NOW}')"
DAYS = 30
SUMS = """coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens,
  coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, coalesce(sum(cached_tokens), 0)::BIGINT AS cached_tokens"""


def rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE round({a}::DOUBLE / {b}, 4) END"


def _own(spark, sf_dir):
    return usage.since(model.usage(spark, sf_dir), model.NOW, DAYS)


@query(
    "usage_totals",
    f"""{U}, t AS (SELECT count(*) AS calls, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, {SUMS} FROM own)
    SELECT *, {rate("successes", "calls")} AS success_rate FROM t""",
)
def usage_totals(spark, sf_dir):
    return usage.totals(_own(spark, sf_dir))


def _by_sql(keys: str, tail: str = "") -> str:
    return f"""{U}, t AS (SELECT {keys}, count(*) AS calls, count(*) FILTER (success) AS successes, {SUMS} FROM own GROUP BY {keys})
    SELECT *, {rate("successes", "calls")} AS success_rate, {rate("cached_tokens", "prompt_tokens")} AS cache_rate FROM t {tail}"""


@query("usage_by_type", _by_sql("model_type"))
def usage_by_type(spark, sf_dir):
    return usage.by(_own(spark, sf_dir), ["model_type"])


@query("usage_by_model_top20", _by_sql("model_id, model_type, tenant_id", "ORDER BY total_tokens DESC, calls DESC, model_id, model_type, tenant_id LIMIT 20"))
def usage_by_model_top20(spark, sf_dir):
    return usage.by(_own(spark, sf_dir), ["model_id", "model_type", "tenant_id"], 20)


@query(
    "usage_daily_filled",
    f"""{U} SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS calls, coalesce(t, 0)::BIGINT AS total_tokens
    FROM range(DATE '2024-01-31' - INTERVAL 39 DAY, DATE '2024-02-01', INTERVAL 1 DAY) r(d)
    LEFT JOIN (SELECT created_at::DATE AS day, count(*) AS n, sum(total_tokens) AS t FROM u GROUP BY 1) x ON x.day = d::DATE""",
)
def usage_daily_filled(spark, sf_dir):
    return usage.daily(model.usage(spark, sf_dir), model.NOW, 40)


def _series_sql(hours: int, minutes: int) -> str:
    return f"""{U}, g AS (SELECT *, CASE model_type WHEN 'chat' THEN 'language' WHEN 'vlm' THEN 'vision' WHEN 'embedding' THEN 'embedding'
      WHEN 'rerank' THEN 'rerank' END AS type_group FROM u WHERE created_at >= TIMESTAMP '{model.NOW}' - INTERVAL {hours} HOUR AND created_at <= TIMESTAMP '{model.NOW}'),
    p AS (SELECT time_bucket(INTERVAL {minutes} MINUTE, created_at, TIMESTAMP '1970-01-01') AS bucket, type_group, sum(prompt_tokens)::BIGINT AS p, sum(cached_tokens)::BIGINT AS c
      FROM g WHERE type_group IS NOT NULL GROUP BY ALL),
    spine AS (SELECT b AS bucket, type_group FROM range(TIMESTAMP '{model.NOW}' - INTERVAL {hours} HOUR, TIMESTAMP '{model.NOW}' + INTERVAL 1 SECOND, INTERVAL {minutes} MINUTE) r(b),
      (SELECT type_group FROM p GROUP BY 1 HAVING sum(p) > 0))
    SELECT s.bucket, s.type_group, coalesce(p, 0) AS prompt_tokens, coalesce(c, 0) AS cached_tokens,
      {rate("coalesce(c, 0)", "coalesce(p, 0)")} AS cache_rate FROM spine s LEFT JOIN p USING (bucket, type_group)"""


@query("usage_15m_series", _series_sql(720, 15))
def usage_15m_series(spark, sf_dir):
    return usage.series(model.usage(spark, sf_dir), model.NOW, 720, 15)


@query("usage_hourly_series", _series_sql(720, 60))
def usage_hourly_series(spark, sf_dir):
    return usage.series(model.usage(spark, sf_dir), model.NOW, 720, 60)


@query(
    "cache_rates",
    f"""{U}, t AS (SELECT model_type, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(cached_tokens)::BIGINT AS cached_tokens
      FROM own WHERE model_type <> 'extract' GROUP BY 1) SELECT *, {rate("cached_tokens", "prompt_tokens")} AS cache_rate FROM t""",
)
def cache_rates(spark, sf_dir):
    return usage.cache_rates(_own(spark, sf_dir))


@query(
    "usage_insert",
    f"""{U} SELECT event_id, model_type, greatest(prompt_tokens - 50, 0) AS prompt_tokens, completion_tokens,
    CASE WHEN event_id % 3 = 0 THEN total_tokens ELSE greatest(prompt_tokens - 50, 0) + completion_tokens END AS total_tokens,
    greatest(cached_tokens, 0) AS cached_tokens, repeat('e', least(event_id, 500)::INT) AS error FROM u WHERE model_type <> 'extract' AND (event_id % 3 <> 0 OR total_tokens > 0)
    UNION ALL SELECT event_id, model_type, greatest(prompt_tokens - 50, 0), completion_tokens, greatest(prompt_tokens - 50, 0) + completion_tokens,
    greatest(cached_tokens, 0), repeat('e', least(event_id, 500)::INT) FROM u WHERE model_type <> 'extract' AND event_id % 3 = 0 AND total_tokens <= 0""",
)
def usage_insert(spark, sf_dir):
    """Records as they are written; errors grow with the event's id up to twice the length that is kept."""
    u = model.usage(spark, sf_dir)
    raw = u.select(
        "event_id", "model_type", (F.col("prompt_tokens") - 50).alias("prompt_tokens"), "completion_tokens",
        F.when(F.col("event_id") % 3 == 0, F.col("total_tokens")).alias("total_tokens"), "cached_tokens",
        F.repeat(F.lit("e"), F.least(F.col("event_id"), F.lit(1000)).cast("int")).alias("error"),
    )
    return usage.records(raw)


@query(
    "searchable_scope",
    f"WITH docs AS ({model.SQL_DOCUMENTS}) SELECT doc_id, kb_id, tenant_id, title FROM docs WHERE enabled AND NOT deleted AND tenant_id = 2 AND kb_id IN ('src2', 'src6', 'src10')",
)
def searchable_scope(spark, sf_dir):
    docs = model.enabled_documents(spark, sf_dir).where(model.scoped(2, ["src2", "src6", "src10"]))
    return docs.select("doc_id", "kb_id", "tenant_id", "title")


@query(
    "doc_filter_builder",
    f"""WITH docs AS ({model.SQL_DOCUMENTS}) SELECT doc_id, title, kb_id FROM docs
    WHERE (contains(lower(title), 'en-1') OR contains(lower(text), 'password')) AND kb_id = 'src3'""",
)
def doc_filter_builder(spark, sf_dir):
    docs = model.documents(spark, sf_dir)
    either = catalog.document_filter(keyword="en-1", columns=("title",)) | catalog.document_filter(keyword="password", columns=("text",))
    return docs.where(either & catalog.document_filter(source="src3")).select("doc_id", "title", "kb_id")


@query(
    "grep_all_terms",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') AND contains(lower(text), 'the')",
)
def grep_all_terms(spark, sf_dir):
    docs = model.documents(spark, sf_dir)
    return docs.where(T.contains_all(F.col("text"), "idiot the".split())).select("doc_id")


@query("search_any_term", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'small')")
def search_any_term(spark, sf_dir):
    part = model.read(spark, sf_dir, "part")
    return part.where(T.contains_any(F.col("p_name"), ["Bolt"]) | catalog.contains("p_type", "small")).select("p_partkey", "p_name")


@query(
    "json_path_filter",
    "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT >= 50 AND event_type IN ('click', 'view')",
)
def json_path_filter(spark, sf_dir):
    e = model.read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.where((k >= 50) & F.col("event_type").isin("click", "view")).select("event_id", k.alias("k"))


@query("json_has_key", "SELECT event_id FROM events WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.missing')")
def json_has_key(spark, sf_dir):
    e = model.read(spark, sf_dir, "events")
    has = lambda p: F.get_json_object("props", p).isNotNull()
    return e.where(has("$.k") & ~has("$.missing")).select("event_id")


@query("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(spark, sf_dir):
    orders = model.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return catalog.offset_page(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], page=3, page_size=50)


@query(
    "page_keyset",
    """WITH p AS (SELECT conv_id, turn FROM conversations WHERE conv_id < 60 ORDER BY conv_id DESC, turn DESC LIMIT 30)
    SELECT conv_id, turn, (SELECT count(*) FROM p) >= 30 AS has_more FROM p""",
)
def page_keyset(spark, sf_dir):
    c = model.read(spark, sf_dir, "conversations").select("conv_id", "turn")
    return catalog.keyset_page(c, "conv_id", 60, "turn", 30)


@query(
    "status_counts_pivot",
    f"""WITH t AS ({model.SQL_TASKS}) SELECT knowledge_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'pending') AS pending,
    count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled,
    count(*) FILTER (status = 'superseded') AS superseded FROM t GROUP BY 1""",
)
def status_counts_pivot(spark, sf_dir):
    names = ["completed", "pending", "running", "failed", "cancelled", "superseded"]
    return catalog.pivot_counts(model.tasks(spark, sf_dir), "knowledge_id", "status", names)


@query("tag_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def tag_counts(spark, sf_dir):
    return catalog.counts(model.read(spark, sf_dir, "part"), "p_brand")


@query(
    "kb_statistics",
    f"""WITH docs AS ({model.SQL_DOCUMENTS}) SELECT kb_id, count(*) AS n_documents, count(*) FILTER (enabled AND NOT deleted) AS n_searchable,
    sum(n_chars)::BIGINT AS storage FROM docs GROUP BY 1""",
)
def kb_statistics(spark, sf_dir):
    return model.enabled_documents(spark, sf_dir).groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count(F.when(model.searchable(), 1)).alias("n_searchable"),
        F.sum("n_chars").alias("storage"),
    )


@query(
    "having_duplicates",
    "SELECT source AS kb_id, sha256(text) AS file_hash, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
)
def having_duplicates(spark, sf_dir):
    d = model.documents(spark, sf_dir).withColumn("file_hash", F.sha2("text", 256))
    return catalog.having_more(d, ["kb_id", "file_hash"])


@query("multi_key_sort", "SELECT p_partkey, p_type, p_size, p_name FROM part ORDER BY p_type, p_size DESC, p_name, p_partkey")
def multi_key_sort(spark, sf_dir):
    part = model.read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_name")
    return part.orderBy("p_type", F.desc("p_size"), "p_name", "p_partkey")


@query("distinct_models", f"WITH u AS ({model.SQL_USAGE}) SELECT DISTINCT tenant_id, model_type FROM u")
def distinct_models(spark, sf_dir):
    return model.usage(spark, sf_dir).select("tenant_id", "model_type").distinct()


@query("table_scan_joins", """SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'P'""")
def table_scan_joins(spark, sf_dir):
    t = lambda n: model.read(spark, sf_dir, n)
    orders = t("orders").where("o_orderstatus = 'P'")
    joined = orders.join(t("customer"), orders.o_custkey == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")
