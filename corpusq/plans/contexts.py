"""Parent-context, span evaluation and event-window queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq import model
from corpusq.operators import chunking, evaluation, graph, retrieval_context
from corpusq.plans.chunks import SQL_CHUNKS
from corpusq.plans.graphs import SQL_CHUNK_EDGES, SQL_TOP, chunk_graph
from corpusq.registry import query
from corpusq.streaming import jobs
from corpusq.tables import shared_folder, sized, written

#: Hits of a passage: the chunks of a document that share a position with it, by position.
SQL_SPANS = f"""{SQL_CHUNKS},
ev AS (SELECT b.item_id AS query_id, d.doc_id, strpos(d.text, b.text) - 1 AS e_start, strpos(d.text, b.text) - 1 + length(b.text) AS e_end, length(d.text) AS n
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
cand AS (SELECT query_id, c.doc_id, chunk_index, start_at, end_at, c.doc_id * 100000 + chunk_index AS id,
  row_number() OVER (PARTITION BY query_id ORDER BY abs(chunk_index - 1), c.doc_id, chunk_index) AS rank FROM c JOIN (SELECT DISTINCT query_id, doc_id FROM ev) USING (doc_id))"""


def _evidence(spark, sf_dir):
    return model.passages(spark, sf_dir).withColumn("evidence_id", F.concat_ws(":", "query_id", "doc_id"))


def _candidates(spark, sf_dir, evidence=None):
    from pyspark.sql import Window as W

    chunks = chunking.fixed_chunks(model.read(spark, sf_dir, "documents")).drop("content")
    pairs = (_evidence(spark, sf_dir) if evidence is None else evidence).select("query_id", "doc_id").distinct()
    w = W.partitionBy("query_id").orderBy(F.abs(F.col("chunk_index") - 1), "doc_id", "chunk_index")
    joined = chunks.join(pairs, "doc_id").withColumn("id", F.col("doc_id") * 100000 + F.col("chunk_index"))
    return joined.withColumn("rank", F.row_number().over(w))


@query(
    "span_evaluation",
    f"""WITH {SQL_SPANS}, top AS (SELECT * FROM cand WHERE rank <= 20),
    hits AS (SELECT t.query_id, id, rank, e.doc_id AS ed FROM top t JOIN ev e ON t.query_id = e.query_id AND t.doc_id = e.doc_id AND start_at < e_end AND end_at > e_start)
    SELECT b.item_id AS query_id, round(coalesce(1.0::DOUBLE / h.first, 0), 6) AS mrr, round(coalesce(h.found::DOUBLE / n.n, 0), 6) AS recall,
      round(coalesce(h.useful::DOUBLE / t.k, 0), 6) AS precision, coalesce(t.chars, 0)::BIGINT AS chars
    FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS k, sum(end_at - start_at) AS chars FROM top GROUP BY 1) t ON t.query_id = b.item_id
    LEFT JOIN (SELECT query_id, count(*) AS n FROM ev GROUP BY 1) n ON n.query_id = b.item_id
    LEFT JOIN (SELECT query_id, min(rank) FILTER (rank <= 10) AS first, count(DISTINCT ed) AS found, count(DISTINCT id) AS useful FROM hits GROUP BY 1) h ON h.query_id = b.item_id""",
)
def span_evaluation(spark, sf_dir):
    q = model.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    evidence = _evidence(spark, sf_dir)
    out = evaluation.span_metrics(_candidates(spark, sf_dir, evidence), evidence, q)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "precision")], "chars")


@query(
    "parent_collapse",
    f"""WITH {SQL_SPANS}, h AS (SELECT *, doc_id AS parent_id FROM cand WHERE rank <= 20)
    SELECT query_id, parent_id, min_by(id, rank) AS id, min(rank) AS child_rank, count(*) AS n_children,
      row_number() OVER (PARTITION BY query_id ORDER BY min(rank), min_by(id, rank)) AS rank FROM h GROUP BY query_id, parent_id""",
)
def parent_collapse(spark, sf_dir):
    hits = _candidates(spark, sf_dir).where("rank <= 20").withColumn("parent_id", F.col("doc_id")).withColumn("score", 1 / F.col("rank"))
    out = retrieval_context.collapse_siblings(hits)
    return out.select("query_id", "parent_id", "id", "child_rank", F.size("child_ids").alias("n_children"), "rank")


@query(
    "evidence_window",
    f"""WITH {SQL_SPANS}, w AS (SELECT query_id, doc_id, n, CASE WHEN n <= 600 THEN 0 ELSE greatest(0, least(floor((e_start + e_end - 600) / 2), n - 600)) END AS b FROM ev)
    SELECT query_id, doc_id, b::BIGINT AS window_start, least(n, b + 600)::BIGINT AS window_end FROM w""",
)
def evidence_window(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    begin, end = retrieval_context.evidence_window(F.col("n"), F.col("e_start"), F.col("e_end"), F.col("e_start"), F.col("e_end"), 600)
    return e.select("query_id", "doc_id", begin.alias("window_start"), end.alias("window_end"))


SQL_EXPANDED = f"""{SQL_SPANS}{SQL_CHUNK_EDGES[len(SQL_CHUNKS):]},
two AS (SELECT x.doc_id, x.a, y.b, max({{'w': round(x.best.w * y.best.w * 0.5, 9), 'd': greatest(x.best.d, y.best.d)}}) AS best
  FROM edges x JOIN edges y ON x.doc_id = y.doc_id AND x.b = y.a WHERE x.a <> y.b GROUP BY ALL),
ways AS (SELECT doc_id, a, b, 0 AS kind, {SQL_TOP} AS near FROM edges QUALIFY near <= 8 UNION ALL
  SELECT doc_id, a, b, 1, {SQL_TOP} AS near FROM two WHERE NOT EXISTS (SELECT 1 FROM edges d WHERE d.doc_id = two.doc_id AND d.a = two.a AND d.b = two.b) QUALIFY near <= 8),
top AS (SELECT * FROM cand WHERE rank <= 3),
reached AS (SELECT query_id, t.doc_id * 100000 + b AS next, min({{'k': kind, 'r': rank, 'n': near}}) AS way FROM top t JOIN ways w ON w.doc_id = t.doc_id AND w.a = t.chunk_index GROUP BY ALL)"""


@query(
    "relation_expansion",
    f"""WITH {SQL_EXPANDED} SELECT query_id, next, row_number() OVER (PARTITION BY query_id ORDER BY way, next) AS position FROM reached r
    WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.query_id = r.query_id AND top.id = r.next) QUALIFY position <= 3""",
)
def relation_expansion(spark, sf_dir):
    """Chunks that the hits of a passage lead to in the chunk graph, three for each query.
    A graph is that of one document, so those of the documents hit are all that is needed."""
    scope = ("doc_id",)
    hits = written(_candidates(spark, sf_dir).where("rank <= 3").select("query_id", "id", "rank", "doc_id"), "hits")
    own = written(hits.select("doc_id").distinct(), "hit-documents")
    edges = chunk_graph(spark, sf_dir, own=sized(own)).withColumns({c: F.col("doc_id") * 100000 + F.col(c) for c in ("a", "b")})
    hits, starts = hits.drop("doc_id"), hits.select(F.col("id").alias("a")).distinct()
    direct = graph.top_neighbours(edges.join(starts, "a", "left_semi"), scope=scope)
    return graph.expand_relations(hits, direct, graph.top_neighbours(graph.two_hop(edges, scope=scope, starts=starts, most=8), scope=scope))


@query("strategy_evaluation")
def strategy_evaluation(spark, sf_dir):
    """Chunking strategies side by side: mean figures of the passages' evidence and
    the bytes and chunks that an index of each would hold."""
    docs = model.read(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["doc_id", "start_at", "end_at", "content"]
    strategies = {
        "fixed": chunking.fixed_chunks(docs).select(columns),
        "recursive": chunking.structural_chunks(docs, strategy="recursive").select(columns),
        "auto": chunking.hierarchy(docs).where("chunk_type = 'text'").select(columns),
    }
    q = model.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return evaluation.strategy_report(strategies, _evidence(spark, sf_dir), q)


@query(
    "parent_fallbacks",
    f"""WITH {SQL_CHUNKS}, h AS (SELECT doc_id, chunk_index, start_at, end_at, CASE WHEN chunk_index % 7 = 6 THEN NULL ELSE doc_id + (CASE WHEN chunk_index % 5 = 4 THEN 10000000 ELSE 0 END) END AS parent_id FROM c),
    p AS (SELECT doc_id AS parent_id, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'parent_text' END AS p_type, doc_id - (CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) AS p_doc, least(2048, length(text)) AS p_end FROM documents)
    SELECT h.doc_id, chunk_index, CASE WHEN h.parent_id IS NULL THEN NULL WHEN p_type IS NULL THEN 'missing_parent' WHEN p_type <> 'parent_text' THEN 'invalid_parent_type'
      WHEN p_doc <> h.doc_id THEN 'parent_scope_mismatch' WHEN end_at > p_end THEN 'invalid_source_range' END AS fallback FROM h LEFT JOIN p ON p.parent_id = h.parent_id""",
)
def parent_fallbacks(spark, sf_dir):
    docs = model.read(spark, sf_dir, "documents")
    i = F.col("chunk_index")
    lost = F.when(i % 5 == 4, 10_000_000).otherwise(0)
    hits = chunking.fixed_chunks(docs).select(
        "doc_id", "chunk_index", "start_at", "end_at", F.lit(0).alias("tenant_id"), F.lit("k").alias("kb_id"),
        F.when(i % 7 == 6, F.lit(None)).otherwise(F.col("doc_id") + lost).alias("parent_id"),
    )
    parents = docs.select(
        F.col("doc_id").alias("parent_id"), F.when(F.col("doc_id") % 3 == 0, "text").otherwise("parent_text").alias("p_type"),
        F.lit(0).alias("p_tenant_id"), F.lit("k").alias("p_kb_id"),
        (F.col("doc_id") - F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("p_doc_id"),
        F.lit(0).alias("p_start"), F.least(F.lit(2048), F.length("text")).alias("p_end"),
    )
    return retrieval_context.resolve_parents(hits, parents).select("doc_id", "chunk_index", "fallback")


def _sql_share(keys: str, text: str) -> str:
    return f"CASE WHEN len({keys}) = 0 THEN 0.0 ELSE round(len(list_filter({keys}, lambda s: contains(lower({text}), s)))::DOUBLE / len({keys}), 4) END"


def _sql_keys(text: str) -> str:
    return f"""list_distinct(list_filter(string_split_regex(lower({text}), '[\\s,.;:!?，。；：！？、()（）\\[\\]"''“”]+'), lambda s: length(s) >= 2 AND NOT regexp_full_match(s, '\\p{{Nd}}+')))"""


@query(
    "keyword_rag_scores",
    f"""WITH a AS (SELECT conv_id * 1000 + turn AS id, text AS answer, lag(text) OVER w AS question, lead(text) OVER w AS context,
      coalesce(lag(text, 2) OVER w, text) AS reference FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT id, answer, context, {_sql_keys("question")} AS q, {_sql_keys("reference")} AS r, {_sql_keys("answer")} AS a FROM a WHERE question IS NOT NULL AND context IS NOT NULL)
    SELECT id, {_sql_share("r", "answer")} AS answer_coverage, {_sql_share("r", "context")} AS context_coverage, {_sql_share("a", "context")} AS faithfulness,
      {_sql_share("q", "answer")} AS relevance, {_sql_share("q", "context")} AS precision FROM k""",
)
def keyword_rag_scores(spark, sf_dir):
    """Keyword figures of a turn as an answer: the turn before asks, the one after is
    its context and the one before the question its reference."""
    from pyspark.sql import Window as W

    c = model.read(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), F.lag("text").over(w).alias("question"),
        F.lead("text").over(w).alias("context"), F.coalesce(F.lag("text", 2).over(w), "text").alias("reference"),
    )
    return evaluation.keyword_scores(rows.where("question is not null and context is not null"))


@query(
    "stream_tumbling",
    """SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""",
)
def stream_tumbling(spark, sf_dir):
    out = jobs.tumbling(_stream(spark, sf_dir))
    table = jobs.run_to_memory(out, f"tumbling_{uuid.uuid4().hex}", "complete", _checkpoint(spark))
    return table.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("value", 4).alias("value"))


@query("stream_dedupe", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY ALL")
def stream_dedupe(spark, sf_dir):
    """Events without repeats of user, kind and time, counted by user and kind."""
    once = jobs.idempotent(_stream(spark, sf_dir), ["user_id", "event_type", "ts"])
    table = jobs.run_to_memory(once.select("user_id", "event_type"), f"dedupe_{uuid.uuid4().hex}", "append", _checkpoint(spark))
    return table.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "session_windows",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM s)
    SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS finish, count(*) AS n FROM g GROUP BY user_id, k""",
)
def session_windows(spark, sf_dir):
    """The batch form of the session job."""
    e = model.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.sessions(e, "6 hours")
    return out.select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n")


def _stream(spark, sf_dir):
    schema = model.read(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return raw.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _checkpoint(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
