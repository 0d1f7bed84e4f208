"""Retrieval, fusion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import model
from corpusq.functions.text import ACCENTED, PLAIN, jaccard, overlap, redundant, token_set
from corpusq.operators import evaluation, fusion, lexical, vector
from corpusq.registry import query
from corpusq.tables import written

TOP = 20

SQL_TOKENS = f"regexp_extract_all(translate(lower({{0}}), '{ACCENTED}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def sql_tokens(expression: str) -> str:
    return SQL_TOKENS.format(expression).replace("{{", "{").replace("}}", "}")


SQL_DOCS = f"docs AS ({model.SQL_DOCUMENTS})"
SQL_BM25 = f"""
{SQL_DOCS},
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
dt AS (SELECT doc_id, {sql_tokens("title || ' ' || text")} AS toks FROM docs),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({sql_tokens("query")}) AS term FROM q) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt)
  WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
bm AS (SELECT query_id, doc_id, sum(qn * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN idf USING (term) JOIN qt USING (term), st GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
  WHERE rank <= {TOP})"""
SQL_KNN = f"""
nn AS (SELECT query_id, vec_id, d AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
    FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) QUALIFY rank <= {TOP})"""
#: Vector queries of the hybrid pipeline: the benchmark item's own vector.
SQL_HYBRID = f"""
vq AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
vn AS (SELECT query_id, vec_id AS doc_id, d AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank
  FROM (SELECT query_id, vec_id, list_distance(vq.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM vq, embeddings b) QUALIFY rank <= {TOP}),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, id) AS rank FROM (
  SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.doc_id, v.doc_id) AS id, k.rank AS keyword_rank, v.rank AS vector_rank,
    coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS score,
    least(coalesce(k.rank, 1000000000), coalesce(v.rank, 1000000000)) AS best
  FROM kw k FULL JOIN vn v ON k.query_id = v.query_id AND k.doc_id = v.doc_id))"""


def _keyword(spark, sf_dir, k=TOP):
    return lexical.bm25_top_k(model.documents(spark, sf_dir), model.queries(spark, sf_dir), k)


def _vector(spark, sf_dir, k=TOP):
    vectors = model.read(spark, sf_dir, "embeddings")
    items = model.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    own = items.join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return vector.knn(vectors, own, k)


def _hundredth(spark, sf_dir, k=TOP):
    vectors = model.read(spark, sf_dir, "embeddings")
    every = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.knn(vectors, every, k, exclude_self=True)


def _fused(spark, sf_dir):
    keyword = _keyword(spark, sf_dir).withColumnRenamed("doc_id", "id")
    near = _vector(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return fusion.rrf(keyword, near)


@query("bm25_topk", f"WITH {SQL_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM kw")
def bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "bm25_post_filter_kb",
    f"WITH {SQL_BM25} SELECT query_id, doc_id, rank FROM kw JOIN docs USING (doc_id) WHERE kb_id = 'src1' AND NOT deleted",
)
def bm25_post_filter_kb(spark, sf_dir):
    docs = model.documents(spark, sf_dir).where((F.col("kb_id") == "src1") & model.active()).select("doc_id")
    return _keyword(spark, sf_dir).join(docs, "doc_id").select("query_id", "doc_id", "rank")


@query("knn_topk_l2", f"WITH {SQL_KNN} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM nn")
def knn_topk_l2(spark, sf_dir):
    return _hundredth(spark, sf_dir).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "knn_post_filter",
    f"WITH {SQL_DOCS}, {SQL_KNN} SELECT query_id, vec_id, rank FROM nn JOIN docs ON doc_id = vec_id WHERE tenant_id = 1 AND enabled AND NOT deleted",
)
def knn_post_filter(spark, sf_dir):
    docs = model.enabled_documents(spark, sf_dir).where(model.scoped(1)).select(F.col("doc_id").alias("vec_id"))
    return _hundredth(spark, sf_dir).join(docs, "vec_id").select("query_id", "vec_id", "rank")


@query(
    "rrf_fusion",
    f"WITH {SQL_BM25}, {SQL_HYBRID} SELECT query_id, id, keyword_rank, vector_rank, round(score, 9) AS score, rank FROM fused",
)
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "id", "keyword_rank", "vector_rank", F.round("score", 9).alias("score"), "rank")


@query(
    "hybrid_hydrated",
    f"""WITH {SQL_BM25}, {SQL_HYBRID} SELECT query_id, id, rank, title, kb_id FROM fused JOIN docs ON doc_id = id
    WHERE enabled AND NOT deleted""",
)
def hybrid_hydrated(spark, sf_dir):
    docs = model.enabled_documents(spark, sf_dir).where(model.searchable()).select(F.col("doc_id").alias("id"), "title", "kb_id")
    return _fused(spark, sf_dir).join(docs, "id").select("query_id", "id", "rank", "title", "kb_id")


@query(
    "baseline_added_scores",
    f"""WITH {SQL_BM25}, {SQL_HYBRID} SELECT query_id, id, round(sum(s), 6) AS score FROM (
    SELECT query_id, doc_id AS id, greatest(0, 10 - abs(score)) AS s FROM kw
    UNION ALL SELECT query_id, doc_id, 1 / (1 + distance) FROM vn) GROUP BY ALL""",
)
def baseline_added_scores(spark, sf_dir):
    keyword = _keyword(spark, sf_dir).withColumnRenamed("doc_id", "id")
    near = _vector(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return fusion.added_scores(keyword, near).withColumn("score", F.round("score", 6))


def _label_metrics(spark, sf_dir):
    vectors = model.read(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # ranks of hits by label; the number of relevant vectors comes from label counts, not from pairs
    ranked = _hundredth(spark, sf_dir)
    hits = ranked.join(q, "query_id").join(vectors.withColumnRenamed("label", "other"), "vec_id").where("label = other")
    total = q.join(vectors.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n")), "label")
    found = hits.groupBy("query_id").agg(
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("found")
    )
    return total.join(found, "query_id", "left").select(
        "query_id",
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)), 6).alias("recall"),
    )


@query(
    "eval_mrr_recall",
    f"""WITH {SQL_KNN}, q AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 100 = 0),
    n AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label),
    h AS (SELECT query_id, min(rank) FILTER (rank <= 10) AS first, count(*) AS found FROM nn JOIN q USING (query_id)
      JOIN embeddings e ON e.vec_id = nn.vec_id WHERE e.label = q.label GROUP BY query_id)
    SELECT query_id, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(found::DOUBLE / n, 0), 6) AS recall
    FROM q JOIN n USING (label) LEFT JOIN h USING (query_id)""",
)
def eval_mrr_recall(spark, sf_dir):
    return _label_metrics(spark, sf_dir)


def _passage_relevance(spark, sf_dir):
    """Documents that hold the benchmark text."""
    return model.passages(spark, sf_dir).select("query_id", F.col("doc_id").alias("id"))


SQL_PASSAGES = "rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _sql_metrics(name: str, ranked: str) -> str:
    return f"""{name} AS (SELECT b.item_id AS query_id, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(found::DOUBLE / n, 0) AS recall
  FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) t ON t.query_id = b.item_id
  LEFT JOIN (SELECT query_id, min(rank) FILTER (rank <= 10) AS first, count(*) FILTER (rank <= 20) AS found
    FROM {ranked} JOIN rel USING (query_id, id) GROUP BY 1) h ON h.query_id = b.item_id)"""


@query(
    "eval_compare_gate",
    f"""WITH {SQL_BM25}, {SQL_HYBRID}, {SQL_PASSAGES},
    added AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(s), 9) DESC, id) AS rank FROM (
      SELECT query_id, doc_id AS id, greatest(0, 10 - abs(score)) AS s FROM kw
      UNION ALL SELECT query_id, doc_id, 1 / (1 + distance) FROM vn) GROUP BY query_id, id),
    {_sql_metrics("mb", "added")}, {_sql_metrics("mn", "fused")},
    m AS (SELECT (SELECT avg(mrr) FROM mb) AS base_mrr, (SELECT avg(recall) FROM mb) AS base_recall,
      (SELECT avg(mrr) FROM mn) AS new_mrr, (SELECT avg(recall) FROM mn) AS new_recall)
    SELECT round(base_mrr, 6) AS base_mrr, round(base_recall, 6) AS base_recall, round(new_mrr, 6) AS new_mrr,
      round(new_recall, 6) AS new_recall, round((new_mrr - base_mrr) / greatest(base_mrr, 1e-9), 6) AS gain,
      base_mrr > 0 AND (new_mrr - base_mrr) / greatest(base_mrr, 1e-9) >= 0.05 - 1e-12 AND new_recall >= base_recall - 1e-12 AS passed FROM m""",
)
def eval_compare_gate(spark, sf_dir):
    keyword = _keyword(spark, sf_dir).withColumnRenamed("doc_id", "id")
    near = _vector(spark, sf_dir).withColumnRenamed("vec_id", "id")
    base = lexical.top_k(fusion.added_scores(keyword, near), 2 * TOP, "id")
    new = fusion.rrf(keyword, near)
    relevant = _passage_relevance(spark, sf_dir)
    q = model.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    out = evaluation.gate(evaluation.ranking_metrics(base, relevant, q), evaluation.ranking_metrics(new, relevant, q))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c != "passed"], "passed")


def _hits(spark, sf_dir):
    docs = model.enabled_documents(spark, sf_dir).where(model.searchable())
    text = docs.select(F.col("doc_id").alias("id"), "kb_id", "text")
    return _fused(spark, sf_dir).join(text, "id")


SQL_HITS = f"WITH {SQL_BM25}, {SQL_HYBRID}, hits AS (SELECT f.*, kb_id, text FROM fused f JOIN docs ON doc_id = id WHERE enabled AND NOT deleted)"


@query(
    "per_doc_cap",
    f"{SQL_HITS} SELECT query_id, kb_id, id, rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, kb_id ORDER BY rank, id) <= 2",
)
def per_doc_cap(spark, sf_dir):
    return fusion.per_document_cap(_hits(spark, sf_dir), 2, "kb_id").select("query_id", "kb_id", "id", "rank")


@query(
    "id_dedupe_max",
    f"""WITH {SQL_BM25}, {SQL_HYBRID}, c AS (SELECT query_id, doc_id AS id, score, rank AS pos FROM kw
      UNION ALL SELECT query_id, doc_id, 1 / (1 + distance), 1000 + rank FROM vn)
    SELECT query_id, id, round(max(score), 6) AS score, min(pos) AS pos FROM c GROUP BY ALL""",
)
def id_dedupe_max(spark, sf_dir):
    a = _keyword(spark, sf_dir).select("query_id", F.col("doc_id").alias("id"), "score", F.col("rank").alias("pos"))
    b = _vector(spark, sf_dir).select(
        "query_id", F.col("vec_id").alias("id"), (1 / (1 + F.col("distance"))).alias("score"), (F.col("rank") + 1000).alias("pos")
    )
    return fusion.dedupe_ids(a.unionByName(b)).withColumn("score", F.round("score", 6))


@query(
    "interleave_cohorts",
    f"""WITH {SQL_BM25}, {SQL_HYBRID}, c AS (SELECT query_id, 'document' AS cohort, doc_id AS id, rank FROM kw
      UNION ALL SELECT query_id, 'graph', doc_id, rank FROM vn),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id, cohort ORDER BY rank, id) AS turn FROM c)
    SELECT query_id, cohort, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY turn, cohort, id) AS position FROM t""",
)
def interleave_cohorts(spark, sf_dir):
    a = _keyword(spark, sf_dir).select("query_id", F.lit("document").alias("cohort"), F.col("doc_id").alias("id"), "rank")
    b = _vector(spark, sf_dir).select("query_id", F.lit("graph").alias("cohort"), F.col("vec_id").alias("id"), "rank")
    return fusion.interleave(a.unionByName(b))


SQL_SET = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1))"


@query(
    "rerank_overlap",
    f"""{SQL_HITS}, s AS (SELECT h.query_id, id, rank, CASE WHEN rank <= 10 THEN
      round(len(list_intersect({SQL_SET.format("h.text")}, {SQL_SET.format("q.query")}))::DOUBLE / len({SQL_SET.format("q.query")}), 6) END AS rerank_score
      FROM hits h JOIN q USING (query_id))
    SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score IS NULL, rerank_score DESC NULLS LAST, rank, id) AS final_rank FROM s""",
)
def rerank_overlap(spark, sf_dir):
    hits = _hits(spark, sf_dir).join(model.queries(spark, sf_dir), "query_id")
    wanted = token_set(F.col("query"))
    score = F.round(F.size(F.array_intersect(token_set(F.col("text")), wanted)) / F.size(wanted), 6)
    return fusion.rerank(hits, score, 10).select("query_id", "id", "rerank_score", "final_rank")


@query(
    "signature_dedupe",
    f"""{SQL_HITS} SELECT query_id, id, rank FROM hits
    QUALIFY row_number() OVER (PARTITION BY query_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) ORDER BY rank, id) = 1""",
)
def signature_dedupe(spark, sf_dir):
    from corpusq.functions.text import signature

    hits = _hits(spark, sf_dir).withColumn("signature", signature(F.col("text")))
    return fusion.signature_dedupe(hits).select("query_id", "id", "rank")


@query(
    "redundant_pairs",
    f"""{SQL_HITS}, t AS (SELECT query_id, id, text, {SQL_SET.format("text")} AS t FROM hits)
    SELECT a.query_id, a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)), 6) AS jaccard,
      round(len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)), 6) AS overlap
    FROM t a JOIN t b ON a.query_id = b.query_id AND a.id < b.id
    WHERE (least(length(a.text), length(b.text)) >= 80 AND contains(CASE WHEN length(a.text) <= length(b.text) THEN b.text ELSE a.text END,
        CASE WHEN length(a.text) <= length(b.text) THEN a.text ELSE b.text END))
      OR len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)) >= 0.85""",
)
def redundant_pairs(spark, sf_dir):
    """Hits of a query that are redundant with each other, by their whole texts.
    A query has a bounded number of hits, so its pairs are bounded too."""
    hits = _hits(spark, sf_dir).select("query_id", "id", "text", token_set(F.col("text")).alias("t"))
    hits = written(hits, "hits")
    a, b = hits.alias("a"), hits.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.id") < F.col("b.id")))
    found = pairs.where(redundant(F.col("a.text"), F.col("b.text"), F.col("a.t"), F.col("b.t")))
    return found.select(
        "a.query_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"),
        F.round(jaccard(F.col("a.t"), F.col("b.t")), 6).alias("jaccard"),
        F.round(overlap(F.col("a.t"), F.col("b.t")), 6).alias("overlap"),
    )


@query("context_groups", f"{SQL_HITS} SELECT query_id, count(DISTINCT kb_id) AS n_groups FROM hits GROUP BY 1")
def context_groups(spark, sf_dir):
    """Distinct knowledge bases, as parents, among a query's hits."""
    return fusion.context_groups(_hits(spark, sf_dir).withColumn("parent_id", F.col("kb_id")))


@query(
    "substring_index",
    f"""WITH {SQL_DOCS}, q AS (SELECT item_id AS query_id, unnest({sql_tokens("text")}) AS term FROM benchmark),
    t AS (SELECT DISTINCT query_id, term FROM q WHERE length(term) > 1), w AS (SELECT DISTINCT term FROM t),
    h AS (SELECT doc_id, term, ((length(low) - length(replace(low, term, ''))) // length(term)) * length(term) AS part
      FROM (SELECT doc_id, lower(text) AS low FROM docs) JOIN w ON contains(low, term))
    SELECT query_id, doc_id, sum(part)::DOUBLE AS score FROM h JOIN t USING (term) GROUP BY ALL""",
)
def substring_index(spark, sf_dir):
    """Scores of the lexical index by substrings, for every query and document that share one."""
    return lexical.substring_scores(model.documents(spark, sf_dir), model.queries(spark, sf_dir))


@query(
    "document_headers",
    f"""{SQL_HITS}, f AS (SELECT query_id, kb_id, min(rank) AS rank FROM hits GROUP BY ALL)
    SELECT query_id, kb_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM f""",
)
def document_headers(spark, sf_dir):
    """Sources of a query's hits in the order of their first hit."""
    from pyspark.sql import Window as W

    first = _hits(spark, sf_dir).groupBy("query_id", "kb_id").agg(F.min("rank").alias("rank"))
    w = W.partitionBy("query_id").orderBy("rank")
    return first.select("query_id", "kb_id", F.row_number().over(w).alias("position"))


@query("expanded_queries")
def expanded_queries(spark, sf_dir):
    """Variants of the benchmark texts, taken as questions."""
    from corpusq.functions.text import expand_query

    items = model.read(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.explode(expand_query(F.col("text"))).alias("variant"))


@query("mmr_select")
def mmr_select(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("tokens", token_set(F.col("text")))
    return fusion.mmr(hits, 10)


def _sql_greedy(name: str, source: str, ordered: str) -> str:
    """CTEs that keep, in an order, the rows of a query that are not redundant with a kept one before them."""
    pair = """(least(length(a.text), length(b.text)) >= 80 AND contains(CASE WHEN length(a.text) <= length(b.text) THEN b.text ELSE a.text END,
        CASE WHEN length(a.text) <= length(b.text) THEN a.text ELSE b.text END))
      OR len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)) >= 0.85"""
    return f"""{name}_o AS MATERIALIZED (SELECT query_id, id, text, {SQL_SET.format("text")} AS t, row_number() OVER (PARTITION BY query_id ORDER BY {ordered}) AS pos FROM {source}),
    {name}_r AS MATERIALIZED (SELECT b.query_id, b.pos, list(a.pos) AS near FROM {name}_o a JOIN {name}_o b ON a.query_id = b.query_id AND a.pos < b.pos WHERE {pair} GROUP BY ALL),
    {name}_g AS (SELECT DISTINCT query_id, 0::BIGINT AS pos, []::BIGINT[] AS kept FROM {name}_o
      UNION ALL SELECT g.query_id, o.pos, CASE WHEN list_has_any(g.kept, coalesce(near, []::BIGINT[])) THEN g.kept ELSE list_append(g.kept, o.pos) END
      FROM {name}_g g JOIN {name}_o o ON o.query_id = g.query_id AND o.pos = g.pos + 1 LEFT JOIN {name}_r r ON r.query_id = o.query_id AND r.pos = o.pos),
    {name}_k AS (SELECT query_id, max_by(kept, pos) AS kept FROM {name}_g GROUP BY 1),
    {name} AS (SELECT query_id, id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS nth FROM {name}_o JOIN {name}_k USING (query_id) WHERE list_contains(kept, pos))"""


@query(
    "greedy_dedupe",
    f"""{SQL_HITS.replace("WITH", "WITH RECURSIVE", 1)}, {_sql_greedy("kept", "hits", "rank, id")}
    SELECT query_id, id, rank FROM kept JOIN hits USING (query_id, id)""",
)
def greedy_dedupe(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("tokens", token_set(F.col("text")))
    return fusion.greedy_dedupe(hits)


#: Results of the strict pipeline; candidates are four times as many a route, twice as many are reranked.
RESULTS = TOP // 4
SQL_RERANKED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM hits),
  scored AS (SELECT h.*, CASE WHEN place <= {2 * RESULTS} THEN
    round(len(list_intersect({SQL_SET.format("h.text")}, {SQL_SET.format("q.query")}))::DOUBLE / len({SQL_SET.format("q.query")}), 6) END AS rerank_score
    FROM placed h JOIN q USING (query_id)),
  reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score IS NULL, rerank_score DESC NULLS LAST, place, id) AS final_rank FROM scored)"""


@query(
    "hybrid_search",
    f"""{SQL_HITS.replace("WITH", "WITH RECURSIVE", 1)}, {SQL_RERANKED},
    families AS (SELECT query_id, kb_id, min_by(id, final_rank) AS id, min(final_rank) AS final_rank FROM reranked GROUP BY ALL),
    told AS (SELECT f.*, text FROM families f JOIN docs ON doc_id = f.id), {_sql_greedy("kept", "told", "final_rank")}
    SELECT query_id, id, nth AS rank FROM kept WHERE nth <= {RESULTS}""",
)
def hybrid_search(spark, sf_dir):
    """The strict pipeline as one operator: both recalls, fusion, scope, reranking,
    collapse by parent (here the knowledge base), redundancy, and the cut last."""
    from corpusq.operators import search

    asked = model.queries(spark, sf_dir)
    docs = model.enabled_documents(spark, sf_dir).where(model.searchable()).select(
        F.col("doc_id").alias("id"), F.col("kb_id").alias("parent_id"), "text"
    )
    keyword = _keyword(spark, sf_dir).withColumnRenamed("doc_id", "id")
    near = _vector(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return search.strict(asked, keyword, near, docs, RESULTS)


@query(
    "guarded_recall",
    f"""WITH {SQL_BM25}, {SQL_HYBRID} SELECT query_id, id, rank FROM (
      SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM kw WHERE query_id % 2 = 1
      UNION ALL SELECT query_id, id, rank FROM fused WHERE query_id % 2 = 0)""",
)
def guarded_recall(spark, sf_dir):
    """Fusion where half of the queries have no vector: their list is the keyword recall."""
    keyword = _keyword(spark, sf_dir).withColumnRenamed("doc_id", "id")
    near = _vector(spark, sf_dir).withColumnRenamed("vec_id", "id").where("query_id % 2 = 0")
    return fusion.rrf(keyword, near).select("query_id", "id", "rank")


@query(
    "recall_degradations",
    """SELECT item_id AS query_id, CASE WHEN item_id % 10 = 0 THEN 'empty query' WHEN vec_id IS NULL THEN 'no vector' END AS reason
    FROM benchmark LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0) ON vec_id = item_id WHERE item_id % 10 = 0 OR vec_id IS NULL""",
)
def recall_degradations(spark, sf_dir):
    """Queries whose recall is degraded, with the reason, instead of an error."""
    from corpusq.operators import search

    asked = model.queries(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 10 == 0, " ").otherwise(F.col("query")))
    vectors = model.read(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("query_id"))
    return search.degradations(asked, vectors)


@query(
    "merged_cohorts",
    f"""WITH {SQL_BM25}, {SQL_HYBRID}, d AS (SELECT query_id, id, rank, text, {SQL_SET.format("text")} AS t FROM (SELECT query_id, kw.doc_id AS id, rank, text FROM kw JOIN docs USING (doc_id))),
    g AS (SELECT query_id, id, rank, text, {SQL_SET.format("text")} AS t FROM (SELECT query_id, vn.doc_id AS id, rank, text FROM vn JOIN docs USING (doc_id))),
    m AS (SELECT a.query_id, a.id, min_by(b.id, b.rank * 1000000 + b.id) AS merged_into FROM g a JOIN d b USING (query_id)
      WHERE (least(length(a.text), length(b.text)) >= 80 AND contains(CASE WHEN length(a.text) <= length(b.text) THEN b.text ELSE a.text END,
        CASE WHEN length(a.text) <= length(b.text) THEN a.text ELSE b.text END)) OR len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)) >= 0.85 GROUP BY ALL)
    SELECT query_id, id, merged_into FROM g LEFT JOIN m USING (query_id, id)""",
)
def merged_cohorts(spark, sf_dir):
    """Vector hits, each with the first keyword hit of its query that says the same."""
    docs = model.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", token_set(F.col("text")).alias("tokens"))
    first = _keyword(spark, sf_dir).withColumnRenamed("doc_id", "id").join(docs, "id")
    second = _vector(spark, sf_dir).withColumnRenamed("vec_id", "id").join(docs, "id")
    return fusion.merge_cohorts(first, second).select("query_id", "id", "merged_into")


@query(
    "evidence_overlap_join",
    """WITH e AS (SELECT b.item_id AS query_id, d.doc_id, strpos(d.text, b.text) - 1 AS e_start,
      strpos(d.text, b.text) - 1 + length(b.text) AS e_end FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    w AS (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars, 1), 400)) AS start_at FROM documents)
    SELECT query_id, e.doc_id, start_at, least(start_at + 512, n_chars) AS end_at, e_start, e_end
    FROM e JOIN w ON w.doc_id = e.doc_id AND start_at < e_end AND least(start_at + 512, n_chars) > e_start""",
)
def evidence_overlap_join(spark, sf_dir):
    docs = model.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    evidence = model.passages(spark, sf_dir)
    windows = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.greatest("n_chars", F.lit(1)) - 1, F.lit(400))).alias("start_at"))
    spans = windows.select("doc_id", "start_at", F.least(F.col("start_at") + 512, F.col("n_chars")).alias("end_at"))
    met = spans.join(evidence, "doc_id").where(
        evaluation.overlaps(F.col("start_at"), F.col("end_at"), F.col("e_start"), F.col("e_end"))
    )
    return met.select("query_id", "doc_id", "start_at", "end_at", "e_start", "e_end")


SQL_TURNS = "docs AS (SELECT conv_id * 1000 + turn AS doc_id, '' AS title, text FROM conversations)"


@query("chat_history_search", f"WITH {SQL_BM25.replace(SQL_DOCS, SQL_TURNS)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM kw")
def chat_history_search(spark, sf_dir):
    """The keyword recall over the turns of conversations."""
    c = model.read(spark, sf_dir, "conversations")
    turns = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit("").alias("title"), "text")
    found = lexical.bm25_top_k(turns, model.queries(spark, sf_dir), TOP)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("expanded_recall")
def expanded_recall(spark, sf_dir):
    """Hits of the benchmark queries with those of their variants where they come from too few knowledge bases."""
    from corpusq.functions.text import expand_query
    from corpusq.operators import search

    docs = model.enabled_documents(spark, sf_dir).where(model.searchable()).select("doc_id", "kb_id", "title", "text")
    parents = docs.select(F.col("doc_id").alias("id"), F.col("kb_id").alias("parent_id"))
    asked = model.queries(spark, sf_dir)
    # queries and variants in one recall, the query itself as variant -1
    variants = asked.select("query_id", F.posexplode(expand_query(F.col("query"))).alias("variant", "query"))
    every = asked.select("query_id", F.lit(-1).alias("variant"), "query").unionByName(variants)
    keyed = every.select(F.struct("query_id", "variant").alias("query_id"), "query")
    found = lexical.bm25_top_k(docs, keyed, 2 * TOP)
    found = written(found.select("query_id.query_id", "query_id.variant", F.col("doc_id").alias("id"), "rank").join(parents, "id"), "recalls")
    hits = found.where((F.col("variant") < 0) & (F.col("rank") <= TOP)).drop("variant")
    out = search.expand_recall(hits, found.where("variant >= 0"), 15)
    return out.select("query_id", "id", "variant", "rank", F.round("score", 9).alias("score"))
