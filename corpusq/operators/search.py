"""Search pipelines for batches of queries, composed of recall, fusion and context operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusq.functions.text import expand_query, token_set
from corpusq.operators import fusion, graph, retrieval_context
from corpusq.tables import sized, written

#: Characters under which a chunk without parent takes its neighbours, and up to which.
SHORT, ENOUGH = 350, 850


def degradations(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, reason) of queries (query_id, query) that a route cannot serve:
    without words, or without a row in ``vectors`` (query_id).  Their recall by
    that route is empty; the other route still answers."""
    known = vectors.select("query_id", F.lit(True).alias("known"))
    reason = F.when(F.size(token_set(F.col("query"))) == 0, "empty query").when(F.col("known").isNull(), "no vector")
    joined = queries.join(known, "query_id", "left").withColumn("reason", reason)
    return joined.where("reason is not null").select("query_id", "reason")


def strict(queries: DataFrame, keyword: DataFrame, vector: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank): the best k of each query.

    ``keyword`` and ``vector`` are ranked recalls of 4 k each (query_id, id, rank);
    ``docs`` (id, parent_id, text) is the scope.  Lists are fused; hits outside
    the scope go; the first 2 k are reranked by the share of the query's words
    that they hold; hits of one parent become its best hit; what is redundant
    with a better hit goes; and the cut comes last, so it is k of what is left."""
    fused = fusion.rrf(keyword, vector).select("query_id", "id", "rank")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    hits = fused.join(docs, "id").withColumn("rank", place)
    wanted = queries.select("query_id", token_set(F.col("query")).alias("wanted")).where("size(wanted) > 0")
    tokens = token_set(F.col("text"))
    share = F.round(F.size(F.array_intersect(tokens, F.col("wanted"))) / F.size("wanted"), 6)
    ranked = fusion.rerank(hits.join(wanted, "query_id"), share, 2 * k)
    one = retrieval_context.collapse_siblings(
        ranked.select("query_id", "id", "parent_id", F.col("final_rank").alias("rank"), F.col("rerank_score").alias("score"))
    ).select("query_id", "id", "rank")
    told = one.join(docs.select("id", "text"), "id").withColumn("tokens", token_set(F.col("text")))
    kept = fusion.greedy_dedupe(told)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "id"))
    return kept.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "id", "rank")


def expand_recall(hits: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """(query_id, id, variant, rank, score): hits (query_id, id, rank, parent_id) of a
    query, variant null, and where they have fewer than k parents those that its
    variants add (query_id, variant, id, rank, parent_id), one variant after
    another until there are k parents.  An added hit scores 1 / (60 + its rank in
    the variant's list + how many hits there were before the variant)."""
    own = hits.select("query_id", "id", "parent_id")
    unseen = more.join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = unseen.groupBy("query_id", "id").agg(F.min(F.struct("variant", "rank")).alias("at"), F.first("parent_id").alias("parent_id"))
    added = first.select("query_id", "id", "parent_id", "at.variant", "at.rank")
    start = F.lit(-1).alias("variant")
    seen = own.select("query_id", "parent_id", start).unionByName(added.select("query_id", "parent_id", "variant"))
    parents = seen.groupBy("query_id", "parent_id").agg(F.min("variant").alias("variant"))
    new_parents = parents.groupBy("query_id", "variant").agg(F.count(F.lit(1)).alias("parents"))
    new_hits = own.select("query_id", start).unionByName(added.select("query_id", "variant")).groupBy("query_id", "variant").agg(F.count(F.lit(1)).alias("hits"))
    # a row for each variant of a query: what there was before it
    before = W.partitionBy("query_id").orderBy("variant").rowsBetween(W.unboundedPreceding, -1)
    counts = new_hits.join(new_parents, ["query_id", "variant"], "left").select(
        "query_id", "variant", F.sum("hits").over(before).alias("hits_before"),
        F.coalesce(F.sum(F.coalesce("parents", F.lit(0))).over(before), F.lit(0)).alias("parents_before"),
    )
    used = counts.where((F.col("parents_before") < k) & (F.col("variant") >= 0))
    score = 1 / (fusion.RRF_K + F.col("rank") + F.coalesce("hits_before", F.lit(0)))
    taken = added.join(used, ["query_id", "variant"]).select("query_id", "id", "variant", "rank", score.alias("score"))
    kept = hits.select("query_id", "id", F.lit(None).cast("int").alias("variant"), "rank", F.lit(None).cast("double").alias("score"))
    return kept.unionByName(taken)


def _groups(chunks: DataFrame) -> DataFrame:
    """Chunks with ``parent_id`` as a string, their own where they have none."""
    own = F.coalesce(F.concat(F.lit("p"), F.col("parent_id").cast("string")), F.concat(F.lit("c"), F.col("id").cast("string")))
    return chunks.withColumn("parent_id", own)


def _contexts(rows: DataFrame, near: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, id, doc_id, parent_id, child_ids, rank, score, text, tokens): the
    hits of a cohort (query_id, id, rank, score, shown) as contexts, in order and
    without what is redundant with a better one.  Hits of one parent become one
    context, the parent's text between the starts and ends of its chunks, cut to
    ``CONTEXT_CHARS`` around the hits; others keep the text ``shown``."""
    hits = rows.join(near.select("id", "doc_id", "parent_id", "start_at", "end_at"), "id")
    one = retrieval_context.collapse_siblings(hits).drop("child_rank")
    ranges = near.where("parent_id is not null").groupBy("parent_id").agg(F.min("start_at").alias("p_start"), F.max("end_at").alias("p_end"))
    evidence = hits.where("parent_id is not null").groupBy("query_id", "parent_id", "doc_id").agg(
        F.min("start_at").alias("e_start"), F.max("end_at").alias("e_end"),
        F.min_by(F.struct("start_at", "end_at"), F.struct("rank", "id")).alias("first"),
    ).join(ranges, "parent_id")
    at = [F.col(c) - F.col("p_start") for c in ("e_start", "e_end", "first.start_at", "first.end_at")]
    begin, end = retrieval_context.evidence_window(F.col("p_end") - F.col("p_start"), *at)
    spans = written(evidence.select("query_id", "parent_id", "doc_id", (F.col("p_start") + begin + 1).alias("begin"), (end - begin).alias("size")), "spans")
    cut = F.col("text").substr(F.col("begin").cast("int"), F.col("size").cast("int"))
    parents = texts.join(sized(spans), "doc_id").select("query_id", "parent_id", F.trim(cut).alias("parent_text"))
    told = one.join(hits.select("query_id", "id", "doc_id", "shown"), ["query_id", "id"]).join(parents, ["query_id", "parent_id"], "left")
    told = told.withColumn("text", F.coalesce("parent_text", "shown")).drop("parent_text", "shown").withColumn("tokens", token_set(F.col("text")))
    told = written(told, "contexts")
    return told.join(fusion.greedy_dedupe(told).select("query_id", "id"), ["query_id", "id"], "left_semi")


def chat(
    queries: DataFrame,
    keyword: DataFrame,
    vector: DataFrame,
    chunks: DataFrame,
    texts: DataFrame,
    recall: Callable[[DataFrame, int], DataFrame],
    graph_search: Callable[[DataFrame, int], DataFrame],
    related: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    k: int,
) -> DataFrame:
    """(query_id, position, cohort, id, doc_id, parent_id, child_ids, score, text, merged):
    the k contexts of each query (query_id, query), a stated set.

    ``keyword`` and ``vector`` are ranked recalls (query_id, id, rank) of ids of
    ``chunks`` (id, doc_id, chunk_index, parent_id, start_at, end_at, content), the
    scope; ``texts`` (doc_id, text) are the texts they were cut from.

    1. The lists are fused and the first 2 k hits of the scope stay.
    2. Queries with hits from fewer than k parents, and only they, ask ``recall`` for
       2 k hits of their variants, one after another until there are k parents.
    3. All are reranked by the share of the query's words that they hold.
    4. ``graph_search`` (given what was seen, and k) adds a cohort of graph hits
       (query_id, id, position); behind them come three chunks that ``related`` names
       (direct and indirect edges (a, b, rank) from the chunks hit, given as ids, to
       chunks of their documents).
    5. Chunks without parent that are short take the text of their neighbours;
       hits of a parent become the parent's text.
    6. In each cohort what is redundant with a better context goes, and a graph context
       that says what a document context says is merged into it (``merged``).
    7. Document contexts are chosen by relevance and diversity, 2 k of them, and
       ordered by rank again; no document has over max(2, k); the cohorts take turns.

    A query without words or vector has what is left; one without any hit has no row.
    Chunk texts are met with broadcast ids where they are; from step 4 on only the
    documents that were hit are read, from a written table."""
    ids = chunks.select("id", "parent_id")
    fused = fusion.rrf(keyword, vector).select("query_id", "id", "rank")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    hits = ids.join(sized(written(fused, "fused")), "id").withColumn("rank", place).where(F.col("rank") <= 2 * k)
    hits = written(hits, "chat-hits")
    few = queries.join(fusion.context_groups(hits), "query_id", "left").where(F.coalesce("n_groups", F.lit(0)) < k)
    variants = written(few.select("query_id", F.posexplode(expand_query(F.col("query"))).alias("variant", "query")), "variants")
    keyed = variants.select(F.struct("query_id", "variant").alias("query_id"), "query")
    if variants.isEmpty():
        more = hits.select("query_id", F.lit(0).alias("variant"), "id", "rank", "parent_id").limit(0)
    else:
        asked = recall(keyed, 2 * k).select("query_id.query_id", "query_id.variant", "id", "rank")
        more = written(ids.join(sized(written(asked, "variant-hits")), "id"), "variant-hits")
    candidates = expand_recall(_groups(hits), _groups(more), k)
    order = W.partitionBy("query_id").orderBy(F.col("variant").asc_nulls_first(), "rank", "id")
    candidates = written(candidates.select("query_id", "id", F.row_number().over(order).alias("rank")), "candidates")

    added = written(graph_search(candidates.select("query_id", "id"), k).select("query_id", "id", "position"), "graph-hits")
    every = written(candidates.select("id").union(added.select("id")).distinct(), "hit-ids")
    docs = written(chunks.join(sized(every), "id").select("doc_id").distinct(), "hit-documents")
    near = written(chunks.join(sized(docs), "doc_id"), "near-chunks")

    wanted = queries.select("query_id", token_set(F.col("query")).alias("wanted"))
    told = candidates.join(near.select("id", "content"), "id").join(wanted, "query_id")
    share = F.size(F.array_intersect(token_set(F.col("content")), F.col("wanted"))) / F.size("wanted")
    ranked = fusion.rerank(told, F.when(F.size("wanted") > 0, F.round(share, 6)), fusion.NO_RANK)
    ranked = written(ranked.select("query_id", "id", F.col("final_rank").alias("rank"), F.coalesce("rerank_score", F.lit(0.0)).alias("score")), "reranked")

    last = ranked.groupBy("query_id").agg(F.max("rank").alias("last"))
    behind = added.join(last, "query_id", "left").select("query_id", "id", (F.coalesce("last", F.lit(0)) + F.col("position")).alias("rank"))
    direct, indirect = related(near, every)
    beside = graph.expand_relations(ranked.select("query_id", "id", "rank").unionByName(behind), direct, indirect, min(3, k))
    beside = written(beside.select("query_id", F.col("next").alias("id"), (F.col("position") + k).alias("position")), "related-hits")
    graph_hits = added.unionByName(beside)

    flat = near.where("parent_id is null")
    short = flat.where(F.length("content") < SHORT).join(sized(every), "id", "left_semi").select("doc_id").distinct()
    wide = retrieval_context.expand_short(flat.join(short, "doc_id", "left_semi"), SHORT, ENOUGH)
    shown = near.join(wide, ["doc_id", "chunk_index"], "left").select("id", F.coalesce("expanded", "content").alias("shown"))
    documents = written(_contexts(ranked.join(shown, "id"), near, texts), "document-contexts")
    plain = near.select("id", F.col("content").alias("shown"))
    seconds = graph_hits.select("query_id", "id", F.col("position").alias("rank"), F.lit(0.0).alias("score")).join(plain, "id")
    seconds = written(fusion.merge_cohorts(documents, _contexts(seconds, near, texts)), "graph-contexts")

    merged = seconds.where("merged_into is not null").groupBy("query_id", F.col("merged_into").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("merged")
    )
    chosen = fusion.mmr(documents, 2 * k).select("query_id", "id")
    lists = (documents.join(chosen, ["query_id", "id"], "left_semi"), seconds.where("merged_into is null").drop("merged_into"))
    capped = [fusion.per_document_cap(x, max(2, k)).withColumn("cohort", F.lit(c)) for c, x in enumerate(lists)]
    turns = fusion.interleave(reduce(DataFrame.unionByName, capped)).where(F.col("position") <= k)
    out = turns.join(merged.select("query_id", "id", F.transform("merged", lambda m: m["id"]).alias("merged"), F.lit(0).alias("cohort")), ["query_id", "id", "cohort"], "left")
    return out.select(
        "query_id", "position", F.when(F.col("cohort") == 0, "document").otherwise("graph").alias("cohort"),
        "id", "doc_id", "parent_id", "child_ids", "score", "text", "merged",
    )
