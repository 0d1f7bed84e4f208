"""The chat pipeline as one query: from recall to interleaved contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import model
from corpusq.functions.text import candidate_names
from corpusq.operators import chunking, graph, lexical, search, vector
from corpusq.plans.graphs import document_graphs, entity_graph
from corpusq.registry import query
from corpusq.tables import planned, written

#: Contexts of a query; each recall gives four times as many hits.
CONTEXTS = 5
#: Bits of a chunk's id that number it within its document, and chunks of a parent.
CHUNK_BITS, FAMILY = 24, 8
#: Documents that the chunker takes at once.
TEXTS = "1000"


def chat_chunks(spark, sf_dir):
    """Chunks of the searchable documents, written: those of odd documents have parents
    of eight chunks, those of even documents none.  Tenants are told by doc_id."""
    docs = model.enabled_documents(spark, sf_dir).where(model.searchable()).select("doc_id", "text")
    number = F.shiftleft(F.col("doc_id").cast("long"), CHUNK_BITS)
    family = number + F.floor(F.col("chunk_index") / FAMILY)
    cut = chunking.fixed_chunks(docs).select(
        "doc_id", "chunk_index", "start_at", "end_at", "content", (number + F.col("chunk_index")).alias("id"),
        F.when(F.pmod("doc_id", F.lit(2)) == 1, family).alias("parent_id"),
    )
    with planned(spark, spark__sql__execution__arrow__maxRecordsPerBatch=TEXTS):
        return written(cut, "chat-chunks")


def _related(near, hits):
    """Edges from the chunks hit to chunks of their documents: direct, and by one chunk between."""
    names = near.select("doc_id", F.col("id").alias("chunk_id"), candidate_names(F.col("content")).alias("names"))
    edges, scope, starts = document_graphs(names), ("doc_id",), hits.select(F.col("id").alias("a"))
    direct = graph.top_neighbours(edges.join(starts, "a", "left_semi"), scope=scope)
    return direct, graph.top_neighbours(graph.two_hop(edges, scope=scope, starts=starts, most=8), scope=scope)


@query("chat_search")
def chat_search(spark, sf_dir):
    """Contexts for the benchmark texts, as a chat would ask for them: keyword recall over
    chunks, a document's vector standing for its first chunk, variants where hits come
    from too few parents, graphs of each tenant, parents and neighbours, diversity, turns."""
    asked = model.queries(spark, sf_dir)
    chunks = chat_chunks(spark, sf_dir)
    recall = lexical.recall_over(chunks.select("id", F.lit("").alias("title"), F.col("content").alias("text")), asked, "id")
    vectors = model.read(spark, sf_dir, "embeddings")
    own = asked.join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")
    near = vector.knn(vectors, own, 4 * CONTEXTS)
    first = near.select("query_id", F.shiftleft(F.col("vec_id").cast("long"), CHUNK_BITS).alias("id"), "rank")
    tenant = F.pmod("doc_id", F.lit(4)).alias("tenant_id")
    names = written(chunks.select(tenant, "id", F.array_sort(candidate_names(F.col("content"))).alias("names")), "chat-names")
    terms = asked.select("query_id", F.explode(candidate_names(F.col("query"))).alias("term"))
    texts = model.read(spark, sf_dir, "documents").select("doc_id", "text")
    return search.chat(
        asked, recall(asked, 4 * CONTEXTS), first, chunks, texts, recall,
        lambda seen, k: graph.search(terms, *entity_graph(names, "tenant_id"), seen, k, scope="tenant_id"), _related, CONTEXTS,
    )
