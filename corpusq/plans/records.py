"""Queries over records of the engine: scopes, wiki pages, sessions, memory, evidence cases, queues and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq import model
from corpusq.functions import text as T
from corpusq.operators import catalog, chunking, evaluation, graph, history, lexical, retrieval_context, wiki
from corpusq.plans import graphs
from corpusq.plans.chunks import SQL_CHUNKS
from corpusq.plans.graphs import NAMES
from corpusq.registry import query
from corpusq.sources import sinks
from corpusq.streaming import jobs
from corpusq.tables import shared_folder, written


def _chunks(spark, sf_dir):
    return chunking.fixed_chunks(model.read(spark, sf_dir, "documents").select("doc_id", "text"))


# scopes and lists

SQL_BASES = """bases AS (SELECT source AS kb_id, CASE WHEN source LIKE '%3' THEN 2 ELSE 1 END AS b_tenant, source = 'src5' AS b_deleted,
  (len(source) % 2)::INT AS creator_id, 'base of ' || count(*) || ' documents' AS description, source LIKE '%4' AS wiki_enabled,
  CASE WHEN source LIKE '%1' THEN 'wiki' ELSE 'document' END AS type FROM documents GROUP BY source)"""


def _bases(spark, sf_dir):
    source = F.col("source")
    return model.read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        source.alias("kb_id"), F.when(source.like("%3"), 2).otherwise(1).alias("b_tenant"), (source == "src5").alias("b_deleted"),
        (F.length(source) % 2).alias("creator_id"), F.concat(F.lit("base of "), "n", F.lit(" documents")).alias("description"),
        source.like("%4").alias("wiki_enabled"), F.when(source.like("%1"), "wiki").otherwise("document").alias("type"),
    )


@query(
    "chunk_scope",
    f"""WITH {SQL_CHUNKS}, {SQL_BASES},
    k AS (SELECT doc_id, source, (CASE WHEN doc_id % 13 = 0 THEN doc_id + 1 ELSE doc_id END) % 4 AS d_tenant, doc_id % 17 = 0 AS d_deleted FROM documents)
    SELECT c.doc_id, chunk_index FROM c JOIN k USING (doc_id) JOIN bases ON bases.kb_id = source
    WHERE c.doc_id % 4 = 1 AND chunk_index % 7 <> 6 AND d_tenant = 1 AND NOT d_deleted AND b_tenant = 1 AND NOT b_deleted AND chunk_index % 11 <> 10""",
)
def chunk_scope(spark, sf_dir):
    """Chunks of a tenant whose document and base agree with them and are all alive."""
    docs = model.read(spark, sf_dir, "documents")
    k = docs.select(
        "doc_id", F.col("source").alias("d_kb_id"), (F.col("doc_id") % 17 == 0).alias("d_deleted"),
        ((F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)) % 4).alias("d_tenant"),
    )
    chunks = _chunks(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id").select(
        "doc_id", "chunk_index", (F.col("doc_id") % 4).alias("tenant_id"), (F.col("chunk_index") % 7 == 6).alias("deleted"),
        F.when(F.col("chunk_index") % 11 == 10, "elsewhere").otherwise(F.col("source")).alias("kb_id"),
    )
    return catalog.consistent_chunks(chunks, k, _bases(spark, sf_dir), 1).select("doc_id", "chunk_index")


@query(
    "base_list",
    f"""WITH {SQL_BASES}, l AS (SELECT * FROM bases WHERE NOT b_deleted)
    SELECT 'mine' AS list, kb_id FROM l WHERE creator_id = 1 UNION ALL SELECT 'others', kb_id FROM l WHERE creator_id <> 1
    UNION ALL SELECT 'keyword', kb_id FROM l WHERE contains(lower(kb_id), '1') OR contains(lower(description), '1')
    UNION ALL SELECT 'wiki', kb_id FROM l WHERE type = 'wiki' OR wiki_enabled UNION ALL SELECT 'document', kb_id FROM l WHERE type = 'document'""",
)
def base_list(spark, sf_dir):
    """Knowledge bases by creator, keyword and type; a question base lists none."""
    live = _bases(spark, sf_dir).where("not b_deleted")
    lists = {
        "mine": catalog.base_filter(creator="mine", user=1), "others": catalog.base_filter(creator="others", user=1),
        "keyword": catalog.base_filter(keyword="1"), "wiki": catalog.base_filter(kind="wiki"),
        "document": catalog.base_filter(kind="document"), "faq": catalog.base_filter(kind="faq"),
    }
    # one pass over the bases: each is dealt to the lists that it is in
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lists.items()]))
    return live.select(F.explode(names).alias("list"), "kb_id")


SQL_RECORDS = """records AS (SELECT event_id, 't' || (user_id % 5) AS tag_id, event_type AS status, CASE WHEN event_id % 3 = 0 THEN 'pdf' ELSE 'txt' END AS file_type,
  CASE WHEN event_id % 7 = 0 THEN 'url' ELSE 'file' END AS type, 'u' || (user_id % 10) AS kb_id, ts AS created_at, props, event_type || '-' || user_id AS title FROM events)"""


@query(
    "record_filter",
    f"""WITH {SQL_RECORDS}, f AS (SELECT event_id, unnest([CASE WHEN tag_id = 't2' THEN 'tag' END, CASE WHEN status IN ('click', 'view') THEN 'status' END,
      CASE WHEN file_type IN ('pdf', 'url') OR type IN ('pdf', 'url') THEN 'type' END, CASE WHEN kb_id = 'u3' THEN 'source' END,
      CASE WHEN created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-12 12:00:00' THEN 'time' END,
      CASE WHEN contains(lower(title), 'click-1') OR contains(lower(props->>'$.k'), '7') THEN 'keyword' END,
      CASE WHEN tag_id = 't2' AND status = 'click' AND file_type = 'pdf' AND created_at >= TIMESTAMP '2024-01-10 00:00:00' THEN 'all' END]) AS filter FROM records)
    SELECT * FROM f WHERE filter IS NOT NULL""",
)
def record_filter(spark, sf_dir):
    """Records by every branch of the filter builder, alone and together."""
    i = F.col("event_id")
    records = model.read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tag_id"), F.col("event_type").alias("status"),
        F.when(i % 3 == 0, "pdf").otherwise("txt").alias("file_type"), F.when(i % 7 == 0, "url").otherwise("file").alias("type"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("kb_id"), F.col("ts").alias("created_at"), "props",
        F.concat_ws("-", "event_type", "user_id").alias("title"),
    )
    build = catalog.document_filter
    filters = {
        "tag": build(tag="t2"), "status": build(statuses=["click", "view"]), "type": build(file_types=["pdf", "url"]), "source": build(source="u3"),
        "time": build(start="2024-01-10 00:00:00", end="2024-01-12 12:00:00"),
        "keyword": build(keyword="Click-1", columns=("title",)) | build(keyword="7", columns=(), json_path=("props", "$.k")),
        "all": build(tag="t2", statuses=["click"], start="2024-01-10 00:00:00") & (F.col("file_type") == "pdf"),
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in filters.items()]))
    return records.select("event_id", F.explode(names).alias("filter"))


@query(
    "reindex_needed",
    """SELECT source AS kb_id, CASE WHEN source LIKE '%9' THEN NULL ELSE 'fixed/512' END AS was, CASE WHEN source LIKE '%7' THEN 'fixed/256' ELSE 'fixed/512' END AS config
    FROM (SELECT DISTINCT source FROM documents) WHERE source LIKE '%7' OR source LIKE '%9'""",
)
def reindex_needed(spark, sf_dir):
    """Bases whose configuration is no longer that of their last index, or that have none."""
    bases = model.read(spark, sf_dir, "documents").select(F.col("source").alias("kb_id")).distinct()
    current = bases.withColumn("config", F.when(F.col("kb_id").like("%7"), "fixed/256").otherwise("fixed/512"))
    effective = bases.where(~F.col("kb_id").like("%9")).withColumn("config", F.lit("fixed/512"))
    return chunking.needs_reindex(effective, current)


@query(
    "semantic_cache_misses",
    f"WITH {SQL_CHUNKS} SELECT DISTINCT md5(content) AS content_hash FROM c WHERE md5(content) NOT IN (SELECT md5(content) FROM c WHERE (doc_id + chunk_index) % 3 <> 0)",
)
def semantic_cache_misses(spark, sf_dir):
    """Texts whose vectors the cache lacks; a vector of another model is none."""
    keyed = _chunks(spark, sf_dir).select(
        "doc_id", "chunk_index", F.md5("content").alias("content_hash"), F.lit("m1").alias("model_signature"), F.lit(1).alias("version"),
        F.lit(3).alias("window"), F.lit(90.0).alias("percentile"),
    )
    i = F.col("doc_id") + F.col("chunk_index")
    cache = keyed.where(i % 3 == 1).unionByName(keyed.where(i % 3 == 2)).unionByName(keyed.where(i % 3 == 0).withColumn("model_signature", F.lit("m0")))
    cache = cache.drop("doc_id", "chunk_index").distinct()
    return chunking.semantic_cache_misses(keyed.drop("doc_id", "chunk_index").distinct(), cache).select("content_hash")


@query(
    "missing_endpoints",
    f"""WITH n AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, {NAMES}, 1))) AS l FROM documents),
    m AS (SELECT DISTINCT unnest(l) AS name FROM n WHERE doc_id % 2 = 0), r AS (SELECT DISTINCT unnest(l) AS name FROM n WHERE len(l) > 1)
    SELECT name FROM r WHERE name NOT IN (SELECT name FROM m)""",
)
def missing_endpoints(spark, sf_dir):
    """Names that relations use and that no entity of half of the documents has."""
    names = graphs._names(spark, sf_dir)
    entities = graph.merge_entities(names.where("chunk_id % 2 = 0").select("chunk_id", F.explode("names").alias("name")))
    return graph.missing_endpoints(entities, graph.merge_relations(graphs._neighbours(names)))


@query(
    "document_list",
    f"SELECT doc_id, title, kb_id, n_chars FROM ({model.SQL_DOCUMENTS}) WHERE NOT deleted",
)
def document_list(spark, sf_dir):
    """The list view of documents, without text and hash: the scan reads neither."""
    return model.documents(spark, sf_dir).where(model.active()).select("doc_id", "title", "kb_id", "n_chars")


SQL_WIKI_PAGES = """wiki_pages AS (SELECT CASE WHEN page_id % 50 = 7 THEN 'index' ELSE 'page/' || page_id END AS slug, page_id, html AS content,
  CASE WHEN page_id % 10 = 0 THEN 'index' ELSE 'page' END AS page_type, regexp_extract(html, '<title>([^<]*)', 1) AS title, page_id % 17 = 0 AS deleted FROM pages)"""


def _wiki_pages(spark, sf_dir):
    i = F.col("page_id")
    return model.read(spark, sf_dir, "pages").select(
        F.when(i % 50 == 7, "index").otherwise(F.concat(F.lit("page/"), i.cast("string"))).alias("slug"), "page_id",
        F.col("html").alias("content"), F.when(i % 10 == 0, "index").otherwise("page").alias("page_type"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), (i % 17 == 0).alias("deleted"),
    )


@query("visible_wiki_pages", f"WITH {SQL_WIKI_PAGES} SELECT page_id, slug, title FROM wiki_pages WHERE NOT deleted AND page_type <> 'index' AND slug <> 'index'")
def visible_wiki_pages(spark, sf_dir):
    return wiki.visible(_wiki_pages(spark, sf_dir)).select("page_id", "slug", "title")


@query(
    "wiki_search",
    f"""WITH {SQL_WIKI_PAGES} SELECT page_id, title FROM wiki_pages WHERE NOT deleted AND page_type <> 'index' AND slug <> 'index'
    AND (contains(lower(title), 'anat') OR contains(lower(content), 'anat')) ORDER BY title, page_id LIMIT 50""",
)
def wiki_search(spark, sf_dir):
    """The first fifty visible pages by title that hold a word: a limited list."""
    return wiki.search(_wiki_pages(spark, sf_dir), "anat", 50).select("page_id", "title")


@query(
    "session_messages",
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 4 = 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 50",
)
def session_messages(spark, sf_dir):
    """The last fifty messages of each session of a tenant."""
    c = model.read(spark, sf_dir, "conversations")
    sessions = c.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 4).alias("tenant_id"))
    return history.of_tenant(c, sessions, "conv_id", 2, "turn", 50).select("conv_id", "turn", "role")


@query(
    "member_users",
    "SELECT s_suppkey AS user_id, c_name AS name FROM supplier JOIN customer ON c_custkey = s_suppkey WHERE s_nationkey % 4 = 3",
)
def member_users(spark, sf_dir):
    """Members of a tenant with the names of their users."""
    members = model.read(spark, sf_dir, "supplier").where("s_nationkey % 4 = 3").select(F.col("s_suppkey").alias("user_id"))
    users = model.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return members.join(users, "user_id")


@query(
    "sample_chunks",
    f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_index FROM c ORDER BY md5('7|' || doc_id || ':' || chunk_index), doc_id || ':' || chunk_index LIMIT 200",
)
def sample_chunks(spark, sf_dir):
    """Two hundred chunks in the order of a seeded hash: a sample that reruns repeat."""
    named = _chunks(spark, sf_dir).withColumn("key", F.concat_ws(":", "doc_id", "chunk_index"))
    return catalog.seeded_sample(named, "key", 200, seed=7).select("doc_id", "chunk_index")


@query(
    "like_fallback",
    "SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) <= 20",
)
def like_fallback(spark, sf_dir):
    """Recall of queries that the index cannot read: documents that hold the query as it is."""
    return lexical.containing(model.read(spark, sf_dir, "documents"), model.queries(spark, sf_dir), 20)


@query(
    "string_functions",
    r"""SELECT doc_id, tokens_context, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(s)), '\s+', '-', 'g'), '[^0-9a-zA-Z\x{4e00}-\x{9fff}/_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 160), ''), 'page') AS slug,
      regexp_full_match(lower(h), '[0-9a-f]{64}') AS is_hash, list_sort(regexp_extract_all(s, '\[\[([^\]|]+)', 1)) AS links
    FROM (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE lang END) AS h, coalesce(text, '') || ' [[a' || doc_id || ']] [[b|c]]' AS s,
      floor(length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) / 1.5 + length(regexp_replace(text, '[\x{4E00}-\x{9FFF}]', '', 'g')) / 4.0)::BIGINT AS tokens_context FROM documents)""",
)
def string_functions(spark, sf_dir):
    """Slugs, hashes, links and context tokens of strings made from the documents."""
    d = model.read(spark, sf_dir, "documents")
    s = F.concat(F.coalesce("text", F.lit("")), F.lit(" [[a"), F.col("doc_id").cast("string"), F.lit("]] [[b|c]]"))
    h = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise(F.col("lang"))
    rows = d.select("doc_id", "text", s.alias("s"), h.alias("h"))
    return rows.select(
        "doc_id", T.tokens_for_context(F.col("text")).alias("tokens_context"), T.wiki_slug(F.col("s")).alias("slug"),
        T.valid_sha256(F.col("h")).isNotNull().alias("is_hash"), F.array_sort(T.wiki_links(F.col("s"))).alias("links"),
    )


# chunk rules on damaged chunks

SQL_DAMAGED = f"""{SQL_CHUNKS},
damaged AS (SELECT doc_id, chunk_index, end_at, CASE WHEN chunk_index % 13 = 6 THEN 0 ELSE start_at END AS start_at,
  CASE WHEN chunk_index % 7 = 3 THEN '' WHEN chunk_index % 9 = 4 THEN content || 'x' ELSE content END AS content FROM c WHERE NOT (doc_id % 3 = 0 AND chunk_index = 1))"""


@query(
    "chunk_validation",
    f"""WITH {SQL_DAMAGED},
    p AS (SELECT damaged.*, text, lag(start_at) OVER w AS before_start, max(end_at) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM damaged JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
    v AS (SELECT doc_id, unnest([CASE WHEN trim(content) = '' THEN 'empty' END, CASE WHEN start_at <= before_start THEN 'order' END,
      CASE WHEN trim(substr(text, start_at + 1, end_at - start_at), ' ' || chr(10) || chr(9) || chr(13)) <> trim(content, ' ' || chr(10) || chr(9) || chr(13)) THEN 'substring' END,
      CASE WHEN (length(content) + 3) // 4 > 110 THEN 'tokens' END,
      CASE WHEN start_at > coalesce(reach, 0) AND regexp_replace(substr(text, (coalesce(reach, 0) + 1)::INT, (start_at - coalesce(reach, 0))::INT), '\\s', '', 'g') <> '' THEN 'uncovered' END]) AS rule FROM p)
    SELECT doc_id, rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY ALL""",
)
def chunk_validation(spark, sf_dir):
    """Violations of the chunk rules by chunks that have been damaged on purpose:
    emptied, lengthened, moved to the start, taken away, or long."""
    i = F.col("chunk_index")
    content = F.when(i % 7 == 3, "").when(i % 9 == 4, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    damaged = _chunks(spark, sf_dir).where(~((F.col("doc_id") % 3 == 0) & (i == 1))).withColumns(
        {"start_at": F.when(i % 13 == 6, 0).otherwise(F.col("start_at")), "content": content}
    )
    return chunking.violations(damaged, model.read(spark, sf_dir, "documents"), max_tokens=110)


SQL_FAMILIES = f"""{SQL_CHUNKS}, families AS (SELECT doc_id, (chunk_index // 4)::INT AS parent_index, min(start_at) AS p_start, max(end_at) AS p_end FROM c GROUP BY ALL)"""


def _families(spark, sf_dir):
    """Chunks in families of four under a parent that spans them, as rows of one table."""
    children = _chunks(spark, sf_dir).withColumn("parent_index", F.floor(F.col("chunk_index") / 4).cast("int"))
    parents = children.groupBy("doc_id", "parent_index").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"))
    columns = ["doc_id", "parent_index", "chunk_index", "start_at", "end_at"]
    return children.select(*columns).withColumn("chunk_type", F.lit("text")).unionByName(
        parents.withColumn("chunk_index", F.lit(None).cast("int")).select(*columns).withColumn("chunk_type", F.lit("parent_text"))
    )


@query(
    "hierarchy_validation",
    f"""WITH {SQL_FAMILIES}, d AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 8 = 7 THEN 999 ELSE chunk_index // 4 END AS parent_index, start_at,
      end_at + CASE WHEN chunk_index % 6 = 5 THEN 1000 ELSE 0 END AS end_at FROM c)
    SELECT d.doc_id, chunk_index FROM d LEFT JOIN families f ON f.doc_id = d.doc_id AND f.parent_index = d.parent_index
    WHERE p_start IS NULL OR start_at < p_start OR end_at > p_end""",
)
def hierarchy_validation(spark, sf_dir):
    """Children outside their parents, some having been lengthened or given to another parent on purpose."""
    i, child = F.col("chunk_index"), F.col("chunk_type") == "text"
    damaged = _families(spark, sf_dir).withColumns(
        {
            "end_at": F.col("end_at") + F.when(child & (i % 6 == 5), 1000).otherwise(0),
            "parent_index": F.when(child & (i % 8 == 7), 999).otherwise(F.col("parent_index")),
        }
    )
    return chunking.hierarchy_violations(damaged).select("doc_id", "chunk_index")


@query(
    "orphan_parents",
    f"""WITH {SQL_FAMILIES} SELECT doc_id, parent_index FROM families WHERE (doc_id, parent_index) NOT IN
    (SELECT (doc_id, (chunk_index // 4)::INT) FROM c WHERE (doc_id + chunk_index) % 5 = 0)""",
)
def orphan_parents(spark, sf_dir):
    """Parents of which no child is enabled."""
    both = _families(spark, sf_dir).withColumn("is_enabled", (F.col("doc_id") + F.col("chunk_index")) % 5 == 0)
    return sinks.orphan_parents(both).select("doc_id", "parent_index")


@query(
    "soft_deleted",
    """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN source = 'src2' THEN TIMESTAMP '2024-01-31 00:00:00' END AS deleted_at FROM documents""",
)
def soft_deleted(spark, sf_dir):
    """Documents with the time of their deletion; what was deleted before keeps its time."""
    d = model.documents(spark, sf_dir)
    at = F.when(F.col("deleted"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    gone = d.where("kb_id = 'src2'").select("doc_id")
    return sinks.soft_delete(d.select("doc_id", at.alias("deleted_at")), gone, ["doc_id"], model.NOW)


@query(
    "parent_overlays",
    f"""WITH {SQL_FAMILIES}, e AS (SELECT doc_id, (chunk_index // 4)::INT AS parent_index, start_at, end_at FROM c WHERE chunk_index % 4 = 1),
    p AS (SELECT f.doc_id, f.parent_index, p_start, substr(text, p_start + 1, p_end - p_start) AS content, e.start_at, e.end_at
      FROM families f JOIN documents USING (doc_id) LEFT JOIN e ON e.doc_id = f.doc_id AND e.parent_index = f.parent_index)
    SELECT doc_id, parent_index, md5(CASE WHEN start_at IS NULL THEN content
      ELSE substr(content, 1, start_at - p_start) || '<edit ' || start_at || '>' || substr(content, end_at - p_start + 1) END) AS text_md5 FROM p""",
)
def parent_overlays(spark, sf_dir):
    """Parents with the edited text of their second child written in."""
    rows = written(_families(spark, sf_dir), "families")
    key = F.concat_ws(":", "doc_id", "parent_index").alias("parent_id")
    docs = model.read(spark, sf_dir, "documents").select("doc_id", "text")
    content = F.expr("substring(text, start_at + 1, end_at - start_at)").alias("content")
    parents = rows.where("chunk_type = 'parent_text'").join(docs, "doc_id").select(key, F.col("start_at").alias("p_start"), content)
    edits = rows.where("chunk_index % 4 = 1").select(
        key, "start_at", "end_at", F.format_string("<edit %d>", "start_at").alias("content"), F.lit(1).alias("version")
    )
    out = retrieval_context.overlay(parents, edits)
    parts = F.split("parent_id", ":")
    return out.select(parts[0].cast("long").alias("doc_id"), parts[1].cast("int").alias("parent_index"), F.md5("text").alias("text_md5"))


@query(
    "live_hits",
    f"""WITH {SQL_CHUNKS} SELECT item_id AS query_id, c.doc_id, chunk_index FROM benchmark JOIN c ON c.doc_id % 40 = item_id % 40
    WHERE (c.doc_id + chunk_index) % 3 <> 0 AND c.doc_id % 17 <> 0""",
)
def live_hits(spark, sf_dir):
    """Hits of which the chunk is gone or its document deleted are dropped."""
    chunks = _chunks(spark, sf_dir).select("doc_id", "chunk_index", F.concat_ws(":", "doc_id", "chunk_index").alias("id"))
    items = model.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k"))
    hits = chunks.withColumn("k", F.col("doc_id") % 40).join(items, "k").drop("k")
    live = chunks.where("(doc_id + chunk_index) % 3 <> 0 and doc_id % 17 <> 0")
    return retrieval_context.live_only(hits, live).select("query_id", "doc_id", "chunk_index")


# semantic boundaries, citations, memory

SQL_BREAKS = """d AS (SELECT vec_id // 100 AS segment, vec_id % 100 AS pos, 1 - greatest(-1, least(1, list_cosine_similarity(
    lag(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id), embedding::DOUBLE[]))) AS distance FROM embeddings),
  l AS (SELECT segment, quantile_cont(distance, 0.8) AS lim FROM d GROUP BY 1),
  br AS (SELECT segment, pos, row_number() OVER (PARTITION BY segment ORDER BY pos) AS k FROM d JOIN l USING (segment) WHERE distance >= lim)"""


@query(
    "semantic_segments",
    f"""WITH RECURSIVE {SQL_BREAKS},
    g AS (SELECT DISTINCT segment, 0::BIGINT AS k, 0::BIGINT AS last, false AS kept FROM d
      UNION ALL SELECT g.segment, br.k, CASE WHEN br.pos - g.last >= 4 THEN br.pos ELSE g.last END, br.pos - g.last >= 4
      FROM g JOIN br ON br.segment = g.segment AND br.k = g.k + 1),
    s AS (SELECT segment, 0::BIGINT AS start_at FROM d GROUP BY 1 UNION ALL SELECT segment, last FROM g WHERE kept),
    n AS (SELECT segment, count(*) AS n FROM d GROUP BY 1)
    SELECT segment, start_at, coalesce(lead(start_at) OVER (PARTITION BY segment ORDER BY start_at), n) AS end_at FROM s JOIN n USING (segment)""",
)
def semantic_segments(spark, sf_dir):
    """Units cut where the distance to the one before is among the largest, pieces of four units or more."""
    vectors = model.read(spark, sf_dir, "embeddings")
    units = vectors.select(F.floor(F.col("vec_id") / 100).alias("segment"), (F.col("vec_id") % 100).alias("pos"), "embedding")
    return chunking.semantic_segments(units, 80.0, 4)


@query(
    "wiki_citations",
    f"""WITH {SQL_CHUNKS}, names AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {NAMES}, 1))) AS name FROM documents),
    j AS (SELECT n.doc_id, name, chunk_index, contains(content, name) AS held FROM names n JOIN c USING (doc_id)),
    a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name, held ORDER BY chunk_index) AS k, bool_or(held) OVER (PARTITION BY doc_id, name) AS any_held FROM j)
    SELECT doc_id, name, chunk_index FROM a WHERE (any_held AND held AND k <= 6) OR (NOT any_held AND k = 1)""",
)
def wiki_citations(spark, sf_dir):
    """The first six chunks of a document that hold a name, or its first chunk."""
    docs = model.read(spark, sf_dir, "documents")
    names = docs.select("doc_id", F.explode(T.candidate_names(F.col("text"))).alias("name"))
    return wiki.citations(names, _chunks(spark, sf_dir).select("doc_id", "chunk_index", "content"))


SQL_MENTIONS = f"""turns AS (SELECT conv_id, conv_id * 1000 + turn AS episode_id, list_distinct(regexp_extract_all(text, {NAMES}, 1)) AS names FROM conversations),
mentions AS (SELECT conv_id, episode_id, unnest(names) AS name FROM turns)"""


def _episodes(spark, sf_dir):
    c = model.read(spark, sf_dir, "conversations")
    return c.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("episode_id"), T.candidate_names(F.col("text")).alias("names"))


@query(
    "recent_episodes",
    f"""WITH {SQL_MENTIONS} SELECT DISTINCT episode_id FROM mentions WHERE name IN ('The', 'La', 'Le', 'And') ORDER BY episode_id DESC LIMIT 5""",
)
def recent_episodes(spark, sf_dir):
    """The five newest turns that mention one of the names: a limited list."""
    e = _episodes(spark, sf_dir)
    mentions = e.select("episode_id", F.explode("names").alias("name"))
    episodes = e.select("episode_id", F.col("episode_id").alias("created_at"))
    return graph.recent_episodes(mentions, episodes, F.col("name").isin("The", "La", "Le", "And")).select("episode_id")


@query(
    "forgotten_entities",
    f"WITH {SQL_MENTIONS} SELECT DISTINCT name FROM mentions WHERE name NOT IN (SELECT name FROM mentions WHERE conv_id % 3 <> 0)",
)
def forgotten_entities(spark, sf_dir):
    """Names that no turn mentions any more once every third conversation is gone."""
    mentions = _episodes(spark, sf_dir).select("conv_id", F.explode("names").alias("name"))
    return graph.forgotten_entities(mentions.select("name").distinct(), mentions.where("conv_id % 3 <> 0"))


# evaluation cases

SQL_CASES = """cases AS (SELECT item_id AS case_id, CASE WHEN item_id % 5 = 0 THEN ' ' ELSE b.text END AS query, CASE WHEN item_id % 7 = 1 THEN NULL ELSE d.doc_id END AS doc_id,
  CASE WHEN item_id % 3 = 0 THEN 'v1' ELSE sha256(d.text) END AS version, length(d.text) AS n_chars, CASE WHEN item_id % 4 = 2 THEN length(d.text) ELSE 0 END AS source_start,
  CASE WHEN item_id % 4 = 3 THEN length(d.text) + 1 ELSE length(d.text) END AS source_end, CASE WHEN item_id % 6 = 1 THEN '' ELSE 'e' END AS evidence
  FROM benchmark b JOIN documents d ON d.doc_id = item_id)"""


@query(
    "case_errors",
    f"""WITH {SQL_CASES}, e AS (SELECT case_id, unnest([CASE WHEN trim(query) = '' THEN 'empty query' END, CASE WHEN doc_id IS NULL THEN 'missing document' END,
      CASE WHEN NOT regexp_full_match(lower(version), '[0-9a-f]{{64}}') THEN 'version is not a sha256' END,
      CASE WHEN NOT (source_start >= 0 AND source_end > source_start AND source_end <= n_chars) THEN 'span out of bounds' END,
      CASE WHEN evidence = '' THEN 'empty evidence' END]) AS error FROM cases) SELECT * FROM e WHERE error IS NOT NULL""",
)
def case_errors(spark, sf_dir):
    """Rule violations of evidence cases, some made on purpose."""
    items = model.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"))
    docs = model.read(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_chars"))
    i, n = F.col("case_id"), F.col("n_chars")
    cases = items.join(docs, items["case_id"] == docs["doc_id"]).select(
        "case_id", F.when(i % 5 == 0, " ").otherwise(F.col("query")).alias("query"), F.when(i % 7 != 1, F.col("doc_id")).alias("doc_id"),
        F.when(i % 3 == 0, "v1").otherwise(F.sha2("text", 256)).alias("version"), "n_chars",
        F.when(i % 4 == 2, n).otherwise(0).alias("source_start"), F.when(i % 4 == 3, n + 1).otherwise(n).alias("source_end"),
        F.when(i % 6 == 1, "").otherwise("e").alias("answer_evidence"),
    )
    return evaluation.case_errors(cases)


@query(
    "template_cases",
    """SELECT item_id AS case_id, item_id % 3 = 0 OR item_id % 3 = 1 AS is_template FROM benchmark""",
)
def template_cases(spark, sf_dir):
    """Cases without labels, or with placeholders for labels, are templates."""
    i = F.col("item_id")
    ids = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 3 == 1, F.array(F.lit("<chunk id>"))).otherwise(F.array(F.sha2("text", 256)))
    return model.read(spark, sf_dir, "benchmark").select(i.alias("case_id"), ids.alias("ids")).select("case_id", evaluation.is_template(F.col("ids")).alias("is_template"))


# streams


@query(
    "stream_log",
    """WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'complete' ELSE role END AS kind, md5(text) AS payload FROM conversations),
    n AS (SELECT *, row_number() OVER w - 1 AS "offset", coalesce(sum(CASE WHEN kind = 'complete' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
      FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn, kind, payload))
    SELECT conv_id::VARCHAR AS message_id, "offset", kind, payload, kind = 'complete' AS terminal FROM n WHERE ended = 0""",
)
def stream_log(spark, sf_dir):
    """The log of every conversation's turns up to the event that ends it."""
    schema = model.read(spark, sf_dir, "conversations").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations.parquet*")
    kind = F.when(F.col("turn") % 5 == 4, "complete").otherwise(F.col("role"))
    events = raw.select(F.col("conv_id").cast("string").alias("message_id"), kind.alias("kind"), F.md5("text").alias("payload"), F.col("turn").alias("sent_at"))
    return jobs.run_to_memory(jobs.numbered_log(events), f"log_{uuid.uuid4().hex}", "append", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("stream_compaction", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_compaction(spark, sf_dir):
    """Last operation of each key of a batch, as the queue applies it."""
    key = F.concat_ws("|", "user_id", "event_type").alias("dedup_key")
    e = model.read(spark, sf_dir, "events").select(key, "user_id", "event_type", "event_id", F.col("ts").alias("created_at"), F.col("event_id").alias("op_id"))
    return jobs.compact(e).select("user_id", "event_type", "event_id")

