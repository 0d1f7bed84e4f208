"""Entity graph, page-link and wiki queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import model
from corpusq.functions.text import candidate_names
from corpusq.operators import chunking, graph, lexical, wiki
from corpusq.plans.chunks import SQL_CHUNKS
from corpusq.plans.retrieval import SQL_BM25
from corpusq.registry import query
from corpusq.tables import planned, written

#: A name that stands in a document is an entity of it; neighbours in the order of its names are related.
NAMES = "'(\\p{Lu}[\\p{L}\\p{N}]+(?: \\p{Lu}[\\p{L}\\p{N}]+){0,3})'"
SQL_ENTITIES = f"""names AS (SELECT doc_id AS chunk_id, list_distinct(regexp_extract_all(text, {NAMES}, 1)) AS l FROM documents),
mentions AS (SELECT chunk_id, unnest(l) AS name FROM names),
ents AS (SELECT name, count(*) AS frequency, min(chunk_id) AS first_chunk FROM mentions GROUP BY 1)"""
# list_distinct keeps no order in DuckDB, so pairs are made from the names in order of their text
SQL_RELATIONS = f"""{SQL_ENTITIES},
ordered AS (SELECT chunk_id, list_sort(l) AS l FROM names WHERE len(l) > 1),
pairs AS (SELECT chunk_id, l[i] AS source, l[i + 1] AS target FROM (SELECT *, unnest(range(1, len(l))) AS i FROM ordered)),
rels AS (SELECT source, target, count(DISTINCT chunk_id) AS n, max(1 + (chunk_id % 10)) AS strength FROM pairs GROUP BY ALL),
sums AS (SELECT (SELECT sum(frequency) FROM ents) AS t, (SELECT sum(n) FROM rels) AS p, (SELECT max(strength) FROM rels) AS ms),
pm AS (SELECT r.*, greatest(log2((n::DOUBLE / p) / ((a.frequency::DOUBLE / t) * (b.frequency::DOUBLE / t))), 0) AS pmi, ms
  FROM rels r JOIN ents a ON a.name = source JOIN ents b ON b.name = target, sums),
weighted AS (SELECT *, 1 + 9 * (0.6 * (CASE WHEN (SELECT max(pmi) FROM pm) > 0 THEN pmi / (SELECT max(pmi) FROM pm) ELSE 0 END) + 0.4 * strength / ms) AS weight FROM pm)"""
#: The graph of each document's own chunks.
SQL_CHUNK_EDGES = f"""{SQL_CHUNKS},
names AS (SELECT doc_id, chunk_index AS chunk_id, list_distinct(regexp_extract_all(content, {NAMES}, 1)) AS l FROM c),
mentions AS (SELECT doc_id, chunk_id, unnest(l) AS name FROM names),
ents AS (SELECT doc_id, name, count(*) AS frequency FROM mentions GROUP BY ALL),
ordered AS (SELECT doc_id, chunk_id, list_sort(l) AS l FROM names WHERE len(l) > 1),
pairs AS (SELECT doc_id, chunk_id, l[i] AS source, l[i + 1] AS target FROM (SELECT *, unnest(range(1, len(l))) AS i FROM ordered)),
rels AS (SELECT doc_id, source, target, count(DISTINCT chunk_id) AS n, max(1 + (chunk_id % 10)) AS strength FROM pairs GROUP BY ALL),
te AS (SELECT doc_id, sum(frequency) AS t FROM ents GROUP BY 1), tr AS (SELECT doc_id, sum(n) AS p, max(strength) AS ms FROM rels GROUP BY 1),
pm AS (SELECT r.*, ms, greatest(log2((n::DOUBLE / p) / ((a.frequency::DOUBLE / t) * (b.frequency::DOUBLE / t))), 0) AS pmi FROM rels r
  JOIN ents a ON a.doc_id = r.doc_id AND a.name = source JOIN ents b ON b.doc_id = r.doc_id AND b.name = target JOIN te ON te.doc_id = r.doc_id JOIN tr ON tr.doc_id = r.doc_id),
deg AS (SELECT doc_id, name, count(*) AS degree FROM (SELECT doc_id, source AS name FROM rels UNION ALL SELECT doc_id, target FROM rels) GROUP BY ALL),
weighted AS (SELECT p.doc_id, source, target, x.degree + y.degree AS degree,
  1 + 9 * (0.6 * (CASE WHEN max(pmi) OVER (PARTITION BY p.doc_id) > 0 THEN pmi / max(pmi) OVER (PARTITION BY p.doc_id) ELSE 0 END) + 0.4 * strength / ms) AS weight
  FROM pm p JOIN deg x ON x.doc_id = p.doc_id AND x.name = source JOIN deg y ON y.doc_id = p.doc_id AND y.name = target),
ce AS (SELECT w.doc_id, a.chunk_id AS a, b.chunk_id AS b, round(weight, 9) AS weight, degree FROM weighted w JOIN mentions a ON a.doc_id = w.doc_id AND a.name = source
  JOIN mentions b ON b.doc_id = w.doc_id AND b.name = target WHERE a.chunk_id <> b.chunk_id),
edges AS (SELECT doc_id, a, b, max({{'w': weight, 'd': degree}}) AS best FROM (SELECT * FROM ce UNION ALL SELECT doc_id, b, a, weight, degree FROM ce) GROUP BY ALL)"""
#: The best eight of a chunk.
SQL_TOP = "row_number() OVER (PARTITION BY doc_id, a ORDER BY best.w DESC, best.d DESC, b)"


def _neighbours(names):
    """Names next to each other in the order of their text, strength by chunk."""
    l = names.withColumn("l", F.array_sort("names")).where("size(l) > 1")
    pairs = l.withColumn("p", F.explode(F.expr("transform(sequence(1, size(l) - 1), i -> struct(l[i - 1] as source, l[i] as target))")))
    return graph.clean_relations(pairs.withColumns({"source": F.col("p.source"), "target": F.col("p.target"), "strength": 1 + F.col("chunk_id") % 10}))


def _names(spark, sf_dir):
    docs = model.read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), candidate_names(F.col("text")).alias("names"))


def _entities(spark, sf_dir):
    return graph.merge_entities(_names(spark, sf_dir).select("chunk_id", F.explode("names").alias("name")))


def _relations(spark, sf_dir):
    return graph.merge_relations(_neighbours(_names(spark, sf_dir)))


@query("entity_merge", f"WITH {SQL_ENTITIES} SELECT name, frequency, first_chunk FROM ents")
def entity_merge(spark, sf_dir):
    return _entities(spark, sf_dir)


@query(
    "relation_pmi_weight",
    f"WITH {SQL_RELATIONS} SELECT source, target, n, strength, round(pmi, 6) AS pmi, round(weight, 6) AS weight FROM weighted",
)
def relation_pmi_weight(spark, sf_dir):
    names = written(_names(spark, sf_dir), "names")
    entities = graph.merge_entities(names.select("chunk_id", F.explode("names").alias("name")))
    w = graph.relation_weights(written(entities, "entities"), written(graph.merge_relations(_neighbours(names)), "relations"))
    return w.select("source", "target", "n", "strength", F.round("pmi", 6).alias("pmi"), F.round("weight", 6).alias("weight"))


@query("entity_degree", f"WITH {SQL_RELATIONS} SELECT name, count(*) AS degree FROM (SELECT source AS name FROM rels UNION ALL SELECT target FROM rels) GROUP BY 1")
def entity_degree(spark, sf_dir):
    return graph.degrees(_relations(spark, sf_dir))


def chunk_graph(spark, sf_dir, most=None, own=None):
    """Edges between the chunks of each document, or of those in ``own`` (doc_id), written;
    with ``most`` the best so many of each chunk.  Names are dealt by document once, and
    all joins and groups of a document stay where it is."""
    docs = model.read(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunking.fixed_chunks(docs if own is None else docs.join(own, "doc_id", "left_semi"))
    names = chunks.select("doc_id", F.col("chunk_index").alias("chunk_id"), candidate_names(F.col("content")).alias("names"))
    return document_graphs(names, most)


def document_graphs(names, most=None):
    """The chunk graph of each document from the names of its chunks (doc_id, chunk_id, names), written."""
    spark, scope = names.sparkSession, ("doc_id",)
    names = written(names, "chunk-names").repartition("doc_id")
    mentions = names.select("doc_id", "chunk_id", F.explode("names").alias("name"))
    relations = graph.merge_relations(_neighbours(names), scope)
    weighted = graph.relation_weights(graph.merge_entities(mentions, scope), relations, scope)
    with planned(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
        return written(graph.chunk_edges(weighted, mentions, scope, most), "chunk-edges")


@query("chunk_graph_direct", f"WITH {SQL_CHUNK_EDGES} SELECT doc_id, a, b, round(best.w, 6) AS weight, best.d AS degree, {SQL_TOP} AS rank FROM edges QUALIFY rank <= 8")
def chunk_graph_direct(spark, sf_dir):
    found = graph.top_neighbours(chunk_graph(spark, sf_dir, 8), scope=("doc_id",))
    return found.select("doc_id", "a", "b", F.round("weight", 6).alias("weight"), "degree", "rank")


@query(
    "chunk_graph_two_hop",
    f"""WITH {SQL_CHUNK_EDGES}, two AS (SELECT x.doc_id, x.a, y.b, max({{'w': round(x.best.w * y.best.w * 0.5, 9), 'd': greatest(x.best.d, y.best.d)}}) AS best
      FROM edges x JOIN edges y ON x.doc_id = y.doc_id AND x.b = y.a WHERE x.a <> y.b GROUP BY ALL)
    SELECT doc_id, a, b, round(best.w, 6) AS weight, best.d AS degree, {SQL_TOP} AS rank FROM two
    WHERE NOT EXISTS (SELECT 1 FROM edges d WHERE d.doc_id = two.doc_id AND d.a = two.a AND d.b = two.b) QUALIFY rank <= 8""",
)
def chunk_graph_two_hop(spark, sf_dir):
    scope = ("doc_id",)
    found = graph.top_neighbours(graph.two_hop(chunk_graph(spark, sf_dir), scope=scope, most=8), scope=scope)
    return found.select("doc_id", "a", "b", F.round("weight", 6).alias("weight"), "degree", "rank")


@query(
    "graph_name_match",
    f"""WITH {SQL_ENTITIES}, terms AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(text, {NAMES}, 1))) AS term FROM benchmark),
    hit AS (SELECT DISTINCT query_id, name, frequency FROM ents JOIN terms ON contains(lower(name), lower(term)))
    SELECT query_id, name, frequency FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY frequency DESC, name) <= 200""",
)
def graph_name_match(spark, sf_dir):
    """Entities whose names hold a name of the query."""
    items = model.read(spark, sf_dir, "benchmark")
    terms = items.select(F.col("item_id").alias("query_id"), F.explode(candidate_names(F.col("text"))).alias("term"))
    entities = written(_entities(spark, sf_dir), "entities")
    return graph.name_matches(entities, terms).select("query_id", "name", "frequency")


#: What the graphs of the knowledge bases add to the keyword hits of a query.
GRAPH_HITS = 10


@query(
    "graph_search",
    f"""WITH {SQL_BM25}, gn AS (SELECT doc_id AS id, kb_id, list_sort(list_distinct(regexp_extract_all(text, {NAMES}, 1))) AS l FROM docs WHERE enabled AND NOT deleted),
    gm AS (SELECT id, kb_id, unnest(l) AS name FROM gn), ge AS (SELECT kb_id, name, count(*) AS frequency FROM gm GROUP BY ALL),
    gr AS (SELECT DISTINCT kb_id, l[i] AS source, l[i + 1] AS target FROM (SELECT *, unnest(range(1, len(l))) AS i FROM gn WHERE len(l) > 1)),
    ways AS (SELECT kb_id, source AS name, target AS other FROM gr UNION SELECT kb_id, target, source FROM gr),
    terms AS (SELECT DISTINCT item_id AS query_id, lower(unnest(list_distinct(regexp_extract_all(text, {NAMES}, 1)))) AS term FROM benchmark),
    hit AS (SELECT DISTINCT query_id, kb_id, name, frequency FROM ge JOIN terms ON contains(lower(name), term)),
    hops AS (SELECT query_id, kb_id, name, other, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY frequency DESC, name, other) AS pos FROM hit JOIN ways USING (kb_id, name) QUALIFY pos <= 200),
    visited AS (SELECT query_id, kb_id, name, min(step) AS step FROM (SELECT query_id, kb_id, name, 2 * pos AS step FROM hops UNION ALL SELECT query_id, kb_id, other, 2 * pos + 1 FROM hops) GROUP BY ALL),
    found AS (SELECT query_id, id, min({{'kb': kb_id, 'step': step}}) AS first FROM visited JOIN gm USING (kb_id, name)
      WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.query_id = visited.query_id AND kw.doc_id = gm.id) GROUP BY ALL)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY first, id) AS position FROM found QUALIFY position <= {GRAPH_HITS}""",
)
def graph_search(spark, sf_dir):
    """Documents that stand one relation from a name of the query, and were not found by its words."""
    docs = model.enabled_documents(spark, sf_dir).where(model.searchable())
    seen = lexical.bm25_top_k(model.documents(spark, sf_dir), model.queries(spark, sf_dir), 20)
    names = written(docs.select("kb_id", F.col("doc_id").alias("id"), F.array_sort(candidate_names(F.col("text"))).alias("names")), "names")
    terms = model.queries(spark, sf_dir).select("query_id", F.explode(candidate_names(F.col("query"))).alias("term"))
    return graph.search(terms, *entity_graph(names, "kb_id"), seen.withColumnRenamed("doc_id", "id"), GRAPH_HITS)


def entity_graph(names, scope):
    """(entities, relations, mentions) of each scope from the sorted names of chunks (scope, id, names)."""
    mentions = names.select(scope, "id", F.explode("names").alias("name"))
    entities = mentions.groupBy(scope, "name").agg(F.count(F.lit(1)).alias("frequency"))
    step = "transform(sequence(1, size(names) - 1), i -> struct(names[i - 1] as source, names[i] as target))"
    pairs = names.where("size(names) > 1").select(scope, F.explode(F.expr(step)).alias("p"))
    return entities, pairs.select(scope, "p.source", "p.target").distinct(), mentions


SQL_LINKS = """words AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS word FROM pages),
concepts AS (SELECT word FROM words GROUP BY 1 HAVING count(*) > 1),
slugs AS (SELECT 'page/' || page_id AS slug, 'page' AS kind FROM pages UNION ALL SELECT 'concept/' || word, 'concept' FROM concepts),
links AS (SELECT 'page/' || page_id AS src, 'concept/' || word AS dst FROM words JOIN concepts USING (word))"""


#: Links of which only words that four pages link are known.
SQL_KNOWN = SQL_LINKS.replace("count(*) > 1", "count(*) >= 4")


def _links(spark, sf_dir, least=2):
    return graph.page_links(model.read(spark, sf_dir, "pages"), least)


@query("page_links", f"WITH {SQL_LINKS} SELECT src, dst FROM links")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir)[1]


@query(
    "dead_links",
    f"WITH {SQL_KNOWN} SELECT 'page/' || page_id AS src, 'concept/' || word AS dst FROM words WHERE word NOT IN (SELECT word FROM concepts)",
)
def dead_links(spark, sf_dir):
    pages = model.read(spark, sf_dir, "pages")
    slugs, _ = _links(spark, sf_dir, 4)
    words = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("word")).distinct()
    every = words.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("src"), F.concat(F.lit("concept/"), "word").alias("dst"))
    return graph.dead_links(every, slugs).select("src", "dst")


@query(
    "link_degree_rank",
    f"""WITH {SQL_LINKS}, ends AS (SELECT src AS slug, dst AS other, 'out' AS way FROM links UNION ALL SELECT dst, src, 'in' FROM links)
    SELECT slug, count(*) FILTER (way = 'in') AS in_degree, count(*) FILTER (way = 'out') AS out_degree, count(DISTINCT other) AS degree
    FROM ends GROUP BY 1 ORDER BY degree DESC, slug LIMIT 500""",
)
def link_degree_rank(spark, sf_dir):
    """Pages with the most neighbours: a top-500 report."""
    return graph.neighbour_counts(_links(spark, sf_dir)[1]).orderBy(F.desc("degree"), "slug").limit(500)


@query(
    "ego_bfs",
    f"""WITH {SQL_LINKS}, both_ways AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
    s AS (SELECT 'page/' || page_id AS start FROM pages WHERE page_id % 100 = 0),
    h1 AS (SELECT DISTINCT start, b AS slug FROM s JOIN both_ways ON a = start),
    h2 AS (SELECT DISTINCT start, b AS slug FROM h1 JOIN both_ways ON a = slug)
    SELECT start, slug, min(hops) AS hops FROM (SELECT start, start AS slug, 0 AS hops FROM s UNION ALL SELECT start, slug, 1 FROM h1 UNION ALL SELECT start, slug, 2 FROM h2) GROUP BY ALL""",
)
def ego_bfs(spark, sf_dir):
    """Neighbourhoods of every hundredth page, the stated query set of a search."""
    slugs, links = _links(spark, sf_dir)
    pages = model.read(spark, sf_dir, "pages").where("page_id % 100 = 0")
    starts = pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("slug"))
    return graph.ego(links, starts, 2)


@query(
    "orphan_pages",
    f"WITH {SQL_KNOWN} SELECT slug, kind FROM slugs WHERE slug NOT IN (SELECT src FROM links UNION SELECT dst FROM links)",
)
def orphan_pages(spark, sf_dir):
    return graph.orphans(*_links(spark, sf_dir, 4))


@query("pages_by_kind", f"WITH {SQL_LINKS} SELECT kind, slug, row_number() OVER (PARTITION BY kind ORDER BY slug) AS position, '- [[' || slug || ']]' AS line FROM slugs")
def pages_by_kind(spark, sf_dir):
    slugs, _ = _links(spark, sf_dir)
    return wiki.grouped_index(slugs)


@query(
    "induced_links",
    f"""WITH {SQL_LINKS}, n AS (SELECT slug FROM (SELECT src AS slug, dst AS other FROM links UNION SELECT dst, src FROM links) GROUP BY 1 HAVING count(DISTINCT other) >= 5)
    SELECT src, dst FROM links WHERE src IN (SELECT slug FROM n) AND dst IN (SELECT slug FROM n)""",
)
def induced_links(spark, sf_dir):
    _, links = _links(spark, sf_dir)
    busy = graph.neighbour_counts(links).where("degree >= 5")
    return graph.induced(links, busy).select("src", "dst")


SQL_WIKI = f"""raw AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, {NAMES}, 1))) AS name FROM documents),
contrib AS (SELECT 'entity/' || regexp_replace(regexp_replace(lower(trim(name)), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, name, doc_id FROM raw WHERE length(name) >= 4)"""


def _contributions(spark, sf_dir):
    return wiki.contributions(model.read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("slug_contributions", f"WITH {SQL_WIKI} SELECT slug, min(name) AS title, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM contrib GROUP BY 1")
def slug_contributions(spark, sf_dir):
    merged = wiki.reduce_by_slug(_contributions(spark, sf_dir))
    return merged.select("slug", "title", "n_docs", "first_doc")


@query(
    "slug_retractions",
    f"""WITH {SQL_WIKI}, new AS (SELECT * FROM contrib WHERE length(name) >= 8)
    SELECT DISTINCT doc_id, slug FROM contrib WHERE (doc_id, slug) NOT IN (SELECT doc_id, slug FROM new)""",
)
def slug_retractions(spark, sf_dir):
    """What documents no longer contribute to once names need eight characters."""
    old = _contributions(spark, sf_dir)
    return wiki.retractions(old, old.where(F.length("name") >= 8))


@query(
    "link_changes",
    f"""WITH {SQL_LINKS}, new AS (SELECT src, dst FROM links WHERE length(dst) % 3 <> 0 UNION SELECT dst, src FROM links WHERE length(dst) % 3 = 1)
    SELECT src, dst, 'added' AS change FROM new WHERE (src, dst) NOT IN (SELECT src, dst FROM links)
    UNION ALL SELECT src, dst, 'removed' FROM links WHERE (src, dst) NOT IN (SELECT src, dst FROM new)""",
)
def link_changes(spark, sf_dir):
    _, links = _links(spark, sf_dir)
    kept = links.where(F.length("dst") % 3 != 0)
    back = links.where(F.length("dst") % 3 == 1).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.link_changes(links, kept.union(back).distinct())


@query("cross_linked_pages")
def cross_linked_pages(spark, sf_dir):
    """Documents with links to the entities that they name."""
    docs = model.read(spark, sf_dir, "documents").select("doc_id", "text")
    parts = _contributions(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("name", "slug"))).alias("names"))
    linked = wiki.cross_link(docs.join(parts, "doc_id"))
    return linked.select("doc_id", F.regexp_count("text", F.lit(r"\[\[")).alias("n_links"), F.md5("text").alias("text_md5"))
