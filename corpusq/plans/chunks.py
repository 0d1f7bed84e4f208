"""Parsing and chunking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq import model
from corpusq.functions import text as T
from corpusq.operators import chunking, retrieval_context
from corpusq.registry import query
from corpusq.sources import parse
from corpusq.tables import shared_folder

#: The fixed-window chunker as a recursive query.
SQL_CHUNKS = """RECURSIVE cut AS (
  SELECT doc_id, text, length(text) AS n, 0 AS i, 0 AS s FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, n, i + 1, greatest(e - 80, s + 1) FROM (SELECT *,
    CASE WHEN e1 < n AND n - e1 < 128 THEN n ELSE e1 END AS e FROM (SELECT *,
      CASE WHEN m > s + 170 THEN m + 1 ELSE e0 END AS e1 FROM (SELECT *, greatest(
        CASE WHEN contains(seg, chr(10)) THEN s + length(seg) - strpos(reverse(seg), chr(10)) ELSE -1 END,
        CASE WHEN contains(seg, '。') THEN s + length(seg) - strpos(reverse(seg), '。') ELSE -1 END) AS m
        FROM (SELECT *, least(s + 512, n) AS e0, substr(text, s + 1, least(s + 512, n) - s) AS seg FROM cut)))) WHERE e < n),
chunks AS (SELECT doc_id, i AS chunk_index, s AS start_at, CASE WHEN e1 < n AND n - e1 < 128 THEN n ELSE e1 END AS end_at, text FROM (SELECT *,
      CASE WHEN m > s + 170 THEN m + 1 ELSE e0 END AS e1 FROM (SELECT *, greatest(
        CASE WHEN contains(seg, chr(10)) THEN s + length(seg) - strpos(reverse(seg), chr(10)) ELSE -1 END,
        CASE WHEN contains(seg, '。') THEN s + length(seg) - strpos(reverse(seg), '。') ELSE -1 END) AS m
        FROM (SELECT *, least(s + 512, n) AS e0, substr(text, s + 1, least(s + 512, n) - s) AS seg FROM cut)))),
c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_at) - 1)::INT AS chunk_index, start_at, end_at, content FROM (
  SELECT *, trim(substr(text, start_at + 1, end_at - start_at), ' ' || chr(10) || chr(9) || chr(13)) AS content FROM chunks) WHERE content <> '')"""


def _docs(spark, sf_dir):
    return model.read(spark, sf_dir, "documents").select("doc_id", "text")


def _fixed(spark, sf_dir):
    return chunking.fixed_chunks(_docs(spark, sf_dir))


@query("fixed_window_chunks", f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, start_at, end_at, md5(content) AS content_md5 FROM c")
def fixed_window_chunks(spark, sf_dir):
    return _fixed(spark, sf_dir).select("doc_id", "chunk_index", "start_at", "end_at", F.md5("content").alias("content_md5"))


@query(
    "chunk_size_stats",
    f"""WITH {SQL_CHUNKS}, v AS (SELECT length(content) AS n, (length(content) + 3) // 4 AS t FROM c)
    SELECT count(*) AS n_chunks, sum(n)::BIGINT AS chars_total, min(n) AS chars_min, max(n) AS chars_max, round(avg(n), 4) AS chars_mean,
      sum(t)::BIGINT AS tokens_total, min(t) AS tokens_min, max(t) AS tokens_max, round(avg(t), 4) AS tokens_mean FROM v""",
)
def chunk_size_stats(spark, sf_dir):
    return chunking.size_stats(_fixed(spark, sf_dir))


@query(
    "prev_next_links",
    f"""WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, lag(chunk_index) OVER w AS prev_index, lead(chunk_index) OVER w AS next_index
    FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
)
def prev_next_links(spark, sf_dir):
    return chunking.neighbour_links(_fixed(spark, sf_dir)).select("doc_id", "chunk_index", "prev_index", "next_index")


@query(
    "relink_neighbours",
    f"""WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, lag(chunk_index) OVER w AS prev_index, lead(chunk_index) OVER w AS next_index
    FROM c WHERE (doc_id + chunk_index) % 3 <> 0 WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
)
def relink_neighbours(spark, sf_dir):
    """Links after every third chunk has been disabled."""
    left = _fixed(spark, sf_dir).where("(doc_id + chunk_index) % 3 <> 0")
    return chunking.neighbour_links(left).select("doc_id", "chunk_index", "prev_index", "next_index")


@query("structural_chunks")
def structural_chunks(spark, sf_dir):
    return chunking.structural_chunks(_docs(spark, sf_dir)).drop("content")


@query("hierarchy_chunks")
def hierarchy_chunks(spark, sf_dir):
    return chunking.hierarchy(_docs(spark, sf_dir)).drop("content")


@query("neighbour_expansion")
def neighbour_expansion(spark, sf_dir):
    """Short chunks with their neighbours' text around them."""
    return retrieval_context.expand_short(_fixed(spark, sf_dir))


@query(
    "html_strip",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'gs')) AS text_md5,
    length(substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'gs'), '[ \t\n\r\f\v]+', ' ', 'g')), 1, 8000)) AS n_flat
    FROM pages""",
)
def html_strip(spark, sf_dir):
    pages = model.read(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        F.md5(T.strip_html(F.col("html"))).alias("text_md5"),
        F.length(T.strip_html_flat(F.col("html"))).alias("n_flat"),
    )


@query("html_links", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS word FROM pages""")
def html_links(spark, sf_dir):
    pages = model.read(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))
    return pages.select("page_id", F.explode(links).alias("word")).distinct()


@query(
    "semantic_distance",
    """SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, 1 - greatest(-1, least(1, list_cosine_similarity(
    lag(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id), embedding::DOUBLE[]))) AS d FROM embeddings) WHERE d IS NOT NULL""",
)
def semantic_distance(spark, sf_dir):
    return _distances(spark, sf_dir).where("distance is not null").select("vec_id", F.round("distance", 6).alias("distance"))


def _distances(spark, sf_dir):
    vectors = model.read(spark, sf_dir, "embeddings").withColumn("segment", F.floor(F.col("vec_id") / 100))
    return chunking.consecutive_distance(vectors, order="vec_id")


@query(
    "semantic_breakpoints",
    """WITH d AS (SELECT vec_id // 100 AS segment, vec_id, 1 - greatest(-1, least(1, list_cosine_similarity(
      lag(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id), embedding::DOUBLE[]))) AS distance FROM embeddings),
    l AS (SELECT segment, quantile_cont(distance, 0.9) AS lim FROM d GROUP BY 1)
    SELECT segment, vec_id, round(distance, 6) AS distance, round(lim, 6) AS lim FROM d JOIN l USING (segment) WHERE distance >= lim""",
)
def semantic_breakpoints(spark, sf_dir):
    found = chunking.breakpoints(_distances(spark, sf_dir), 90.0, order="vec_id")
    return found.select("segment", "vec_id", F.round("distance", 6).alias("distance"), F.round("limit", 6).alias("lim"))


@query(
    "sliding_windows",
    """SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS window_text
    FROM conversations""",
)
def sliding_windows(spark, sf_dir):
    turns = model.read(spark, sf_dir, "conversations")
    return chunking.sliding_text(turns, 3, "conv_id", "turn").select("conv_id", "turn", "window_text")


@query(
    "event_runs",
    """WITH r AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS change
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT user_id, event_type, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r)
    SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM g GROUP BY ALL""",
)
def event_runs(spark, sf_dir):
    """Runs of consecutive events of one type of a user."""
    found = chunking.runs(model.read(spark, sf_dir, "events"), "event_type", "user_id", "event_id")
    return found.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_functions",
    """SELECT doc_id, greatest(1, length(text) // 4) AS usage_tokens, (length(text) + 3) // 4 AS chunk_tokens,
    md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS signature,
    len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: length(t) > 1))) AS n_terms,
    len(list_distinct(regexp_extract_all(text, '(\\p{Lu}[\\p{L}\\p{N}]+(?: \\p{Lu}[\\p{L}\\p{N}]+){0,3})', 1))) AS n_names,
    ('0x' || substr(sha1(doc_id::VARCHAR), 1, 15))::BIGINT AS row_id,
    CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS history FROM documents""",
)
def text_functions(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id",
        T.tokens_for_usage(text).alias("usage_tokens"),
        T.tokens_for_chunks(text).alias("chunk_tokens"),
        T.signature(text).alias("signature"),
        F.size(T.token_set(text)).alias("n_terms"),
        F.size(T.candidate_names(text)).alias("n_names"),
        T.row_number_of_id(F.col("doc_id").cast("string")).alias("row_id"),
        T.truncate_history(text).alias("history"),
    )


@query(
    "csv_rows",
    """SELECT concat_ws(' | ', c_custkey::VARCHAR, c_name, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_nationkey::VARCHAR END, c_mktsegment) AS line FROM customer""",
)
def csv_rows(spark, sf_dir):
    """A table written as CSV files and read as lines; some cells are empty."""
    c = model.read(spark, sf_dir, "customer")
    nation = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey"))
    rows = c.select("c_custkey", "c_name", nation.alias("c_nationkey"), "c_mktsegment")
    path = f"{shared_folder(spark)}/tables/csv-{uuid.uuid4().hex}"
    rows.write.csv(path)
    return parse.read_csv_lines(spark, path, rows.schema)
