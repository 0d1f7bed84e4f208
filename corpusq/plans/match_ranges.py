"""Queries of match ranges and capped rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import model
from corpusq.operators import chunking
from corpusq.operators import match_ranges as M
from corpusq.plans.chunks import SQL_CHUNKS
from corpusq.registry import query

CAP, PARENT_CAP = 300, 700


def _sql_moved(a: str, b: str) -> str:
    inside = f"least({b}, t) > greatest({a}, f)"
    return (
        f"concat_ws(':', CASE WHEN {inside} THEN greatest({a}, f) - f END, CASE WHEN {inside} THEN least({b}, t) - f END, "
        f"({inside})::VARCHAR, (NOT ({inside}) OR f > {a} OR t < {b})::VARCHAR)"
    )


@query(
    "capped_hits",
    f"""WITH {SQL_CHUNKS}, h AS (SELECT *, length(content) AS n, (doc_id * 7 + chunk_index * 13) % length(content) AS a1, (doc_id * 11 + chunk_index * 29) % length(content) AS a2 FROM c),
    r AS (SELECT *, least(n, a1 + 90) AS b1, least(n, a2 + 40) AS b2, chunk_index % 3 = 2 AS bare, chunk_index % 2 = 0 AS framed FROM h),
    u AS (SELECT *, least(a1, a2) AS lo, greatest(b1, b2) AS hi FROM r),
    w AS (SELECT *, CASE WHEN n <= {CAP} THEN 0 ELSE greatest(0, least(n - {CAP}, CASE WHEN bare THEN 0 WHEN hi - lo <= {CAP} THEN lo - ({CAP} - (hi - lo)) // 2 ELSE a1 - ({CAP} - (b1 - a1)) // 2 END)) END AS f FROM u),
    x AS (SELECT *, CASE WHEN n <= {CAP} THEN n ELSE f + {CAP} END AS t FROM w),
    y AS (SELECT *, n > {CAP} AS cut, end_at - start_at = n AS same FROM x)
    SELECT doc_id, chunk_index, md5(substr(content, f + 1, t - f)) AS content_md5, t - f AS n_content,
      CASE WHEN NOT bare THEN {_sql_moved("a1", "b1")} || ',' || {_sql_moved("a2", "b2")} END AS ranges,
      CASE WHEN same THEN start_at + f ELSE start_at END AS source_start_at, CASE WHEN same THEN start_at + t ELSE end_at END AS source_end_at,
      CASE WHEN framed THEN 100 + f ELSE f END AS rendered_start_at, CASE WHEN framed THEN 100 + CASE WHEN cut THEN t ELSE end_at - start_at END ELSE t END AS rendered_end_at,
      CASE WHEN NOT framed THEN f END AS item_start_at, CASE WHEN NOT framed THEN t END AS item_end_at, cut AS clipped,
      CASE WHEN cut THEN 'max_context_chars' ELSE '' END AS clip_reason FROM (SELECT * REPLACE (CASE WHEN framed THEN cut ELSE same END AS same) FROM y)""",
)
def capped_hits(spark, sf_dir):
    """Every chunk as a standalone hit with two match ranges, or none, cut to a cap
    twice; every second one comes with a window of its parent."""
    chunks = chunking.fixed_chunks(model.read(spark, sf_dir, "documents"))
    i, n = F.col("chunk_index"), F.length("content")
    whole = chunks.withColumns({"a1": (F.col("doc_id") * 7 + i * 13) % n, "a2": (F.col("doc_id") * 11 + i * 29) % n, "n": n})
    zero, none = F.lit(0), F.lit(10**9)

    def found(k: int, size: int):
        a = F.col(f"a{k}")
        b = F.least("n", a + size)
        return M.match_range(F.lit(k), a, b, a, b, zero, none)

    ranges = F.when(i % 3 != 2, F.array(found(1, 90), found(2, 40)))
    length = F.col("end_at") - F.col("start_at")
    segment = F.struct(
        F.col("start_at").alias("source_start"), F.col("end_at").alias("source_end"), (zero + 100).alias("rendered_start"),
        (length + 100).alias("rendered_end"), F.lit(False).alias("edited"),
    )
    window = M.context_window(F.array(segment), F.col("start_at"), F.col("end_at"), zero + 100, length + 100, length + 100, CAP)
    window = window.withField("clipped", F.lit(False)).withField("clip_reason", F.lit(""))
    rows = whole.select("doc_id", "chunk_index", "start_at", "end_at", "content", ranges.alias("matched_ranges"), F.when(i % 2 == 0, window).alias("context_window"))
    out = M.capped(M.capped(rows, CAP), CAP)
    told = F.transform("matched_ranges", lambda r: F.concat_ws(":", r["context_start_at"], r["context_end_at"], r["visible"], r["clipped"]))
    w = F.col("context_window")
    fields = ("source_start_at", "source_end_at", "rendered_start_at", "rendered_end_at", "item_start_at", "item_end_at", "clipped", "clip_reason")
    return out.select(
        "doc_id", "chunk_index", F.md5("content").alias("content_md5"), F.length("content").alias("n_content"),
        F.when(F.col("matched_ranges").isNotNull(), F.array_join(told, ",")).alias("ranges"), *[w[f].alias(f) for f in fields],
    )


@query(
    "match_windows",
    f"""WITH d AS (SELECT doc_id, length(text) AS n, length(text) // 3 AS p, length(text) // 2 AS q FROM documents WHERE length(text) >= 12),
    e AS (SELECT *, n + 50 AS total, doc_id % 2 = 0 AS near, doc_id * 17 % p AS a1, q + 50 + doc_id * 5 % p AS a2 FROM d),
    r AS (SELECT *, least(a1 + 30, p) AS b1, least(a2 + 60, total) AS b2 FROM e),
    s AS (SELECT *, CASE WHEN near THEN a1 ELSE least(a1, a2) END AS lo, CASE WHEN near THEN b1 ELSE greatest(b1, b2) END AS hi FROM r),
    w AS (SELECT *, CASE WHEN total <= {PARENT_CAP} THEN 0 ELSE greatest(0, least(total - {PARENT_CAP}, CASE WHEN hi - lo <= {PARENT_CAP} THEN lo - ({PARENT_CAP} - (hi - lo)) // 2 ELSE a1 - ({PARENT_CAP} - (b1 - a1)) // 2 END)) END AS f FROM s),
    x AS (SELECT *, CASE WHEN total <= {PARENT_CAP} THEN total ELSE f + {PARENT_CAP} END AS t FROM w)
    SELECT doc_id, CASE WHEN f < p THEN f WHEN f < q + 50 THEN p ELSE f - 50 END AS source_start_at, CASE WHEN t > q + 50 THEN t - 50 WHEN t > p THEN q ELSE t END AS source_end_at,
      f AS rendered_start_at, t AS rendered_end_at, f > 0 OR t < total AS clipped,
      {_sql_moved("a1", "b1")} || CASE WHEN near THEN '' ELSE ',' || {_sql_moved("a2", "b2")} END AS ranges FROM x""",
)
def match_windows(spark, sf_dir):
    """Every document as a parent whose middle sixth was replaced by a text that is 50
    characters longer, with one or two hits and the window that shows them."""
    docs = model.read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")).where("n >= 12")
    e = docs.selectExpr("*", "n div 3 as p", "n div 2 as q", "n + 50 as total", "doc_id % 2 = 0 as near")
    e = e.selectExpr("*", "doc_id * 17 % p as a1", "q + 50 + doc_id * 5 % p as a2")
    e = e.selectExpr("*", "least(a1 + 30, p) as b1", "least(a2 + 60, total) as b2")
    pair = lambda k: F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"))
    evidence = F.when(F.col("near"), F.array(pair(1))).otherwise(F.array(pair(1), pair(2)))
    start, end = M.window_of(F.col("total"), PARENT_CAP, evidence)
    placed = e.withColumns({"f": start, "t": end})
    f, t = F.col("f"), F.col("t")
    piece = lambda a, b, c, d, edited: F.struct(
        *[F.expr(x).cast("long").alias(y) for x, y in ((a, "source_start"), (b, "source_end"), (c, "rendered_start"), (d, "rendered_end"))], F.lit(edited).alias("edited")
    )
    segments = F.array(piece("0", "p", "0", "p", False), piece("p", "q", "p", "q + 50", True), piece("q", "n", "q + 50", "total", False))
    window = M.context_window(segments, F.lit(0), F.col("n"), f, t, F.col("total"), PARENT_CAP)
    hit = lambda k: M.match_range(F.lit(k), F.col(f"a{k}"), F.col(f"b{k}"), F.col(f"a{k}"), F.col(f"b{k}"), f, t)
    ranges = F.when(F.col("near"), F.array(hit(1))).otherwise(F.array(hit(1), hit(2)))
    out = placed.select("doc_id", window.alias("w"), ranges.alias("r"))
    told = F.transform("r", lambda x: F.concat_ws(":", x["context_start_at"], x["context_end_at"], x["visible"], x["clipped"]))
    fields = ("source_start_at", "source_end_at", "rendered_start_at", "rendered_end_at", "clipped")
    return out.select("doc_id", *[F.col(f"w.{x}").alias(x) for x in fields], F.array_join(told, ",").alias("ranges"))
