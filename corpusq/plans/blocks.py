"""Queries over documents as blocks: units, groups and the chunking plan."""

from __future__ import annotations

from zlib import crc32

import pandas as pd
from pyspark.sql import functions as F

from corpusq import model
from corpusq.operators import blocks as B
from corpusq.operators.chunking import Config
from corpusq.registry import query

#: The lines of a document as the blocks of a parsed file: every fifth document has
#: headings, records, pages, plain text or code; every ninth block is an image.
SQL_BLOCKS = """lines AS (SELECT doc_id, doc_id % 5 AS shape, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
blocks AS (SELECT doc_id, i AS block_index,
  CASE WHEN i % 9 = 8 THEN 'image' WHEN shape = 1 THEN 'record' WHEN shape IN (0, 2) THEN 'paragraph' WHEN shape = 4 AND i % 5 = 1 THEN 'code' ELSE 'text' END AS kind,
  CASE WHEN shape = 0 AND i % 4 = 0 THEN repeat('#', (1 + (i // 4) % 3)::INT) || ' ' || line
    WHEN shape = 0 AND i % 4 = 2 THEN line || chr(10) || '#### part ' || i || chr(10) || line ELSE line END AS text,
  CASE WHEN shape = 2 THEN i // 3 + 1 END AS page, CASE WHEN shape = 1 THEN 'S' || (i // 6) END AS sheet,
  CASE WHEN shape = 1 THEN (CASE WHEN i % 12 < 3 THEN 'name' ELSE 'name | value' END) END AS names FROM lines)"""


def document_blocks(spark, sf_dir):
    """The blocks that ``SQL_BLOCKS`` makes of documents."""
    docs = model.read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.pmod("doc_id", F.lit(5)).alias("shape"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    shape, i, line = F.col("shape"), F.col("i"), F.col("line")
    text = (
        F.when((shape == 0) & (i % 4 == 0), F.concat(F.expr("repeat('#', 1 + (i div 4) % 3)"), F.lit(" "), line))
        .when((shape == 0) & (i % 4 == 2), F.concat(line, F.lit("\n#### part "), i.cast("string"), F.lit("\n"), line))
        .otherwise(line)
    )
    kind = (
        F.when(i % 9 == 8, "image").when(shape == 1, "record").when(shape.isin(0, 2), "paragraph")
        .when((shape == 4) & (i % 5 == 1), "code").otherwise("text")
    )
    names = F.when(i % 12 < 3, F.array(F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("value")))
    return lines.select(
        "doc_id", i.alias("block_index"), kind.alias("kind"), text.alias("text"),
        F.when(shape == 2, F.expr("int(i div 3) + 1")).alias("page"),
        F.when(shape == 1, F.concat(F.lit("S"), F.expr("string(i div 6)"))).alias("sheet"), F.when(shape == 1, names).alias("headers"),
    )


@query(
    "block_units",
    f"""WITH {SQL_BLOCKS},
    kept AS (SELECT *, count(*) FILTER (kind = 'image') OVER (PARTITION BY doc_id ORDER BY block_index) AS media FROM blocks),
    b AS (SELECT *, row_number() OVER w - 1 AS nth, media > coalesce(lag(media) OVER w, 0) AS hard,
      coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sizes
      FROM kept WHERE kind <> 'image' AND text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)),
    l AS (SELECT doc_id, block_index, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM b),
    ls AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, block_index ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
    h AS (SELECT doc_id, block_index, s, s + length(line) AS e, line FROM ls WHERE regexp_matches(line, '^#{{1,6}}[ \\t]+.')),
    cuts AS (SELECT DISTINCT * FROM (SELECT doc_id, block_index, 0 AS pt FROM b UNION ALL SELECT doc_id, block_index, length(text) FROM b
      UNION ALL SELECT doc_id, block_index, s FROM h UNION ALL SELECT doc_id, block_index, e FROM h)),
    spans AS (SELECT *, lead(pt) OVER (PARTITION BY doc_id, block_index ORDER BY pt) AS upto FROM cuts),
    u AS (SELECT b.doc_id, b.block_index, pt AS block_start, sizes + 2 * nth + pt AS start_at, sizes + 2 * nth + upto AS end_at,
      substr(text, (pt + 1)::BIGINT, (upto - pt)::BIGINT) AS content, h.line IS NOT NULL AS is_h,
      CASE WHEN h.line IS NOT NULL THEN 'heading' WHEN EXISTS (SELECT 1 FROM h WHERE h.doc_id = b.doc_id AND h.block_index = b.block_index) THEN 'paragraph' ELSE kind END AS kind,
      hard AND pt = 0 AS hard, page, sheet, names FROM spans JOIN b USING (doc_id, block_index)
      LEFT JOIN h ON h.doc_id = spans.doc_id AND h.block_index = spans.block_index AND h.s = pt WHERE upto IS NOT NULL),
    v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_at) - 1 AS unit, CASE WHEN is_h THEN length(regexp_extract(content, '^#+')) END AS level,
      CASE WHEN is_h THEN trim(regexp_extract(content, '^#+[ \\t]+(.*)', 1), ' ' || chr(9)) END AS name FROM u),
    s AS (SELECT doc_id, CASE WHEN bool_or(is_h) THEN 'heading' WHEN bool_or(kind = 'record') THEN 'record' WHEN bool_or(kind = 'paragraph' OR page IS NOT NULL) THEN 'layout' ELSE 'recursive' END AS structural FROM v GROUP BY 1),
    k AS (SELECT v.*, structural, CASE structural WHEN 'layout' THEN coalesce('Page ' || page, '') WHEN 'record' THEN concat(coalesce(sheet, 'Records'), chr(10), coalesce(names, '')) ELSE '' END AS key,
      list([{{'l': level, 'n': name}}]) FILTER (is_h) OVER w AS open, count(*) FILTER (is_h) OVER w AS nth FROM v JOIN s USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
    r AS (SELECT *, CASE WHEN key IS NOT DISTINCT FROM lag(key) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS change FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY unit))
    SELECT doc_id, unit, start_at::BIGINT AS start_at, end_at::BIGINT AS end_at, block_index, block_start::BIGINT AS block_start, kind, level, hard, structural,
      CASE WHEN structural = 'heading' THEN nth ELSE sum(change) OVER (PARTITION BY doc_id ORDER BY unit) END AS section,
      CASE structural WHEN 'heading' THEN coalesce(array_to_string(list_transform(list_reduce(open, lambda a, x: list_concat(a[1:x[1].l - 1], x)), lambda x: x.n), ' > '), '')
        WHEN 'layout' THEN key WHEN 'record' THEN array_to_string(list_filter([coalesce(sheet, 'Records'), names], lambda x: x IS NOT NULL), ' > ') ELSE '' END AS context,
      md5(content) AS content_md5 FROM r""",
)
def block_units(spark, sf_dir):
    """Units of whole documents with their place in source and block, the document's
    strategy, and the group and header that it gives each unit."""
    grouped = B.grouped(B.with_strategy(B.atomic_units(document_blocks(spark, sf_dir))))
    return grouped.select(
        "doc_id", "unit", "start_at", "end_at", "block_index", "block_start", "kind", "level", "hard", "structural", "section", "context",
        F.md5("content").alias("content_md5"),
    )


def word_vectors(texts: pd.Series) -> pd.Series:
    """A plain stand-in for an embedding model: counts of hashed words; none for a
    text without words."""

    def vector(text: str) -> list[float] | None:
        counts = [0.0] * 16
        for word in text.split():
            counts[crc32(word.encode()) % 16] += 1.0
        return counts if any(counts) else None

    return texts.map(vector)


@query("chunk_plan")
def chunk_plan(spark, sf_dir):
    """Chunks of whole documents by the first of semantic, structural and recursive
    cuts that has no issues, with the reasons of those before; each chunk's blocks."""
    small = Config(size=400, overlap=40)
    plan = B.chunk_plan(document_blocks(spark, sf_dir), small, "semantic", embed=word_vectors, signature="words:16", content=False)
    return plan.drop("content")


@query("chunk_plan_nested")
def chunk_plan_nested(spark, sf_dir):
    """Parents by each document's structural strategy and children inside them."""
    return B.chunk_plan(document_blocks(spark, sf_dir), Config(), "auto", nested=True, content=False).drop("content")
