"""Pages kept up to date by deltas of what documents contribute."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import model
from corpusq.operators import contributions as C
from corpusq.operators import wiki
from corpusq.plans.graphs import SQL_WIKI
from corpusq.registry import query

#: Two batches: most documents first; then the others, some again with their longer
#: names only, and some taken away.
SQL_STATE = f"""{SQL_WIKI},
base AS (SELECT slug, doc_id, min(name) AS title, list(DISTINCT name) AS names FROM contrib GROUP BY ALL),
longer AS (SELECT slug, doc_id, min(name) AS title, list(DISTINCT name) AS names FROM contrib WHERE length(name) >= 8 GROUP BY ALL),
b1 AS (SELECT * FROM base WHERE doc_id % 3 <> 0),
again AS (SELECT * FROM longer WHERE doc_id % 3 <> 0 AND doc_id % 7 = 1 AND doc_id % 11 <> 2),
b2 AS (SELECT *, 'v1' AS details FROM base WHERE doc_id % 3 = 0 AND doc_id % 11 <> 2 UNION ALL SELECT *, 'v2' FROM again),
gone AS (SELECT slug, doc_id FROM b1 WHERE doc_id % 11 = 2 OR (doc_id % 7 = 1 AND (slug, doc_id) NOT IN (SELECT slug, doc_id FROM again))),
final AS (SELECT slug, doc_id, details FROM b2 UNION ALL SELECT slug, doc_id, 'v1' FROM b1 WHERE (slug, doc_id) NOT IN (SELECT slug, doc_id FROM gone) AND (slug, doc_id) NOT IN (SELECT slug, doc_id FROM b2)),
touched AS (SELECT slug FROM b2 UNION SELECT slug FROM gone),
titles AS (SELECT slug, arg_min(title, (k, doc_id)) AS title, list_sort(list_distinct(flatten(list(names)))) AS aliases FROM
  (SELECT slug, doc_id, title, names, 1 AS k FROM b1 UNION ALL SELECT slug, doc_id, title, names, 0 FROM b2) GROUP BY 1)"""


def _deltas(spark, sf_dir):
    """The two batches of ``SQL_STATE``."""
    parts = wiki.contributions(model.read(spark, sf_dir, "documents").select("doc_id", "text"))
    group = lambda p: p.groupBy("slug", "doc_id").agg(F.min("name").alias("title"), F.collect_set("name").alias("aliases"))

    def delta(rows, action: str, details: str):
        d = F.col("doc_id")
        return rows.select(
            "slug", "doc_id", d.alias("seq"), F.lit(action).alias("action"), "title", F.lit("entity").alias("page_type"), F.lit("").alias("summary"), "aliases",
            F.concat(F.lit("d"), d.cast("string")).alias("doc_title"), F.col("title").alias("description"), F.lit(details).alias("details"),
            F.array(d * 10, d * 10 + 1).alias("chunks"),
        )

    base, longer = group(parts), group(parts.where("length(name) >= 8"))
    first = base.where("doc_id % 3 <> 0")
    again = longer.where("doc_id % 3 <> 0 and doc_id % 7 = 1 and doc_id % 11 <> 2")
    lost = first.where("doc_id % 7 = 1").join(again.select("slug", "doc_id"), ["slug", "doc_id"], "left_anti")
    gone = first.where("doc_id % 11 = 2").unionByName(lost)
    second = delta(base.where("doc_id % 3 = 0 and doc_id % 11 <> 2"), "upsert", "v1").unionByName(delta(again, "upsert", "v2"))
    return delta(first, "upsert", "v1"), second.unionByName(delta(gone, "retract", ""))


def _state(spark, sf_dir):
    first, second = _deltas(spark, sf_dir)
    return C.apply(C.apply(C.empty(first), first, 1), second, 2)


@query(
    "slug_state",
    f"""WITH {SQL_STATE} SELECT slug, title, array_to_string(aliases, '|') AS aliases, count(*) AS n_docs, 2 * count(*) AS n_chunks,
      1 + (slug IN (SELECT slug FROM b1) AND slug IN (SELECT slug FROM touched))::BIGINT AS version FROM final JOIN titles USING (slug) GROUP BY ALL""",
)
def slug_state(spark, sf_dir):
    """Pages after two batches of deltas over all documents."""
    pages = C.figures(_state(spark, sf_dir))
    return pages.select("slug", "title", F.array_join("aliases", "|").alias("aliases"), "n_docs", "n_chunks", "version")


@query(
    "slug_source_refs",
    f"""WITH {SQL_STATE} SELECT slug, doc_id, 'd' || doc_id AS doc_title,
      row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN (slug, doc_id) IN (SELECT slug, doc_id FROM b1) THEN 1 ELSE 2 END, doc_id) AS position FROM final""",
)
def slug_source_refs(spark, sf_dir):
    """The documents of every page in the order in which they joined it."""
    return C.source_refs(_state(spark, sf_dir))
