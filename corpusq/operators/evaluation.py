"""Retrieval and chunking evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 1e-12


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, mrr_k: int = 10, recall_k: int = 20) -> DataFrame:
    """(query_id, mrr, recall) for every query; 0 where nothing is relevant.

    ``ranked``: query_id, id, rank.  ``relevant``: query_id, id.
    """
    total = relevant.groupBy("query_id").agg(F.count_distinct("id").alias("n"))
    hits = ranked.join(relevant.distinct(), ["query_id", "id"])
    found = hits.groupBy("query_id").agg(
        F.min(F.when(F.col("rank") <= mrr_k, F.col("rank"))).alias("first"),
        F.count_distinct(F.when(F.col("rank") <= recall_k, F.col("id"))).alias("found"),
    )
    joined = queries.select("query_id").join(total, "query_id", "left").join(found, "query_id", "left")
    return joined.select(
        "query_id",
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("recall"),
    )


def means(metrics: DataFrame) -> DataFrame:
    """Mean of each metric over the queries, 0 without queries."""
    return metrics.agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("mrr", "recall")], F.count(F.lit(1)).alias("n_queries")
    )


def gate(base: DataFrame, new: DataFrame, gain: float = 0.05) -> DataFrame:
    """One row: both means, relative gain, and whether MRR gains enough and recall does not fall."""
    none = F.lit(None).cast("double")
    names = [(side, c) for side in ("base", "new") for c in ("mrr", "recall")]

    def row(metrics: DataFrame, own: str) -> DataFrame:
        return means(metrics).select(*[(F.col(c) if side == own else none).alias(f"{side}_{c}") for side, c in names])

    # two rows of which each has two of the figures
    both = row(base, "base").unionAll(row(new, "new")).agg(*[F.max(f"{side}_{c}").alias(f"{side}_{c}") for side, c in names])
    delta = (F.col("new_mrr") - F.col("base_mrr")) / F.greatest(F.col("base_mrr"), F.lit(1e-9))
    return both.withColumn("gain", delta).withColumn(
        "passed", (F.col("base_mrr") > 0) & (delta >= gain - EPSILON) & (F.col("new_recall") >= F.col("base_recall") - EPSILON)
    )


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open spans share a position."""
    return (start_a < end_b) & (end_a > start_b)


def evidence_hits(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates (query_id, id, doc_id, start_at, end_at, rank) that overlap a
    piece of evidence (query_id, evidence_id, doc_id, e_start, e_end): an
    equi-join on query and document with the overlap as a further condition."""
    same = candidates.join(evidence, ["query_id", "doc_id"])
    return same.where(overlaps(F.col("start_at"), F.col("end_at"), F.col("e_start"), F.col("e_end")))


def span_metrics(candidates: DataFrame, evidence: DataFrame, queries: DataFrame, mrr_k: int = 10, top: int = 20) -> DataFrame:
    """(query_id, mrr, recall, precision, chars) of ranked spans against evidence."""
    used = candidates.where(F.col("rank") <= top)
    hits = evidence_hits(used, evidence)
    per_query = used.groupBy("query_id").agg(
        F.count_distinct("id").alias("n_contexts"), F.sum(F.col("end_at") - F.col("start_at")).alias("chars")
    )
    n_evidence = evidence.groupBy("query_id").agg(F.count_distinct("evidence_id").alias("n_evidence"))
    found = hits.groupBy("query_id").agg(
        F.min(F.when(F.col("rank") <= mrr_k, F.col("rank"))).alias("first"),
        F.count_distinct("evidence_id").alias("found"),
        F.count_distinct("id").alias("useful"),
    )
    joined = queries.select("query_id")
    for part in (per_query, n_evidence, found):
        joined = joined.join(part, "query_id", "left")
    zero = F.lit(0.0)
    return joined.select(
        "query_id",
        F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("found") / F.col("n_evidence"), zero).alias("recall"),
        F.coalesce(F.col("useful") / F.col("n_contexts"), zero).alias("precision"),
        F.coalesce("chars", F.lit(0)).cast("long").alias("chars"),
    )


def strategy_report(strategies: dict[str, DataFrame], evidence: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """(strategy, mrr, recall, precision, index_bytes, n_chunks) of chunkings (doc_id,
    start_at, end_at, content).  The candidates of a query are the chunks of the
    documents that hold its evidence, ranked by how far they start from a
    document's first third."""
    pairs = evidence.select("query_id", "doc_id", "n").distinct()
    w = W.partitionBy("query_id").orderBy("away", "doc_id", "start_at", "end_at")
    parts = []
    for name, chunks in strategies.items():
        met = chunks.drop("content").join(pairs, "doc_id").withColumn("away", F.abs(F.col("start_at") * 3 - F.col("n")))
        ranked = met.withColumn("rank", F.row_number().over(w)).withColumn("id", F.concat_ws(":", "doc_id", "start_at", "end_at"))
        figures = span_metrics(ranked, evidence, queries, top=top).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("mrr", "recall", "precision")])
        size = chunks.agg(F.sum(F.octet_length("content")).alias("index_bytes"), F.count(F.lit(1)).alias("n_chunks"))
        named = figures.withColumn("strategy", F.lit(name)).join(size.withColumn("strategy", F.lit(name)), "strategy")
        parts.append(named.select("strategy", "mrr", "recall", "precision", "index_bytes", "n_chunks"))
    return reduce(DataFrame.unionByName, parts)


def require_strategies(metrics: DataFrame, names: set[str]) -> None:
    """An error unless the metrics are of exactly these strategies."""
    found = {r.strategy for r in metrics.select("strategy").distinct().limit(len(names) + 1).collect()}
    if found != names:
        raise ValueError(f"strategies must be {sorted(names)}, not {sorted(found)}")


def release_gates(metrics: DataFrame) -> DataFrame:
    """Promotion of chunking strategies.  ``metrics``: strategy (fixed, auto,
    semantic), mrr, recall, precision, duration_ms, index_bytes.  Auto needs 5 %
    more MRR than fixed with no less recall and precision; semantic 3 % more
    than auto within twice its time and bytes.  A zero baseline fails."""
    names = ["fixed", "auto", "semantic"]
    wide = metrics.groupBy().pivot("strategy", names).agg(
        *[F.first(c).alias(c) for c in ("mrr", "recall", "precision", "duration_ms", "index_bytes")]
    )
    c = lambda s, m: F.col(f"{s}_{m}").cast("double")
    gains = lambda a, b, share: (c(a, "mrr") > 0) & (c(b, "mrr") >= c(a, "mrr") * (1 + share) - EPSILON)
    keeps = lambda a, b: (c(b, "recall") >= c(a, "recall") - EPSILON) & (c(b, "precision") >= c(a, "precision") - EPSILON)
    auto = gains("fixed", "auto", 0.05) & keeps("fixed", "auto")
    within = (c("semantic", "duration_ms") <= 2 * c("auto", "duration_ms")) & (c("semantic", "index_bytes") <= 2 * c("auto", "index_bytes"))
    return wide.select(
        F.coalesce(auto, F.lit(False)).alias("auto_passed"),
        F.coalesce(gains("auto", "semantic", 0.03) & within, F.lit(False)).alias("semantic_passed"),
    )


def keyword_scores(answers: DataFrame) -> DataFrame:
    """id, answer_coverage, context_coverage, faithfulness, relevance, precision of
    (id, question, reference, answer, context) by keywords found as substrings."""
    from corpusq.functions.text import eval_keywords

    def share(keys: str, text: str) -> Column:
        found = F.size(F.filter(F.col(keys), lambda k: F.lower(F.col(text)).contains(k)))
        return F.when(F.size(keys) == 0, F.lit(0.0)).otherwise(F.round(found / F.size(keys), 4))

    with_keys = answers.withColumns({f"{n}_keys": eval_keywords(F.col(n)) for n in ("question", "reference", "answer")})
    return with_keys.select(
        "id",
        share("reference_keys", "answer").alias("answer_coverage"),
        share("reference_keys", "context").alias("context_coverage"),
        share("answer_keys", "context").alias("faithfulness"),
        share("question_keys", "answer").alias("relevance"),
        share("question_keys", "context").alias("precision"),
    )


def is_template(relevant_ids: Column) -> Column:
    """No label, or only placeholders: such a case has a status and no metrics."""
    return (F.size(relevant_ids) == 0) | F.forall(relevant_ids, lambda x: x.rlike(r"(?i)placeholder|replace|todo|^<.*>$|^$"))


def case_errors(cases: DataFrame) -> DataFrame:
    """(case_id, error): rule violations of evidence cases (case_id, query,
    doc_id, version, n_chars, source_start, source_end, answer_evidence)."""
    rules = {
        "empty query": F.length(F.trim(F.coalesce("query", F.lit("")))) == 0,
        "missing document": F.col("doc_id").isNull(),
        "version is not a sha256": ~F.coalesce(F.lower("version").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "span out of bounds": ~F.coalesce(
            (F.col("source_start") >= 0) & (F.col("source_end") > F.col("source_start")) & (F.col("source_end") <= F.col("n_chars")),
            F.lit(False),
        ),
        "empty evidence": F.length(F.coalesce("answer_evidence", F.lit(""))) == 0,
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return cases.select("case_id", F.explode(found).alias("error"))
