"""Fusion and diversification of ranked lists, for batches of queries.

Order is data: every list carries ``query_id`` and a rank, and every order ends
in an id.  Greedy steps run per query on candidate lists of bounded length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
NO_RANK = 1_000_000_000


def rrf(keyword: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, keyword_rank, vector_rank, score, rank): reciprocal rank
    fusion; ties by the better of the two ranks, then id."""
    a = keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    b = vector.select("query_id", "id", F.col("rank").alias("vector_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    best = F.least(F.coalesce("keyword_rank", F.lit(NO_RANK)), F.coalesce("vector_rank", F.lit(NO_RANK)))
    scored = both.withColumn("score", part("keyword_rank") + part("vector_rank")).withColumn("best", best)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "best", "id")
    return scored.withColumn("rank", F.row_number().over(order)).drop("best")


def added_scores(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """(query_id, id, score): max(0, 10 - |bm25|) plus 1 / (1 + distance)."""
    a = keyword.select("query_id", "id", F.greatest(F.lit(0.0), 10 - F.abs("score")).alias("s"))
    b = vector.select("query_id", "id", (1 / (1 + F.col("distance"))).alias("s"))
    return a.unionByName(b).groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def per_document_cap(hits: DataFrame, most: int, group: str = "doc_id") -> DataFrame:
    """The first ``most`` hits of each document of a query, in rank order."""
    w = W.partitionBy("query_id", group).orderBy("rank", "id")
    return hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def dedupe_ids(hits: DataFrame) -> DataFrame:
    """One row per query and id: highest score, first position."""
    return hits.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))


def interleave(hits: DataFrame) -> DataFrame:
    """Cohorts of a query by turns: first of each, second of each, ..."""
    w = W.partitionBy("query_id", "cohort").orderBy("rank", "id")
    turn = hits.withColumn("turn", F.row_number().over(w))
    order = W.partitionBy("query_id").orderBy("turn", "cohort", "id")
    return turn.withColumn("position", F.row_number().over(order)).drop("turn")


def rerank(hits: DataFrame, score: Column, top_n: int) -> DataFrame:
    """The first ``top_n`` hits by a scorer (null: not returned by it); the
    others keep their order behind them."""
    scored = hits.withColumn("rerank_score", F.when(F.col("rank") <= top_n, score))
    order = W.partitionBy("query_id").orderBy(
        F.col("rerank_score").isNull(), F.col("rerank_score").desc_nulls_last(), "rank", "id"
    )
    return scored.withColumn("final_rank", F.row_number().over(order))


def context_groups(hits: DataFrame) -> DataFrame:
    """Distinct parents of a query's hits, hits without parent counting for themselves."""
    own = F.coalesce(F.concat(F.lit("p"), F.col("parent_id").cast("string")), F.concat(F.lit("c"), F.col("id").cast("string")))
    return hits.groupBy("query_id").agg(F.count_distinct(own).alias("n_groups"))


def signature_dedupe(hits: DataFrame) -> DataFrame:
    """First hit of each text signature; empty signatures are all kept."""
    key = F.when(F.col("signature") == "", F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(F.col("signature"))
    w = W.partitionBy("query_id", key).orderBy("rank", "id")
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def _tokens(frame: pd.DataFrame) -> list[set]:
    return [set(t) for t in frame["tokens"]]


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def mmr(hits: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance per query: k hits, each time the one with the
    best weighted difference of scaled score and likeness to those chosen; the
    earlier wins a tie.  Lists of k or fewer stay as they are."""

    def select(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "id"]).reset_index(drop=True)
        if len(frame) > k:
            low, high = frame["score"].min(), frame["score"].max()
            scaled = (frame["score"] - low) / (high - low) if high > low else frame["score"] * 0 + 1.0
            sets, likeness, chosen = _tokens(frame), [0.0] * len(frame), []
            while len(chosen) < k:
                rest = [i for i in range(len(frame)) if i not in chosen]
                best = max(rest, key=lambda i: (weight * scaled[i] - (1 - weight) * likeness[i], -i))
                chosen.append(best)
                likeness = [max(x, _jaccard(sets[i], sets[best])) for i, x in enumerate(likeness)]
            frame = frame.iloc[chosen]
        return frame.assign(mmr_rank=range(1, len(frame) + 1))[["query_id", "id", "score", "rank", "mmr_rank"]]

    ids = hits.schema
    schema = (
        f"query_id {ids['query_id'].dataType.simpleString()}, id {ids['id'].dataType.simpleString()}, "
        "score double, rank int, mmr_rank int"
    )
    columns = hits.select("query_id", "id", F.col("score").cast("double"), F.col("rank").cast("int"), "tokens")
    return columns.groupBy("query_id").applyInPandas(select, schema)


def greedy_dedupe(hits: DataFrame, least: float = 0.85, chars: int = 80) -> DataFrame:
    """Hits that are not redundant with a better kept one of their query: the
    shorter text stands in the longer, or their token sets overlap."""

    def select(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "id"]).reset_index(drop=True)
        sets, kept = _tokens(frame), []
        for i, text in enumerate(frame["text"]):
            for j in kept:
                short, long = sorted((text, frame["text"][j]), key=len)
                smaller = min(len(sets[i]), len(sets[j]))
                if (len(short) >= chars and short in long) or (
                    smaller and len(sets[i] & sets[j]) / smaller >= least
                ):
                    break
            else:
                kept.append(i)
        return frame.iloc[kept][["query_id", "id", "rank"]]

    ids = hits.schema
    schema = f"query_id {ids['query_id'].dataType.simpleString()}, id {ids['id'].dataType.simpleString()}, rank int"
    columns = hits.select("query_id", "id", F.col("rank").cast("int"), "text", "tokens")
    return columns.groupBy("query_id").applyInPandas(select, schema)


def merge_cohorts(documents: DataFrame, graph: DataFrame, least: float = 0.85) -> DataFrame:
    """Graph hits, each with the first document hit of its query that it is
    redundant with (``merged_into``, or null when it stands)."""
    from corpusq.functions.text import redundant

    d = documents.select("query_id", F.col("id").alias("d_id"), F.col("rank").alias("d_rank"), F.col("text").alias("d_text"), F.col("tokens").alias("d_tokens"))
    pairs = graph.join(d, "query_id").where(
        redundant(F.col("text"), F.col("d_text"), F.col("tokens"), F.col("d_tokens"), least)
    )
    first = pairs.groupBy("query_id", "id").agg(F.min_by("d_id", F.struct("d_rank", "d_id")).alias("merged_into"))
    return graph.join(first, ["query_id", "id"], "left")


def min_max(c: str, by: str = "query_id") -> Column:
    """Score scaled to [0, 1] within a query; 1 where all are equal."""
    low, high = F.min(c).over(W.partitionBy(by)), F.max(c).over(W.partitionBy(by))
    return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(1.0))
