"""Exact nearest neighbours of a batch of queries.

Queries are taken in blocks of a fixed number; a block is sent to the tasks,
each keeps its best k per query while it reads its vectors once, and a last
step merges the few rows of each query.  Memory is that of a block and a
batch, whatever the number of vectors or queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK = 4_096
#: Vectors of a step, and cells of its table of queries and vectors.
STEP, STEP_CELLS = 2_048, 1_000_000


def _block_top_k(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = sent.value
        best_d = np.full((len(own_ids), 0), np.inf)
        best_i = np.zeros((len(own_ids), 0), np.int64)
        step = max(1, min(STEP, STEP_CELLS // max(len(own_ids), 1)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part_ids, part = (np.array(c.to_pylist(), t) for c, t in zip(batch.slice(begin, step).columns, (np.int64, np.float64)))
                squares = np.square(own).sum(1)[:, None] + np.square(part).sum(1)[None] - 2 * own @ part.T
                if exclude_self:
                    squares[own_ids[:, None] == part_ids[None]] = np.inf
                best_d = np.hstack([best_d, squares])
                best_i = np.hstack([best_i, np.broadcast_to(part_ids, squares.shape)])
                order = np.lexsort((best_i, np.round(best_d, 12)), axis=1)[:, :k]
                best_d = np.take_along_axis(best_d, order, 1)
                best_i = np.take_along_axis(best_i, order, 1)
        keep = np.isfinite(best_d)
        q = np.broadcast_to(own_ids[:, None], best_d.shape)[keep]
        yield pa.RecordBatch.from_pydict(
            {"query_id": q, "vec_id": best_i[keep], "distance": np.sqrt(np.maximum(best_d[keep], 0))}
        )

    return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, distance double")


def knn(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, rank): k nearest by L2, equal distances by id.

    ``queries`` has query_id and embedding; it is a stated query set and is read
    block by block.  A block costs one scan of the vectors, whose reading is small
    beside the distances to thousands of queries.
    """
    blocks, rows = [], []
    for r in queries.select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            blocks.append(rows)
            rows = []
    if rows or not blocks:
        blocks.append(rows)
    found = [
        _block_top_k(
            vectors,
            np.array([r.query_id for r in b], np.int64),
            np.array([r.embedding for r in b], np.float64).reshape(len(b), -1),
            k,
            exclude_self,
        )
        for b in blocks
    ]
    merged = reduce(DataFrame.unionByName, found)
    best = W.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
