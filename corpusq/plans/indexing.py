"""A vector index rebuilt over all chunks, stopped half-way and resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq import model
from corpusq.operators import chunking
from corpusq.plans.chunks import SQL_CHUNKS
from corpusq.registry import query
from corpusq.sources import index_rebuild
from corpusq.tables import shared_folder


def letter_vectors(tenant: object, texts: list[str]) -> list[list[float]]:
    """A plain stand-in for a model: length, letters e and spaces."""
    return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


class After:
    """False for the first ``n`` questions, then true."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self) -> bool:
        self.n -= 1
        return self.n < 0


@query(
    "rebuilt_index",
    f"""WITH {SQL_CHUNKS} SELECT doc_id || ':' || chunk_index AS id, doc_id % 4 AS tenant_id, length(content)::DOUBLE AS v_length,
      (length(content) - length(replace(content, 'e', '')))::DOUBLE AS v_e, (length(content) - length(replace(content, ' ', '')))::DOUBLE AS v_space FROM c""",
)
def rebuilt_index(spark, sf_dir):
    """The vectors of every chunk, read from an index whose first rebuild was cancelled
    after a wave and whose second went on from there."""
    chunks = chunking.fixed_chunks(model.read(spark, sf_dir, "documents"))
    rows = chunks.select(F.concat_ws(":", "doc_id", "chunk_index").alias("id"), F.pmod("doc_id", F.lit(4)).alias("tenant_id"), "content")
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index_rebuild.needs_rebuild(spark, folder, "embedding_model_changed")
    settings = {"n_batches": 32, "at_once": 16}
    index_rebuild.rebuild(rows, folder, letter_vectors, "letters:3", **settings, cancelled=After(2))
    index_rebuild.rebuild(rows, folder, letter_vectors, "letters:3", **settings)
    v = F.col("vector")
    return index_rebuild.read(spark, folder).select("id", "tenant_id", v[0].alias("v_length"), v[1].alias("v_e"), v[2].alias("v_space"))
