"""Named tools: callables from a session and checked arguments to a DataFrame.

The registry is the extension point of the engine: the first registration of a
name wins, and arguments are checked against their declared types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq import model
from corpusq.functions import text as T
from corpusq.operators import catalog, graph, lexical


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    run: Callable[..., DataFrame]
    arguments: dict[str, type] = field(default_factory=dict)
    required: tuple[str, ...] = ()


class Tools:
    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def add(self, tool: Tool) -> None:
        self._tools.setdefault(tool.name, tool)

    def names(self) -> list[str]:
        return sorted(self._tools)

    def call(self, name: str, spark: SparkSession, sf_dir: str, **arguments) -> DataFrame:
        tool = self._tools[name]
        missing = [a for a in tool.required if a not in arguments]
        unknown = [a for a in arguments if a not in tool.arguments]
        wrong = [a for a, v in arguments.items() if a in tool.arguments and not isinstance(v, tool.arguments[a])]
        if missing or unknown or wrong:
            raise ValueError(f"{name}: missing {missing}, unknown {unknown}, wrong type {wrong}")
        return tool.run(spark, sf_dir, **arguments)


def _search(spark, sf_dir, query: str, top_k: int = 10) -> DataFrame:
    docs = model.enabled_documents(spark, sf_dir).where(model.searchable())
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    return lexical.bm25_top_k(docs, asked, catalog.bounded(top_k, 1, 50, 10))


def _grep(spark, sf_dir, terms: str, limit: int = 10) -> DataFrame:
    docs = model.enabled_documents(spark, sf_dir).where(model.searchable())
    return docs.where(T.contains_all(F.col("text"), terms.split())).select("doc_id", "title").orderBy("doc_id").limit(limit)


def _document(spark, sf_dir, doc_id: int) -> DataFrame:
    docs = model.documents(spark, sf_dir).where((F.col("doc_id") == doc_id) & model.active())
    return docs.select("doc_id", "title", "kb_id", "n_chars")


def _statistics(spark, sf_dir, kind: str) -> DataFrame:
    docs = model.documents(spark, sf_dir).where(model.active())
    if kind == "documents":
        return docs.agg(F.count(F.lit(1)).alias("n"))
    if kind == "by_base":
        return catalog.counts(docs, "kb_id")
    if kind == "by_language":
        return catalog.counts(docs, "lang")
    if kind == "storage":
        return docs.agg(F.sum("n_chars").alias("n"))
    raise ValueError("kind is documents, by_base, by_language or storage")


def _links(spark, sf_dir, slug: str, depth: int = 1) -> DataFrame:
    _, links = graph.page_links(model.read(spark, sf_dir, "pages"))
    start = spark.range(1).select(F.lit(slug).alias("slug"))
    return graph.ego(links, start, catalog.bounded(depth, 1, 3, 1))


def builtin() -> Tools:
    """The tools that the engine comes with."""
    tools = Tools()
    tools.add(Tool("search", "BM25 over searchable documents", _search, {"query": str, "top_k": int}, ("query",)))
    tools.add(Tool("grep", "documents that hold every term", _grep, {"terms": str, "limit": int}, ("terms",)))
    tools.add(Tool("document", "what is known of a document", _document, {"doc_id": int}, ("doc_id",)))
    tools.add(Tool("statistics", "fixed statistics", _statistics, {"kind": str}, ("kind",)))
    tools.add(Tool("links", "pages around a page", _links, {"slug": str, "depth": int}, ("slug",)))
    return tools
