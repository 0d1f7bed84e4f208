"""Registered queries."""

from corpusq.plans import analytics, blocks, chat, chunks, contexts, contributions, extraction, graphs, indexing, match_ranges, operations, records, retrieval  # noqa: F401
