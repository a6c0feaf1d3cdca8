"""All named queries of the engine with their SQL."""

from __future__ import annotations

from . import analysis, helpers, indexed, ingestion, payloads, records, requested, retrieval, states, stemmed, subworded, trees, webpages

flagship = retrieval.hybrid_rrf_topk

_PARTS = (retrieval, ingestion, analysis, records, payloads, indexed, stemmed, requested, trees, states, webpages, subworded, helpers)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
