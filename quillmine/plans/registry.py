"""Queries by name, and their SQL."""

from __future__ import annotations

from quillmine.plans import case_queries, index_queries, retrieval_queries, service_queries, text_queries, web_queries

FLAGSHIP = "hybrid_retrieval"
_MODULES = (retrieval_queries, text_queries, web_queries, case_queries, index_queries, service_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
