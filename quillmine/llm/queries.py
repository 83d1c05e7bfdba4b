"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from quillmine.llm import (
    queries_chat,
    queries_compaction,
    queries_fracsketch,
    queries_licenses,
    queries_media,
    queries_merkle,
    queries_mixing,
    queries_packing,
    queries_passages,
    queries_simhash,
    queries_substring,
    queries_toxicity,
    queries_urls,
)

_MODULES = (queries_toxicity, queries_media, queries_urls, queries_mixing, queries_chat, queries_substring, queries_packing, queries_simhash, queries_fracsketch, queries_licenses, queries_merkle, queries_compaction, queries_passages)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
