"""Settings with their checks."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


class InvalidSettings(ValueError):
    """A setting is out of its range."""


@dataclass(frozen=True)
class Settings:
    collection_name: str = "campus_documents"
    distance_metric: str = "cosine"
    embedding_model: str = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"
    llm_provider: str = "groq"
    llm_model: str = "llama-3.3-70b-versatile"
    llm_api_key: str | None = None
    llm_base_url: str | None = None
    llm_timeout: float = 120.0
    groq_api_key: str | None = None
    chunk_size: int = 1000
    chunk_overlap: int = 150
    top_k: int = 4
    fetch_k: int = 20
    aggregate_top_k: int = 10
    aggregate_fetch_k: int = 20
    aggregate_max_chunks_per_document: int = 2
    similarity_threshold: float = 0.40
    keyword_bonus_weight: float = 0.25  # read and checked, not used by any score
    hybrid_search: bool = True
    rrf_k: int = 60
    reranker_enabled: bool = False
    reranker_model: str = "BAAI/bge-reranker-v2-m3"
    reranker_candidates: int = 20
    max_excerpt_chars: int = 240
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        rules = (
            (self.chunk_size > 0 and 0 <= self.chunk_overlap < self.chunk_size, "chunk_size is positive and chunk_overlap below it"),
            (0 < self.top_k <= self.fetch_k, "top_k is positive and fetch_k not below it"),
            (0 < self.aggregate_top_k <= self.aggregate_fetch_k, "aggregate_top_k is positive and aggregate_fetch_k not below it"),
            (self.aggregate_max_chunks_per_document > 0, "aggregate_max_chunks_per_document is positive"),
            (0 <= self.similarity_threshold <= 1, "similarity_threshold is from 0 to 1"),
            (0 <= self.keyword_bonus_weight <= 1, "keyword_bonus_weight is from 0 to 1"),
            (self.rrf_k > 0 and self.reranker_candidates > 0, "rrf_k and reranker_candidates are positive"),
            (self.distance_metric in ("cosine", "l2", "ip"), "distance_metric is cosine, l2 or ip"),
            (self.llm_timeout > 0, "llm_timeout is positive"),
        )
        for holds, rule in rules:
            if not holds:
                raise InvalidSettings(rule)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings from upper-case environment names."""
        env = os.environ if env is None else env
        found: dict = {}
        renamed = {"collection_name": "CHROMA_COLLECTION"}
        for f in fields(cls):
            value = env.get(renamed.get(f.name, f.name.upper()))
            if value is not None:
                found[f.name] = _parsed(value, f.default)
        model = env.get("LLM_MODEL_ID") or env.get("LLM_MODEL")
        if model:
            found["llm_model"] = model
        found["llm_api_key"] = env.get("LLM_API_KEY") or env.get("GROQ_API_KEY") or None
        for name in ("llm_base_url", "groq_api_key"):
            found[name] = env.get(name.upper()) or None
        for name in ("distance_metric", "llm_provider"):
            if name in found:
                found[name] = found[name].strip().lower()
        return cls(**found)

    def index_configuration(self) -> dict:
        """What changes the meaning or shape of stored chunks."""
        return {
            "collection_name": self.collection_name,
            "distance_metric": self.distance_metric,
            "embedding_model": self.embedding_model,
            "normalize_embeddings": True,
            "chunk_size": self.chunk_size,
            "chunk_overlap": self.chunk_overlap,
            "course_code_normalization_version": 1,
        }


def _parsed(value: str, default):
    if isinstance(default, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, (int, float)):
        return type(default)(value)
    return value
