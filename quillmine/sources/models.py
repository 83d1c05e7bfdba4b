"""Models behind column functions: text encoders, rerankers, and chat endpoints."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmine.functions.config import Settings
from quillmine.functions.errors import GenerationUnavailable

#: Providers that speak the common chat protocol.
COMPATIBLE = ("siliconflow", "nvidia", "openai", "openai-compatible")
GROQ_URL = "https://api.groq.com/openai/v1"


def encoder(encode: Callable[[list[str]], list[list[float]]], unit: bool = True) -> Callable[[Column], Column]:
    """A function from texts to vectors as a column function; vectors get unit length if asked for."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = encode(texts.fillna("").tolist())
        if unit:
            vectors = [[x / n for x in v] if (n := sum(x * x for x in v) ** 0.5) else list(v) for v in vectors]
        return pd.Series([list(map(float, v)) for v in vectors])

    return run


def reranker(rank: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A function from (question, text) pairs to scores as a column function."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        scores = rank(list(zip(questions, texts)))
        if len(scores) != len(texts):
            raise ValueError("a score is needed for each pair")
        return pd.Series([float(s) for s in scores])

    return run


def complete(prompt: str, url: str, key: str, model: str, timeout: float) -> str:
    """One answer of a chat endpoint, without sampling."""
    body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "stream": False}).encode()
    request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return str(json.load(reply)["choices"][0]["message"]["content"])
    except urllib.error.HTTPError as error:
        raise GenerationUnavailable(f"the chat model failed (HTTP {error.code})") from error
    except (OSError, ValueError, KeyError, IndexError, TypeError) as error:
        raise GenerationUnavailable("the chat model failed") from error


def chat_model(settings: Settings) -> Callable[[Column], Column]:
    """Prompts to answers by the provider in the settings; a wrong configuration is told at once."""
    provider, url, key = settings.llm_provider, settings.llm_base_url, settings.llm_api_key
    if provider in COMPATIBLE:
        if not key or not url:
            raise GenerationUnavailable("LLM_API_KEY and LLM_BASE_URL are needed")
    elif provider == "groq":
        key, url = settings.groq_api_key or key, url or GROQ_URL
        if not key:
            raise GenerationUnavailable("GROQ_API_KEY or LLM_API_KEY is needed")
    else:
        raise GenerationUnavailable(f"unknown LLM_PROVIDER {provider}")
    model, timeout = settings.llm_model, settings.llm_timeout

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: complete(p, url, key, model, timeout))

    return run
