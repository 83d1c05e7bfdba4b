"""Cutting pages into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places after which an oversized text is best cut.
BOUNDARIES = ("。", "\n", " ")
_BLANK = re.compile(r"\n\s*\n")


def cuts(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of at most `size` characters, each ending after its last boundary if that lies in the second half, the next `overlap` before the end."""
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + size)
        if stop < n:
            last = max(text.rfind(b, at, stop) for b in BOUNDARIES)
            if last - at > size // 2:
                stop = last + 1
        yield at, stop
        if stop == n:
            return
        at = max(at + 1, stop - overlap)


def pieces(text: str, size: int, overlap: int) -> list[str]:
    return [p for a, b in cuts(text, size, overlap) if (p := text[a:b].strip())]


def packed(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs joined while they fit; a paragraph over the size is cut on its own."""
    out: list[str] = []
    held: list[str] = []
    room = size
    for paragraph in filter(None, map(str.strip, _BLANK.split(text))):
        needed = len(paragraph) + (2 if held else 0)
        if needed > room:
            if held:
                out.append("\n\n".join(held))
            held, room = [], size
            if len(paragraph) > size:
                out += pieces(paragraph, size, overlap)
                continue
            needed = len(paragraph)
        held.append(paragraph)
        room -= needed
    if held:
        out.append("\n\n".join(held))
    return out


def _as_udf(cut, size: int, overlap: int):
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size is positive and overlap below it")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else cut(t, size, overlap))

    return run


def oversized_pieces(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    return _as_udf(pieces, size, overlap)(text)


def page_chunks(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    return _as_udf(packed, size, overlap)(text)


def split_pages(pages: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """One row a chunk: the columns of pages with text replaced, and chunk_index from 1 within the page. Null texts have no chunk."""
    rest = [c for c in pages.columns if c not in ("text", "chunk_index")]
    cut = pages.select(*rest, F.posexplode(page_chunks(F.col("text"), size, overlap)).alias("__i", "text"))
    return cut.select(*rest, "text", (F.col("__i") + 1).alias("chunk_index"))


def documents_without_chunks(pages: DataFrame, chunks: DataFrame, key: str = "document") -> DataFrame:
    """Documents of pages that no chunk came from."""
    return pages.select(key).distinct().join(chunks.select(key).distinct(), key, "left_anti")
