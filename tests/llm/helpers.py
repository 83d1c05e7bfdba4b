"""Small tables with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, source=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", source(i) if source else f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, and columns whose names clash with results."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [
        (1, "plain words in a text", "en", "a", 5), (1, "plain words in a text", "en", "a", 5), (1, "other text under one id", "en", "b", 5), (None, "no id here", None, None, None),
        (None, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, long, "en", "a", len(long)), (5, "ümläut 日本語 \U0001f600 x", "de", "b", 1), (-7, "x", "en", "a", 1),
    ]
    extra = spark.createDataFrame([(*r, 1, 2, "k", True) for r in rows], DOCS + ", n_words int, score int, kept string, tail boolean")
    return extra


def words_text(rng, n, vocabulary=400):
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


def rng(seed=0):
    return random.Random(seed)


class Sets:
    """Disjoint sets with their smallest member as the name."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
