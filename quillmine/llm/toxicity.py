"""Toxicity scores from a weighted lexicon that is matched by Aho-Corasick.

Texts are folded first (compatibility forms, case, homoglyphs, digits and signs that stand
for letters; l becomes i, as 1, | and ! stand for either), so that one entry matches its disguises. Entries are whole words or word
beginnings with a log-odds weight learnt from labelled rows; an exception phrase takes back
the weight of the entries inside it. A logistic curve over the strongest entry and the
matched weight, each also normalised by length, gives the score.

Defined results: a null text counts as empty; an empty text gets the score of a text without a match.
Rows keep their number: a repeated row gets a score each time, a null doc_id is kept and not
held out. Other columns are not read. Without labelled rows of both kinds all scores are 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import slices, small_batches, utf8

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
HIDDEN = "­​‌‍⁠﻿"

#: 1, | and ! may stand for i or l, so both are one letter in folded texts and entries.
_LETTERS = str.maketrans({c: "i" if x == "l" else x for c, x in (HOMOGLYPHS | DIGITS | {"l": "l"}).items()} | {c: None for c in HIDDEN})
_SIGN = re.compile(r"(?<=[^\W_])[@$!|€](?=[^\W_])")
_GAP = re.compile(r"[\W_]+")

PREFIXES = (4, 5, 6)
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
LEAST_DOCS = 3
#: Entries (and exception phrases) that a model keeps, those of the strongest evidence first; a fit with more evidence than that loses its weakest entries.
MOST_ENTRIES = 4_000


def fold(text: str) -> str:
    """Words of the folded text with one space before, between and after."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(c in text for c in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return " " + _GAP.sub(" ", text.translate(_LETTERS)).strip() + " "


def features(folded: str) -> set[str]:
    """Candidate entries of a folded text: its words, and beginnings of its longer words."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) >= 3} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}


@dataclass(frozen=True)
class ToxicityModel:
    """weights: entry to weight; an entry starts with a space and ends with one if it is a whole word."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = ()

    def automaton(self):
        return _automaton(tuple(self.weights.items()), self.exceptions)

    def signals(self, text: str, automaton=None) -> tuple[float, float, float]:
        """The strongest entry; the matched weight by the square root of the words, and by their number. Who has many texts gives the automaton."""
        automaton, folded = automaton or self.automaton(), fold(text)
        if automaton is None:
            return 0.0, 0.0, 0.0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        if spared:
            edge = np.zeros(len(folded) + 1, np.int32)
            np.add.at(edge, [a for a, _ in spared], 1)
            np.add.at(edge, [b for _, b in spared], -1)
            inside = np.cumsum(edge) > 0
            hits = {s: w for s, w in hits.items() if not inside[s]}
        total, n = sum(hits.values()), max(1, folded.count(" ") - 1)
        return max(hits.values(), default=0.0), total / math.sqrt(n), 20.0 * total / max(n, 20)

    def score(self, signals: np.ndarray) -> np.ndarray:
        if not self.curve:
            return np.zeros(len(signals))
        return 1.0 / (1.0 + np.exp(-np.clip(_design(signals) @ np.array(self.curve), -30, 30)))


@lru_cache(maxsize=4)
def _automaton(weights: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    if not weights:
        return None
    automaton = ahocorasick.Automaton()
    for entry, weight in weights:
        automaton.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        automaton.add_word(phrase, (len(phrase), None))
    automaton.make_automaton()
    return automaton


def _design(signals: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(signals)), signals[:, 0], np.log1p(signals[:, 1]), np.log1p(signals[:, 2])])


def _logistic(signals: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method with a ridge on all but the constant."""
    x, beta = _design(signals), np.zeros(4)
    penalty = np.diag([1e-3, ridge, ridge, ridge])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (label - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _weights(counts: Iterable[tuple[str, int, int]], positive: int, negative: int, most: int) -> dict[str, float]:
    """Entries whose log odds are high beyond doubt; of a family of beginnings with equal counts the longest says no more, so all stay and only the strongest counts at a place."""
    kept = []
    for entry, p, n in counts:
        odds = math.log((p + 0.5) / (positive + 1)) - math.log((n + 0.5) / (negative + 1))
        sure = odds - 1.64 * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if p >= LEAST_DOCS and sure > 0.7:
            kept.append((sure * math.sqrt(p), entry, sure))
    return {entry: weight for _, entry, weight in sorted(kept, key=lambda k: (-k[0], k[1]))[:most]}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, exceptions: Iterable[str] = (), most_entries: int = MOST_ENTRIES) -> ToxicityModel:
    """Learn entries, exception phrases and the curve from about `sample_rows` labelled rows (the documented bound of the fit).

    The sample is drawn by a hash of the id, copies of one text count once, and each half of it
    calibrates the curve with the entries that the other half gives. At most `most_entries` entries and as many phrases are kept.
    """
    small_batches(docs)
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = marked.count()
    share = min(1.0, sample_rows / max(1, total))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("text").agg(F.max("label").alias("label")).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    sample = sample.select("text", "label", "half").persist()
    try:
        size = {(r.half, r.label): r["count"] for r in sample.groupBy("half", "label").count().collect()}
        counts = sample.mapInArrow(_count, "entry string, half int, p long, n long").groupBy("entry").agg(
            *(F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in "pn")
        )
        counts = counts.where((F.col("p0") + F.col("p1") >= LEAST_DOCS) & ((F.col("p0") + F.col("p1")) * 4 >= F.col("n0") + F.col("n1"))).collect()
        positive, negative = ([size.get((h, y), 0) for h in (0, 1)] for y in (1, 0))
        if not sum(positive) or not sum(negative):
            return ToxicityModel()
        everything = _weights([(r.entry, r.p0 + r.p1, r.n0 + r.n1) for r in counts], sum(positive), sum(negative), most_entries)
        other = [_weights([(r.entry, r[f"p{1 - h}"], r[f"n{1 - h}"]) for r in counts], positive[1 - h], negative[1 - h], most_entries) for h in (0, 1)]
        phrases = tuple(fold(x) for x in exceptions) + _phrases(sample, everything, most_entries)
        models = [ToxicityModel(w, phrases) for w in other]
        rows = sample.mapInArrow(_signals(models), "label int, a double, b double, c double").collect()
        data = np.array([list(r) for r in rows], dtype=float)
        return ToxicityModel(everything, phrases, _logistic(data[:, 1:], data[:, 0]))
    finally:
        sample.unpersist()


def _count(batches):
    """Counts of entries, given out as soon as many are held."""
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    held: Counter = Counter()

    def flush():
        keys = list({(e, h) for e, h, _ in held})
        for at in range(0, len(keys), 20_000):
            rows = [(e, h, held[e, h, 1], held[e, h, 0]) for e, h in keys[at : at + 20_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["entry", "half", "p", "n"])
        held.clear()

    for batch in batches:
        for text, label, half in zip(*(c.to_pylist() for c in batch.columns)):
            held.update((e, half, int(bool(label))) for e in features(fold(text)))
            if len(held) > 150_000:
                yield from flush()
    yield from flush()


def _phrases(sample: DataFrame, weights: dict[str, float], most: int, least: int = 5) -> tuple[str, ...]:
    """Two-word phrases around an entry that only unmarked texts have, `least` of them at least."""

    def found(batches):
        automaton, model = None, ToxicityModel(weights)
        seen: Counter = Counter()
        for batch in batches:
            automaton = automaton or model.automaton()
            if automaton is None:
                return
            for text, label, _ in zip(*(c.to_pylist() for c in batch.columns)):
                folded, own = fold(text), set()
                for end, (length, _) in automaton.iter(folded):
                    start = end - length + 1
                    stop = folded.find(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start) if start else -1, folded.find(" ", stop + 1)
                    own |= {folded[before : stop + 1]} if before >= 0 else set()
                    own |= {folded[start : after + 1]} if after >= 0 else set()
                seen.update((p, label) for p in own)
        rows = [(p, y, n) for (p, y), n in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64()))], ["phrase", "label", "n"])

    counted = sample.mapInArrow(found, "phrase string, label int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum("label").alias("marked"))
    return tuple(r.phrase for r in counted.where(f"marked = 0 and clean >= {least}").orderBy(F.desc("clean"), "phrase").limit(most).collect())


def _signals(models: list[ToxicityModel]):
    def run(batches):
        built = [m.automaton() for m in models]
        for batch in batches:
            rows = [(y, *models[h].signals(t, built[h])) for t, y, h in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.float64()] * 3))], ["label", "a", "b", "c"])

    return run


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` of every row, its score in 0..1, the strongest entry's weight, and predicted (1 from the threshold on)."""
    keep = list(keep)
    columns = list(dict.fromkeys([*keep, "text"]))
    source = small_batches(docs).select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", score double, strongest double, predicted int"

    def run(batches):
        automaton = model.automaton()
        for batch in slices(batches):
            texts = utf8(batch.column("text")).to_pylist()
            signals = np.array([model.signals(t, automaton) for t in texts]).reshape(-1, 3)
            scores = model.score(signals)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(scores), pa.array(signals[:, 0]), pa.array((scores >= threshold).astype(np.int32))], [*keep, "score", "strongest", "predicted"]
            )

    return source.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    return labels.where(~held_out())
