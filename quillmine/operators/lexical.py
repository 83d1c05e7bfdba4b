"""Keyword overlap and BM25 of questions against whole corpora.

A corpus has `ordinal` (its order) and `text`; questions have a key and `text`. The corpus is tokenized once, into a written
table. Questions go to the documents: a batch of them, with the numbers of their tokens, travels to every task, each
document is scored where it is, and a task keeps its own best k for a question, so that no pair of a question and
a document is shuffled that can't be among the best. More questions than a batch are taken batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quillmine.functions.text import tokens
from quillmine.sources.tables import persist

K1, B = 1.5, 0.75
#: Scores are ordered by this many digits, so that the order in which parts are added doesn't matter.
DIGITS = 9
#: Questions of a batch, about, and their tokens; its matrix has a column for each question and a row for each token.
QUESTIONS, QUESTION_TOKENS = 256, 20_000
#: Documents scored at once.
DOCUMENTS = 256


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than the cluster has cores, dealt over all of them; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


@dataclass(frozen=True)
class LexicalIndex:
    """documents (ordinal, tokens), frequencies (token, idf), the number of documents and their mean length."""

    documents: DataFrame
    frequencies: DataFrame
    count: int
    mean_length: float


def tokenized(corpus: DataFrame, any_script: bool = True) -> DataFrame:
    """ordinal and tokens, as a written table."""
    return persist(spread(corpus.select("ordinal", "text")).select("ordinal", tokens(F.col("text"), any_script).alias("tokens")), "tokens")


def build_index(corpus: DataFrame, any_script: bool = True) -> LexicalIndex:
    found = tokenized(corpus, any_script)
    count, length = found.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.size("tokens"), F.lit(0)))).first()
    df = F.count(F.lit(1))
    frequencies = found.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.log(1 + (count - df + 0.5) / (df + 0.5)).alias("idf"))
    return LexicalIndex(found, frequencies, count, max(0, length or 0) / count if count else 0.0)


def top(scored: DataFrame, by: list[str], k: int | str) -> DataFrame:
    """The first k rows of each group of `by` in the order of score, then ordinal, with `rank` from 1. k may name a column."""
    order = Window.partitionBy(*by).orderBy(F.round("score", DIGITS).desc(), F.col("ordinal"))
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def asked_tokens(questions: DataFrame, by: list[str], any_script: bool = True) -> DataFrame:
    """by, token and qf, its count in the question's text."""
    return questions.select(*by, F.explode(tokens(F.col("text"), any_script)).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("qf"))


def _batches(asked: DataFrame, by: list[str]):
    """Rows (by, token, qf, idf) of the questions, batch by batch; asked has these columns. Which batch a question is in follows from a hash of its key."""
    asked = asked.select(*by, "token", "qf", "idf")
    sizes = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    batches = max(-(-sizes[0] // QUESTIONS), -(-sizes[1] // QUESTION_TOKENS))
    if batches > 1:
        asked = persist(asked.withColumn("__batch", F.pmod(F.xxhash64(*by), F.lit(batches))), "asked")
    for batch in range(batches):
        rows = (asked if batches == 1 else asked.where(F.col("__batch") == batch)).collect()
        if rows:
            yield rows, batches


def _matrix(rows, by: list[str]) -> dict:
    keys = sorted({tuple(r[b] for b in by) for r in rows})
    words = sorted({r.token for r in rows})
    at, place = {k: i for i, k in enumerate(keys)}, {w: i for i, w in enumerate(words)}
    qf, idf = np.zeros((len(words), len(keys))), np.zeros(len(words))
    for r in rows:
        qf[place[r.token], at[tuple(r[b] for b in by)]] = r.qf
        idf[place[r.token]] = r.idf
    return {"keys": keys, "words": words, "qf": qf, "idf": idf}


def _overlap(counts: np.ndarray, lengths: np.ndarray, asked: dict) -> np.ndarray:
    """Shared tokens (as multisets) by all tokens of the question: what both have at least once, twice, and so on."""
    qf, shared, at_least = asked["qf"], 0, 1
    while True:
        rows = np.flatnonzero((qf >= at_least).any(axis=1))
        if not len(rows):
            return np.minimum(1.0, shared / qf.sum(axis=0))
        shared = shared + (counts[:, rows] >= at_least).astype(np.float64) @ (qf[rows] >= at_least).astype(np.float64)
        at_least += 1


def _bm25(mean_length: float, k1: float, b: float):
    def scores(counts: np.ndarray, lengths: np.ndarray, asked: dict) -> np.ndarray:
        norm = (1 - b) + (b * lengths / mean_length if mean_length else 0.0 * lengths)
        weight = asked["idf"] * counts * (k1 + 1) / (counts + k1 * norm[:, None])
        return np.where(counts > 0, weight, 0.0) @ (asked["qf"] > 0).astype(np.float64)

    return scores


def _scored(documents: DataFrame, asked: DataFrame, by: list[str], k: int, score) -> DataFrame:
    """by, ordinal and score above zero: at least the best k documents of each question, ties by ordinal."""
    spark, fields = documents.sparkSession, [asked.schema[b] for b in by]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", ordinal long, score double"
    out = None
    for rows, batches in _batches(asked, by):
        shared = spark.sparkContext.broadcast(_matrix(rows, by))
        found = documents.select(F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(_best(shared, by, [to_arrow_type(f.dataType) for f in fields], k, score), schema)
        if batches > 1:  # a batch's best rows are written before the next goes out
            found = persist(found, "scored")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _best(shared, by: list[str], kinds: list[pa.DataType], k: int, score):
    def run(batches):
        import pyarrow.compute as pc

        asked = shared.value
        words, n = pa.array(asked["words"], pa.string()), len(asked["keys"])
        best, place = np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                lists = part.column("tokens")
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                which = pc.index_in(lists.flatten(), value_set=words)
                known = which.is_valid().to_numpy(zero_copy_only=False)
                counts = np.zeros((len(part), len(words)))
                np.add.at(counts, (np.repeat(np.arange(len(lengths)), lengths)[known], which.fill_null(0).to_numpy(zero_copy_only=False)[known]), 1.0)
                new = score(counts, lengths, asked).T
                new = np.where(new > 0, new, -np.inf)
                ordinal = part.column("ordinal").to_numpy(zero_copy_only=False)
                both = np.concatenate([best, new], axis=1)
                where = np.concatenate([place, np.broadcast_to(ordinal, new.shape)], axis=1)
                order = np.lexsort((where, -np.round(both, DIGITS)), axis=1)[:, :k]
                best, place = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
        q, c = np.nonzero(np.isfinite(best))
        if len(q):
            keys = [pa.array([asked["keys"][i][b] for i in q], kind) for b, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(place[q, c]), pa.array(best[q, c])], [*by, "ordinal", "score"])

    return run


def bm25(index: LexicalIndex, question_tokens: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """qid, ordinal and score above zero, at least the best k of each question; question_tokens: qid and token, repeats count once."""
    wanted = question_tokens.select("qid", "token").distinct().join(index.frequencies, "token").select("qid", "token", F.lit(1).alias("qf"), "idf")
    return _scored(index.documents, wanted, ["qid"], k, _bm25(index.mean_length, k1, b))


def keyword_scores(documents: DataFrame, questions: DataFrame, by: list[str], k: int, any_script: bool = True) -> DataFrame:
    """by, ordinal and score in (0, 1], at least the best k of each question: shared tokens (as multisets) by all tokens of the question's text."""
    return _scored(documents, asked_tokens(questions, by, any_script).withColumn("idf", F.lit(0.0)), by, k, _overlap)


def pair_scores(pairs: DataFrame, documents: DataFrame, questions: DataFrame, by: list[str], any_script: bool = True) -> DataFrame:
    """by, ordinal and the keyword score of given pairs (qid, ordinal) alone, those above zero."""
    asked = asked_tokens(questions, by, any_script)
    total = asked.groupBy(*by).agg(F.sum("qf").alias("total"))
    said = pairs.select("qid", "ordinal").join(documents, "ordinal").select("qid", "ordinal", F.explode("tokens").alias("token")).groupBy("qid", "ordinal", "token").agg(F.count(F.lit(1)).alias("tf"))
    shared = said.join(asked, ["qid", "token"]).groupBy(*by, "ordinal").agg(F.sum(F.least("tf", "qf")).alias("shared"))
    return shared.join(total, by).select(*by, "ordinal", F.least(F.lit(1.0), F.col("shared") / F.col("total")).alias("score"))
