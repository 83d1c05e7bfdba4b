"""Fusing rankings, removing repeated evidence, and spreading it over documents.

Evidence has qid, document, page, text, score and `ordinal`, its place in the order of arrival, which settles ties.
A key that a better item takes over keeps the place of its first item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.functions.text import clean
from quillmine.operators.lexical import DIGITS

KEY = ["document", "page", "text"]


def reciprocal_rank_fusion(rankings: DataFrame, rrf_k: int = 60) -> DataFrame:
    """rankings: qid, list (its number), rank, KEY and payload. Result: qid, KEY, score (1 for the best of a question), ordinal and the payload of the last list."""
    payload = F.max_by(F.col("payload"), F.struct("list", "rank"))
    fused = rankings.groupBy("qid", *KEY).agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("raw"), F.min(F.struct("list", "rank")).alias("first"), payload.alias("payload")
    )
    best = F.max("raw").over(Window.partitionBy("qid"))
    scored = fused.withColumn("score", F.col("raw") / best)
    order = Window.partitionBy("qid").orderBy("first")
    return scored.withColumn("ordinal", F.row_number().over(order)).select("qid", *KEY, "score", "ordinal", "payload")


def _by_score() -> list[Column]:
    return [F.round("score", DIGITS).desc(), F.col("ordinal")]


def deduplicate(evidence: DataFrame, top_k: int | str | None = None) -> DataFrame:
    """The best item of each (document, page, text without regard to case and spacing) of a question, the first of equals, best first, with rank."""
    keyed = evidence.withColumn("__form", F.lower(clean(F.col("text"))))
    same = Window.partitionBy("qid", "document", "page", "__form")
    keyed = keyed.withColumn("__first", F.min("ordinal").over(same)).withColumn("__n", F.row_number().over(same.orderBy(*_by_score())))
    kept = keyed.where("__n = 1").withColumn("ordinal", F.col("__first")).drop("__form", "__first", "__n", "rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*_by_score())))
    if top_k is None:
        return ranked
    return ranked.where(F.col("rank") <= (F.col(top_k) if isinstance(top_k, str) else F.lit(top_k)))


def diversify(evidence: DataFrame, top_k: int | str, most_a_document: int, identity: Column | None = None) -> DataFrame:
    """Rounds over documents: the best of each first, then the second best, at most most_a_document rounds and top_k items, with rank."""
    who = F.col("document") if identity is None else identity
    unique = deduplicate(evidence).drop("rank").withColumn("__who", who)
    unique = unique.withColumn("__round", F.row_number().over(Window.partitionBy("qid", "__who").orderBy(*_by_score()))).where(F.col("__round") <= most_a_document)
    ranked = unique.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("__round", *_by_score())))
    return ranked.where(F.col("rank") <= (F.col(top_k) if isinstance(top_k, str) else F.lit(top_k))).drop("__who", "__round")
