"""Retrieval quality on labelled questions.

cases: qid, question, relevant_document, relevant_pages, should_refuse. The names recall_at_5 and mrr_at_10 are
kept as they are known; both are taken over all results that a question gets.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillmine.functions.config import Settings
from quillmine.operators.retrieval import Backend, retrieve
from quillmine.sources.tables import persist


def metrics(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row: recall_at_5, mrr_at_10, page_hit_rate, refusal_accuracy, retrieval_hit_rate, citation_accuracy. results: qid, rank, document, page."""
    judged = cases.join(results.select("qid", "rank", "document", "page"), "qid", "left")
    hit = F.col("document") == F.col("relevant_document")
    a_case = judged.groupBy("qid", "should_refuse").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.coalesce(F.max(hit & F.array_contains("relevant_pages", F.col("page"))), F.lit(False)).alias("page_hit"),
        (F.count("rank") == 0).alias("empty"),
    )
    answerable = ~F.col("should_refuse")
    mean = lambda c: F.coalesce(F.avg(F.when(answerable, c)), F.lit(0.0))
    out = a_case.agg(
        mean(F.col("first").isNotNull().cast("double")).alias("recall_at_5"),
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr_at_10"),
        mean(F.col("page_hit").cast("double")).alias("page_hit_rate"),
        F.coalesce(F.avg((F.col("empty") == F.col("should_refuse")).cast("double")), F.lit(0.0)).alias("refusal_accuracy"),
    )
    return out.withColumns({"retrieval_hit_rate": F.col("recall_at_5"), "citation_accuracy": F.col("page_hit_rate")})


def timed(results: DataFrame, cases: DataFrame, started: float) -> tuple[DataFrame, float]:
    """The results, written, and the mean time of a case in milliseconds since `started`. Cases are counted as they run, not in a pass of their own."""
    seen = Observation()
    counted = cases.select("qid").observe(seen, F.count(F.lit(1)).alias("n"))
    # Cases without a result keep a row, so that the write runs through all of them.
    held = persist(counted.join(results, "qid", "left"), "results")
    return held.where("rank is not null"), (time.perf_counter() - started) * 1000 / seen.get["n"] if seen.get["n"] else 0.0


def evaluate(cases: DataFrame, corpus: DataFrame, threshold: float = 0.35, backend: Backend | None = None) -> DataFrame:
    """`metrics` of the retrieval for the cases, and average_response_time_ms: all cases run at once, so it is the run's time by their number, 0 without a case."""
    settings, started = replace(Settings(), similarity_threshold=threshold), time.perf_counter()
    found, mean = timed(retrieve(cases.select("qid", F.col("question").alias("text")), corpus, settings, backend), cases, started)
    return metrics(cases, found).withColumn("average_response_time_ms", F.lit(mean))
