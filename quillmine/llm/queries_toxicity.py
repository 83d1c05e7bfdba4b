"""Query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import table
from quillmine.llm.toxicity import fit, held_out, score, training_labels


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", F.col("strongest").alias("strongest_entry"))


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
