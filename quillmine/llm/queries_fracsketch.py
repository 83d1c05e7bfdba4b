"""Query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import table
from quillmine.llm.fracsketch import as_text, near, neighbours, sketch


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ring = ring.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("cut")), F.substring(F.col("next_text"), F.lit(1), F.col("cut")))
    ring = ring.withColumn("edited", edited).withColumn("edited_fp", sketch(F.col("edited")))
    return ring.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        near(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        near(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


QUERIES = {"op9_scaled_sketch": op9_scaled_sketch}
SQL: dict[str, str] = {}
