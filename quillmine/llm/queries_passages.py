"""Query of the removal of repeated byte strings. No SQL: DuckDB would need a row of 200 bytes for every byte of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import table
from quillmine.llm.passages import remove_passages


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_suffix_array_dedup": op13_suffix_array_dedup}
SQL: dict[str, str] = {}
