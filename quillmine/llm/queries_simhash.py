"""Query of the SimHash near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmine.llm.common import table
from quillmine.llm.simhash import near_duplicates


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
