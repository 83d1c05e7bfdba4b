"""Query of the mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmine.llm.common import table
from quillmine.llm.mixing import places


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(table(spark, sf_dir, "documents").select("doc_id", "source"))


QUERIES = {"op4_pfair_mixing": op4_pfair_mixing}
SQL: dict[str, str] = {}
