"""Query of the packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmine.llm.common import table
from quillmine.llm.packing import pack_documents


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.selectExpr("doc_id", "piece", "start", "cast(length as long) as length", "ids_crc32", "sequence_id", "cast(offset as long) as offset")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
SQL: dict[str, str] = {}
