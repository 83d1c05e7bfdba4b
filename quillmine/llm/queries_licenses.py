"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import table
from quillmine.llm.licenses import scan


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.licence))), ",").alias("licences"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m.start, m.end)), ",").alias("spans"),
    )


QUERIES = {"op10_license_scan": op10_license_scan}
SQL: dict[str, str] = {}
