"""Query of the executed compaction. No SQL, as it writes files; tests hold it against a brute-force version."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import persist, scratch_dir, table
from quillmine.llm.compaction import compact, file_report, free_names, write_grouped


def _place(hashed: Column, day_rows: Column, total: int) -> tuple[Column, Column]:
    """Lot and piece of a row."""
    lots = 1 + F.floor(day_rows / F.lit(1 + total // 150))
    return F.floor(hashed / 16) % lots, F.least(hashed % 4, F.floor(hashed / 4) % 4)


def op12_bin_packed_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    day, lot, piece = free_names(clicks.columns, ["day", "lot", "piece"])
    folder = f"{scratch_dir(spark)}/quillmine/clicks-{uuid.uuid4().hex}/data"
    dated = clicks.withColumn(day, F.unix_date(F.col("arrived_at").cast("date")).cast("long"))
    # A written table, so that Spark knows its size and broadcasts it or not.
    days = persist(dated.groupBy(F.col(day).alias("__day")).agg(F.count(F.lit(1)).alias("__rows")), "days")
    total = days.agg(F.sum("__rows")).first()[0] or 0
    hashed = F.coalesce(F.crc32(F.col("click_id").cast("string")), F.lit(0))
    a, b = _place(hashed, F.col("__rows"), total)
    placed = dated.join(days, F.col(day).eqNullSafe(F.col("__day"))).select(*(F.col(f"`{c}`") for c in clicks.columns), day, a.alias(lot), b.alias(piece))
    write_grouped(placed, folder, [day, lot, piece], [F.col("arrived_at"), F.col("click_id")])
    if not total:
        return spark.createDataFrame([], "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean")
    done = compact(spark, folder, day, [lot, piece], 1 + total // 600, 1 + total // 500)
    cents = F.coalesce(F.floor(100 * F.col("value") + 0.5), F.lit(0)).cast("long")
    found = file_report(spark, folder, done, day, [lot, piece], "click_id", cents)
    columns = ",".join(c for c in spark.read.parquet(folder).columns if c not in (day, lot, piece))
    return found.select(
        F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece"), "n_rows", F.col("least").alias("min_click_id"), F.col("most").alias("max_click_id"), F.col("amount").alias("cents"),
        "sources", "ids_sha256", F.lit(columns).alias("columns"), "path", "rewritten",
    )


QUERIES = {"op12_bin_packed_compaction": op12_bin_packed_compaction}
SQL: dict[str, str] = {}
