"""Ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, group: list[str], order: list[Column], spread: Column, buckets: int, name: str = "rank") -> DataFrame:
    """df with the 0-based rank of each row in its group, rows ordered by (bucket of `spread`, order).

    A group is split over `buckets` buckets: ranks within a bucket come from a window over (group, bucket),
    and the counts of a group's earlier buckets, at most `buckets` rows a group, are added by a join.
    """
    cut = df.withColumn("__bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"))
    inner = cut.withColumn("__in", F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(*order)) - 1)
    match = F.col("__bucket") == F.col("__b")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return inner.join(bases, match).withColumn(name, F.col("__in") + F.col("__base")).drop("__bucket", "__b", "__in", "__base", *(f"__{g}" for g in group))
