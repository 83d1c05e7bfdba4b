"""What the queries on the driver's tables share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus: the source is the document, the id the page and the order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ordinal"), "text", F.col("source").alias("document"), (F.col("doc_id") + 1).cast("int").alias("page"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def literal(value) -> str:
    """A value as SQL."""
    if value is None:
        return "null"
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(literal, value))}]"
    return str(value).lower() if isinstance(value, (bool, int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """The rows as a table for a from clause; columns: name, name, ..."""
    return f"(values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as t({columns})"


def _grouped(rows: list[tuple], columns: list[str], key: str, every: list | None = None) -> tuple[list[tuple], int]:
    """Cases with the number of their key's group, without the key. every: all keys in order, where not every one has a case."""
    at = columns.index(key)
    groups = {k: i for i, k in enumerate(every or dict.fromkeys(r[at] for r in rows))}
    return [(groups[r[at]], *r[:at], *r[at + 1 :]) for r in rows], len(groups)


def dealt_cases(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str, key: str, every: list | None = None) -> DataFrame:
    """Cases of all kinds dealt over the documents: each has the rows of one key's cases, by its id, and its id as their key."""
    kinds = [c.strip().split(" ", 1) for c in schema.split(", ")]
    cases, groups = _grouped(rows, [c for c, _ in kinds], key, every)
    held = spark.createDataFrame(cases, ", ".join(["__group long", *(f"{c} {k}" for c, k in kinds if c != key)]))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast(dict(kinds)[key]).alias(key), F.pmod("doc_id", F.lit(groups)).alias("__of"))
    # The cases are a fixed list of a few rows.
    return docs.join(F.broadcast(held), F.col("__of") == F.col("__group")).select(*(c for c, _ in kinds))


def dealt_values(rows: list[tuple], columns: str, key: str, every: list | None = None) -> str:
    """The same in SQL, as a table for a from clause."""
    names = columns.split(", ")
    cases, groups = _grouped(rows, names, key, every)
    own = f"doc_id::{'varchar' if isinstance(rows[0][names.index(key)], str) else 'bigint'} as {key}"
    shown = ", ".join(own if n == key else f"t.{n}" for n in names)
    return f"(select {shown} from documents join {values(cases, ', '.join(['grp', *(n for n in names if n != key)]))} on doc_id % {groups} = grp) as dealt"
