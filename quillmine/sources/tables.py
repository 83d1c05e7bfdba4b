"""Tables in the shared folder, and versioned snapshots."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share. Only a session on one machine may leave it unset, and then has one of its own; a cluster that names none is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "/tmp/checkpoints"


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    source = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none of that name; whether there was none."""
    hadoop = spark._jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    try:
        target = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    except Py4JJavaError as failed:
        if "FileAlreadyExists" in str(failed.java_exception.getClass().getName()) or "already exists" in str(failed.java_exception):
            return False
        raise
    target.write(bytearray(text.encode()))
    target.close()
    return True


def numbered(df: DataFrame, order: list, first: int, name: str) -> DataFrame:
    """df, written, with `ordinal`: first, first + 1, ... in the given order. Rows are sorted by ranges and counted by part, so no task has all of them."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    laid = persist(laid, name).withColumn("__part", F.shiftright("__id", 33))
    sizes = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a part
    starts = sizes.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    joined = laid.join(persist(starts, f"{name}-parts"), F.col("__part") == F.col("__p"))
    return joined.withColumn("ordinal", F.lit(first) + F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__p", "__start")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quillmine/{spark.sparkContext.applicationId}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that later steps don't depend on lost tasks."""
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Remove the tables that `persist` has written in this application; results that weren't read or written yet are lost."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Snapshots:
    """Versions of a table under a path; a version counts once it is written whole, and readers use the last one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and files.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v-{found[-1]:09d}") if found else None

    def write(self, df: DataFrame) -> int:
        found = self.versions()
        version = found[-1] + 1 if found else 1
        df.write.mode("overwrite").parquet(f"{self.path}/v-{version:09d}")
        return version
