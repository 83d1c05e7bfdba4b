"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.sources.shipping import ship
from quillmine.sources.tables import shared_folder

#: Words are runs of anything but ASCII white space.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of documents go to Python in slices of about this many text bytes.
SLICE_BYTES = 4 << 20
#: Rows that cross between the JVM and Python at once, unless the session sets its own number; the default of 10,000 whole texts takes memory on both sides.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a local session may leave it unset."""
    return shared_folder(spark)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose batches for Python are small; a number that the session was given stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, BATCH_ROWS)
    return df


def persist(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillmine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(text: pa.Array) -> pa.Array:
    """Strings whose nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    return text.fill_null("") if text.null_count else text


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that no slice of several rows has more than `most` bytes of text."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def id_text(column: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(column.cast("string"), F.lit("\u0000"))
