"""Incremental ingest of page files as a stream that ends when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmine.operators.html import extract_pages, long_enough
from quillmine.operators.indexing import ChunkIndex

PAGES_SCHEMA = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, schema: str = PAGES_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(stream: DataFrame, index: ChunkIndex, checkpoint: str) -> int:
    """Index all page files that this checkpoint hasn't seen; returns the number of batches. A batch that is run again finds its pages unchanged."""
    done = []

    def step(batch: DataFrame, number: int) -> None:
        kept, _ = long_enough(extract_pages(batch.dropDuplicates(["url"])))
        index.update_pages(kept)
        done.append(number)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
