"""Query of the media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import table
from quillmine.llm.media import ROW, decode_media, encode_media


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decode_media(encode_media(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -ROW, ROW)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {"op2_lossless_webp": op2_lossless_webp}
SQL: dict[str, str] = {}
