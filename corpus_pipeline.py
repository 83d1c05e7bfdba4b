"""From raw documents to packed sequences: each stage calls one operator of quillmine.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import mixing, nearcopies, packing, substring, toxicity
from quillmine.llm.common import DOCUMENT_COLUMNS, persist, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, keep=DOCUMENT_COLUMNS).where("predicted = 0").select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash over five-word shingles, links held to a similarity of 0.8) the row with the smallest doc_id; a null id comes last."""
    return nearcopies.keep_first(docs.select(*DOCUMENT_COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier document, or an earlier place of the same one, has; others keep their text as it is."""
    rows = substring.remove_repeats(docs.select(*DOCUMENT_COLUMNS))
    cut = F.col("n_removed") > 0
    return rows.select("doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def order_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mix's order: none leaves, what a hot source has above the target share comes last."""
    return mixing.ordered_documents(docs.select(*DOCUMENT_COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 tokens, numbered in the mix's order: runs of 50,000 documents of that order are packed one after the other."""
    packed = packing.pack_documents_in_order(docs)
    return packed.selectExpr("doc_id", "piece", "start", "cast(length as long) as length", "ids_crc32", "sequence_id", "cast(offset as long) as offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", drop_repeated_passages),
    ("mixing", order_sources),
    ("packing", pack_sequences),
]
#: Learnt weights, bit counts and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep; each stage's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
