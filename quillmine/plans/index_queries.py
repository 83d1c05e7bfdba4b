"""Indexes that are built once and then read or changed: vectors by cell, postings in blocks, chunks behind commits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmine.functions.config import Settings
from quillmine.operators import lexical, vectors
from quillmine.operators.indexing import ChunkIndex
from quillmine.operators.postings import PostingsIndex
from quillmine.operators.vector_index import VectorIndex, recall
from quillmine.plans import retrieval_queries
from quillmine.plans.common import corpus, questions, table
from quillmine.sources.tables import shared_folder

K = 10


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/quillmine/{name}-{uuid.uuid4().hex}"


def _vector_index(spark, sf_dir):
    """The index of all vectors, and the queries: those whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    return VectorIndex.build(rows, _folder(spark, "vectors")), rows, rows.where("ordinal % 50 = 0").withColumnRenamed("ordinal", "qid")


def _shown(found):
    return found.select("qid", "ordinal", F.col("rank").cast("long").alias("rank"), F.round(vectors.relevance(F.col("distance"), "cosine"), 5).alias("relevance"))


def vector_index_topk(spark, sf_dir):
    """About the nearest vectors, from the cells around each query."""
    index, _, asked = _vector_index(spark, sf_dir)
    return _shown(index.search(asked, K))


def vector_index_exact(spark, sf_dir):
    """The same index with every cell read."""
    index, _, asked = _vector_index(spark, sf_dir)
    return _shown(index.search(asked, K, exact=True))


def vector_index_recall(spark, sf_dir):
    """The share of true neighbours that the index finds."""
    index, rows, asked = _vector_index(spark, sf_dir)
    return recall(index.search(asked, K), vectors.nearest(rows, asked, K))


def _postings(spark, sf_dir):
    index = PostingsIndex.build(corpus(spark, sf_dir), _folder(spark, "postings"), any_script=False)
    return index.top_documents(lexical.asked_tokens(questions(spark, sf_dir), ["qid"], any_script=False), K)


def postings_topk(spark, sf_dir):
    """bm25_topk from postings on disk, without the blocks that can't matter."""
    found, _ = _postings(spark, sf_dir)
    return found.select("qid", "ordinal", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def postings_blocks(spark, sf_dir):
    """For each question the blocks that its tokens have, and those that were read for it."""
    _, report = _postings(spark, sf_dir)
    return report


def _changed_index(spark, sf_dir):
    """Two commits: all documents but the French, the German ones with another text; then all but the Spanish, as they are. A document is one chunk."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("text", F.col("source").alias("document"), F.col("doc_id").cast("string").alias("source_path"), "lang")
    rest = [F.lit(1).alias("page"), F.lit("").alias("modified_at")]
    before = docs.where("lang <> 'fr'").withColumn("text", F.when(F.col("lang") == "de", F.concat(F.lit("zz "), F.col("text"))).otherwise(F.col("text")))
    after = docs.where("lang <> 'es'")
    index = ChunkIndex(spark, _folder(spark, "chunks"), Settings(chunk_size=1 << 30), any_script=False)
    for state in (before, after):
        index.update_documents(lexical.spread(state.select("text", "document", "source_path", *rest, F.sha2("text", 256).alias("sha256"))), prune_deleted=True)
    return index


def index_statistics(spark, sf_dir):
    """idf after inserts, changes and deletes, from signed counts."""
    return _changed_index(spark, sf_dir).lexical_index().frequencies.select("token", F.round("idf", 6).alias("idf"))


def index_order(spark, sf_dir):
    """The order of insertion after the two commits."""
    return _changed_index(spark, sf_dir).corpus().select(F.col("key").cast("long").alias("doc_id"), "ordinal")


QUERIES = {f.__name__: f for f in (vector_index_topk, vector_index_exact, vector_index_recall, postings_topk, postings_blocks, index_statistics, index_order)}

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"
SQL = {
    "vector_index_exact": retrieval_queries.SQL["vector_topk_cosine"],
    "postings_topk": retrieval_queries.SQL["bm25_topk"],
    "index_statistics": f"""
with d as (select doc_id, {_TOKENS} as t from documents where lang <> 'es' and regexp_matches(text, '\\S')),
n as (select count(*) as n from d)
select token, round(ln(1 + ((select n from n) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from (select distinct doc_id, unnest(t) as token from d) group by token""",
    "index_order": """
with d as (select doc_id, lang from documents where regexp_matches(text, '\\S')),
first as (select doc_id, lang, row_number() over (order by doc_id::varchar) - 1 as ordinal from d where lang <> 'fr'),
later as (select doc_id, (select count(*) from first) + row_number() over (order by doc_id::varchar) - 1 as ordinal from d where lang in ('fr', 'de'))
select doc_id, ordinal from first where lang not in ('es', 'de') union all select doc_id, ordinal from later""",
}
