"""Incremental maintenance of the chunk table: what changed, new chunks in place of old ones, and a manifest of what is indexed.

Chunks: ordinal (their order of insertion), chunk_id, kind ("pdf" or "web"), key (path or address), document, page, chunk_index, text, tokens and more.
Manifest: kind, key, hash, document, configuration, n_chunks.
Statistics: token, df, as signed counts that each commit adds to.
All three change in one commit (quillmine.sources.commits): only buckets with a changed file are written anew, tokens are made when a chunk is stored,
and what a commit takes away or brings is added to the counts, so an update looks at no chunk that stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.functions.config import Settings
from quillmine.functions.errors import IndexUnavailable
from quillmine.operators.chunking import split_pages
from quillmine.operators.html import split_web_pages
from quillmine.functions.text import tokens
from quillmine.operators.lexical import LexicalIndex
from quillmine.sources.commits import BUCKETS, Change, CommitLog, Version
from quillmine.sources.tables import numbered, persist

MANIFEST_SCHEMA = "kind string, key string, hash string, document string, configuration string, n_chunks long"


class NotReady(IndexUnavailable):
    """Nothing is indexed yet."""


def chunk_id(file_hash: Column, page: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", file_hash, page.cast("string"), index.cast("string"), text), 256)


def web_chunk_id(url: Column, content_hash: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit("web"), url, content_hash, index.cast("string")), 256)


def changes(current: DataFrame, manifest: DataFrame, kind: str, configuration: str | None = None) -> DataFrame:
    """current (key, hash, ...) with status new, changed or unchanged. With a configuration, one that differs changes everything."""
    old = manifest.where(F.col("kind") == kind).select("key", F.col("hash").alias("old_hash"), F.col("configuration").alias("old_configuration"))
    same = F.col("hash") == F.col("old_hash")
    if configuration is not None:
        same = same & F.col("old_configuration").eqNullSafe(F.lit(configuration))
    joined = current.join(old, "key", "left")
    return joined.withColumn("status", F.when(F.col("old_hash").isNull(), "new").when(same, "unchanged").otherwise("changed")).drop("old_hash", "old_configuration")


def replace_chunks(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old chunks without those of the keys that new ones come for, and the new ones."""
    if old is None:
        return new
    keys = new.select("kind", "key").distinct()
    return old.join(keys, ["kind", "key"], "left_anti").unionByName(new, allowMissingColumns=True)


def pdf_chunks(pages: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of pages (text, document, source_path, page, modified_at, sha256)."""
    cut = split_pages(pages, settings.chunk_size, settings.chunk_overlap)
    ident = chunk_id(F.col("sha256"), F.col("page"), F.col("chunk_index"), F.col("text"))
    return cut.select(ident.alias("chunk_id"), F.lit("pdf").alias("kind"), F.col("source_path").alias("key"), "document", "page", "chunk_index", "text", F.col("sha256").alias("hash"), F.coalesce("modified_at", F.lit("")).alias("modified_at"))


def web_chunks(extracted: DataFrame, settings: Settings) -> DataFrame:
    cut = split_web_pages(extracted, settings.chunk_size, settings.chunk_overlap)
    ident = web_chunk_id(F.col("source_url"), F.col("content_hash"), F.col("chunk_index"))
    return cut.select(
        ident.alias("chunk_id"), F.lit("web").alias("kind"), F.col("source_url").alias("key"), "document", "page", "chunk_index", "text", F.col("content_hash").alias("hash"), "modified_at",
        "source_type", "source_url", "section", "department",
    )


@dataclass(frozen=True)
class IndexReport:
    indexed: int
    skipped: int
    failed: int
    chunks_added: int


def token_counts(chunks: DataFrame, sign: int) -> DataFrame:
    """token and df: in how many of the chunks (tokens) it is, times the sign."""
    return chunks.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg((sign * F.count(F.lit(1))).alias("df"))


def merged_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")


class _Table:
    """A table of the log, at its last version."""

    def __init__(self, log: CommitLog, name: str):
        self.log, self.name = log, name

    def read(self) -> DataFrame | None:
        return self.log.read(self.name)


class ChunkIndex:
    """The chunk table, its manifest and its token statistics under a path, as one commit log.

    With an encoder new chunks are stored with their vectors, which `retrieval.vector_backend` searches; unchanged ones keep theirs.
    Chunks that were stored without one have no vector until their file or page changes, so give the encoder from the start.
    Of two updates at a time one makes its version and the other starts again from that.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), encode: Callable[[Column], Column] | None = None, buckets: int = BUCKETS, any_script: bool = True):
        self.spark, self.settings, self.encode, self.any_script = spark, settings, encode, any_script
        self.log = CommitLog(spark, path, {"chunks": ["kind", "key"], "manifest": ["kind", "key"]}, buckets)
        self.chunks, self.manifest = _Table(self.log, "chunks"), _Table(self.log, "manifest")

    @property
    def configuration(self) -> str:
        return json.dumps(self.settings.index_configuration(), sort_keys=True)

    def read_manifest(self, version: Version | None = None) -> DataFrame:
        found = self.log.read("manifest", version)
        return self.spark.createDataFrame([], MANIFEST_SCHEMA) if found is None else found

    def _update(self, kind: str, current: DataFrame, make, configuration: str | None, prune_deleted: bool) -> IndexReport:
        report: list[IndexReport] = []

        def attempt(base: Version) -> Version:
            found, version = self._commit(kind, current, make, configuration, prune_deleted, base)
            report[:] = [found]
            return version

        self.log.retried(attempt)
        return report[0]

    def _commit(self, kind: str, current: DataFrame, make, configuration: str | None, prune_deleted: bool, base: Version) -> tuple[IndexReport, Version]:
        manifest = self.read_manifest(base)
        status = persist(changes(current.dropDuplicates(["key"]), manifest, kind, configuration), "changes")
        made_now = make(status.where("status <> 'unchanged'").select("key")).withColumn("tokens", tokens(F.col("text"), self.any_script))
        made_now = made_now if self.encode is None else made_now.withColumn("vector", self.encode(F.col("text")))
        first = base.values.get("next_ordinal", 0)
        new = numbered(made_now, [F.col("key"), F.col("page"), F.col("chunk_index")], first, "chunks")
        made = new.groupBy("kind", "key", "hash", "document").agg(F.count(F.lit(1)).alias("n_chunks")).withColumn("configuration", F.lit(self.configuration))
        made = persist(made.select("kind", "key", "hash", "document", "configuration", "n_chunks"), "made")
        unchanged, changed = status.agg(F.count_if(F.col("status") == "unchanged"), F.count_if(F.col("status") != "unchanged")).first()
        indexed, added = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
        report = IndexReport(indexed, unchanged, changed - indexed, added)
        leaving = made.select("kind", "key")
        if prune_deleted:
            leaving = leaving.unionByName(manifest.where(F.col("kind") == kind).join(current.select("key"), "key", "left_anti").select("kind", "key"))
        leaving = persist(leaving, "leaving")
        if leaving.isEmpty():
            return report, base
        old = self.log.read("chunks", base, self.log.touched("chunks", Change(leaving)))
        signed, count, length = token_counts(new, 1), added, new.agg(F.sum(F.size("tokens"))).first()[0] or 0
        if old is not None:
            gone = persist(old.select("kind", "key", "tokens").join(leaving, ["kind", "key"], "left_semi"), "gone")
            minus, shorter = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
            signed, count, length = signed.unionByName(token_counts(gone, -1)), count - minus, length - shorter
        values = {"next_ordinal": first + added, "count": base.values.get("count", 0) + count, "length": base.values.get("length", 0) + length}
        swap = {"chunks": Change(leaving, new), "manifest": Change(leaving, made)}
        return report, self.log.commit(swap, values, base, {"statistics": (merged_counts(signed), merged_counts)})

    def update_documents(self, pages: DataFrame, prune_deleted: bool = False) -> IndexReport:
        """Index pages (text, document, source_path, page, modified_at, sha256) whose file or configuration changed. A document without a chunk fails and keeps what it had."""
        current = pages.select(F.col("source_path").alias("key"), F.col("sha256").alias("hash"))
        make = lambda todo: pdf_chunks(pages.join(todo, pages.source_path == todo.key, "left_semi"), self.settings)
        return self._update("pdf", current, make, self.configuration, prune_deleted)

    def update_pages(self, extracted: DataFrame, prune_deleted: bool = False) -> IndexReport:
        """Index extracted web pages whose content changed, whatever the configuration."""
        current = extracted.select(F.col("url").alias("key"), F.col("content_hash").alias("hash"))
        make = lambda todo: web_chunks(extracted.join(todo, extracted.url == todo.key, "left_semi"), self.settings)
        return self._update("web", current, make, None, prune_deleted)

    def _ready(self, version: Version) -> DataFrame:
        chunks = self.log.read("chunks", version)
        if chunks is None or self.read_manifest(version).where("kind = 'pdf'").isEmpty():
            raise NotReady("no document is indexed")
        return chunks

    def corpus(self, version: Version | None = None) -> DataFrame:
        """The chunks with their ordinals, those of a later commit after those of an earlier one; raises until a document is indexed."""
        return self._ready(version or self.log.version()).drop("tokens")

    def lexical_index(self, version: Version | None = None) -> LexicalIndex:
        """What `lexical.bm25` and `retrieval.retrieve` need of a version, from stored tokens and counts."""
        version = version or self.log.version()
        chunks, count = self._ready(version), version.values["count"]
        df = F.col("df")
        frequencies = merged_counts(self.log.read_pieces("statistics", version)).select("token", F.log(1 + (count - df + 0.5) / (df + 0.5)).alias("idf"))
        return LexicalIndex(chunks.select("ordinal", "tokens"), frequencies, count, version.values["length"] / count if count else 0.0)
