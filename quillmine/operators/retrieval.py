"""Batch retrieval: ranked evidence for any number of questions at once.

questions: qid, text. corpus: ordinal (its order), text, document, page, and optionally source_type, source_url,
section, department, crawled_at, vector. Result, a row an item: qid, rank, document, page, text, score and the metadata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.functions import fixed
from quillmine.functions.config import Settings
from quillmine.functions.text import is_aggregate_query, search_form, search_text, strip, tokens
from quillmine.operators import fusion, lexical, patterns, vectors
from quillmine.sources.tables import persist

METADATA = ["source_type", "source_url", "section", "department", "crawled_at"]
_RESULT = ["qid", "rank", "document", "page", "text", "score", *METADATA]
_CODE = r"(?<![A-Z0-9])[A-Z]{2,4}\d{4}[A-Z]?(?![A-Z0-9])"
#: A backend gives (qid, vno, ordinal, distance) of the k nearest corpus rows of each variant (qid, vno, text, k).
Backend = Callable[[DataFrame, DataFrame], DataFrame]


def query_variants(form: Column, text: Column) -> Column:
    """The question and all members of each synonym group that it names, once each, in order."""
    parts = [F.array(text)]
    for group in fixed.SYNONYM_GROUPS:
        named = F.lit(False)
        for member in group:
            named = named | form.rlike(f"(?<![a-z0-9])\\Q{search_form(member)}\\E(?![a-z0-9])")
        parts.append(F.when(named, F.array(*map(F.lit, group))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def prepare(questions: DataFrame, settings: Settings, any_script: bool = True) -> DataFrame:
    """qid, text, form, aggregate, fetch_k, top_k."""
    form = search_text(F.col("text"), any_script)
    out = questions.select("qid", "text").withColumn("form", form)
    out = out.withColumn("aggregate", is_aggregate_query(F.col("text"), any_script))
    pick = lambda a, b: F.when(F.col("aggregate"), F.lit(a)).otherwise(F.lit(b))
    return out.withColumns({"fetch_k": pick(settings.aggregate_fetch_k, settings.fetch_k), "top_k": pick(settings.aggregate_top_k, settings.top_k)})


def variants(prepared: DataFrame) -> DataFrame:
    exploded = prepared.select("qid", "fetch_k", F.posexplode(query_variants(F.col("form"), F.col("text"))).alias("vno", "text"))
    return exploded.select("qid", "vno", "text", F.col("fetch_k").alias("k"))


def catalogue_hits(prepared: DataFrame, catalogue: DataFrame, top_k: int) -> DataFrame:
    """Exact course-code hits. catalogue: ordinal, course_code, source_document, page, excerpt. Rows that hold only codes, or don't end in a number, don't count."""
    codes = F.array_distinct(F.regexp_extract_all(F.upper("form"), F.lit(_CODE), 0))
    asked = prepared.select("qid", F.explode(codes).alias("course_code"))
    rows = catalogue.select("ordinal", "course_code", "source_document", F.col("page").cast("int").alias("page"), strip(F.coalesce("excerpt", F.lit(""))).alias("excerpt"))
    letters = F.length(F.regexp_replace("excerpt", "[^A-Za-z一-鿿]", ""))
    rows = rows.where((letters > F.length("course_code")) & F.col("excerpt").rlike(r"(?U)\s\d+(?:\.\d+)?$"))
    hits = rows.join(asked, "course_code")
    first = Window.partitionBy("qid", "course_code", "source_document", "excerpt").orderBy("ordinal")
    hits = hits.withColumn("n", F.row_number().over(first)).where("n = 1")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("ordinal"))).where(F.col("rank") <= top_k)
    none = F.lit(None).cast("string")
    return hits.select(
        "qid", "rank", F.col("source_document").alias("document"), "page", F.col("excerpt").alias("text"), F.lit(1.0).alias("score"),
        F.lit("course_catalog").alias("source_type"), *(none.alias(c) for c in METADATA[1:]),
    )


def target_documents(prepared: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, document: programme documents that a question names, only those with its longest programme name. All names are looked for in one pass over the questions."""
    names = corpus.select("document").distinct().where(F.lower("document").endswith(".pdf") & F.contains("document", F.lit(fixed.SCOPE_MARK)))
    names = names.select(F.col("document").alias("name"), search_text(strip(F.substring_index("document", fixed.SCOPE_MARK, 1))).alias("pattern")).where("pattern <> ''")
    named = patterns.longest_named(prepared.select("qid", F.col("form").alias("text")), names, ["qid"])
    return named.withColumnRenamed("name", "document")


def keyword_backend(any_script: bool = True, documents: DataFrame | None = None, most_k: int | None = None) -> Backend:
    """A model-free stand-in: the distance is one less the keyword overlap; rows without overlap are left out. Tokenized documents, and the largest k that is asked for, may be given."""

    def search(asked: DataFrame, corpus: DataFrame) -> DataFrame:
        found = lexical.tokenized(corpus, any_script) if documents is None else documents
        most = most_k or asked.agg(F.max("k")).first()[0] or 1
        scored = lexical.keyword_scores(found, asked, ["qid", "vno"], most, any_script)
        ranked = lexical.top(scored.join(asked.select("qid", "vno", "k"), ["qid", "vno"]), ["qid", "vno"], "k")
        return ranked.select("qid", "vno", "ordinal", (1 - F.col("score")).alias("distance"))

    return search


def vector_backend(encode: Callable[[Column], Column], metric: str = "cosine", most_k: int = 20) -> Backend:
    """Exact search in the corpus' column `vector`; encode turns texts into vectors (a pandas UDF around a model)."""

    def search(asked: DataFrame, corpus: DataFrame) -> DataFrame:
        queries = asked.select(F.struct("qid", "vno").alias("key"), "k", encode(F.col("text")).alias("vector"))
        keyed = queries.withColumn("query", F.to_json("key"))
        found = vectors.nearest(corpus, keyed, most_k, metric, "query")
        return found.join(keyed.select("query", "key", "k"), "query").where("rank <= k").select("key.qid", "key.vno", "ordinal", "distance")

    return search


def _with_metadata(corpus: DataFrame) -> DataFrame:
    have = set(corpus.columns)
    out = corpus
    for c in METADATA:
        out = out.withColumn(c, F.col(c).cast("string") if c in have else F.lit(None).cast("string"))
    return out.withColumn("source_type", F.coalesce("source_type", F.lit("pdf")))


def _payload() -> Column:
    return F.struct(*METADATA).alias("payload")


def _shown_page() -> Column:
    return F.when(F.col("source_type") == "web", F.lit(None).cast("int")).otherwise(F.greatest(F.lit(1), F.coalesce(F.col("page").cast("int"), F.lit(1))))


def vector_ranking(asked: DataFrame, corpus: DataFrame, backend: Backend, metric: str) -> DataFrame:
    """qid, document, page, text, score, rank, payload: the best relevance of each chunk over the variants, first come first at ties."""
    found = backend(asked, corpus).withColumn("score", vectors.relevance(F.col("distance"), metric))
    arrival = Window.partitionBy("qid", "vno").orderBy(F.round("distance", lexical.DIGITS), "ordinal")
    found = found.withColumn("place", F.row_number().over(arrival)).join(corpus, "ordinal")
    identity = F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.col("document"))
    merged = found.groupBy("qid", identity.alias("identity"), F.coalesce(F.col("page").cast("int"), F.lit(1)).alias("page"), "text").agg(
        F.max("score").alias("score"),
        F.min(F.struct("vno", "place")).alias("arrival"),
        F.max_by(F.struct("document", "source_type", "source_url", "section", "department", "crawled_at"), F.struct("score", -F.col("vno"), -F.col("place"))).alias("of"),
    )
    out = merged.select("qid", F.coalesce("of.document", F.lit(fixed.UNKNOWN_DOCUMENT)).alias("document"), "page", "text", "score", "arrival", *(F.col(f"of.{c}").alias(c) for c in METADATA))
    order = Window.partitionBy("qid").orderBy(F.round("score", lexical.DIGITS).desc(), "arrival")
    return out.withColumn("page", _shown_page()).withColumn("rank", F.row_number().over(order)).select("qid", "document", "page", "text", "score", "rank", _payload())


def lexical_ranking(prepared: DataFrame, asked: DataFrame, corpus: DataFrame, index: lexical.LexicalIndex, settings: Settings, any_script: bool = True) -> DataFrame:
    """The BM25 order of the first fetch_k chunks, with those below the keyword threshold left out and ranks closed up."""
    asked_tokens = asked.select("qid", F.explode(tokens(F.col("text"), any_script)).alias("token"))
    most = max(settings.fetch_k, settings.aggregate_fetch_k)
    first = lexical.top(lexical.bm25(index, asked_tokens, most).join(prepared.select("qid", "fetch_k"), "qid"), ["qid"], "fetch_k")
    first = persist(first.select("qid", "ordinal", F.col("rank").alias("place")), "lexical")
    overlap = lexical.pair_scores(first, index.documents, asked, ["qid", "vno"], any_script).groupBy("qid", "ordinal").agg(F.max("score").alias("overlap"))
    kept = first.join(overlap, ["qid", "ordinal"]).where(F.col("overlap") >= settings.similarity_threshold)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    rows = kept.join(corpus, "ordinal").withColumn("page", _shown_page()).withColumn("document", F.coalesce("document", F.lit(fixed.UNKNOWN_DOCUMENT)))
    return rows.select("qid", "document", "page", "text", F.col("overlap").alias("score"), "rank", _payload())


def retrieve(
    questions: DataFrame,
    corpus: DataFrame,
    settings: Settings = Settings(),
    backend: Backend | None = None,
    catalogue: DataFrame | None = None,
    reranker: Callable[[Column, Column], Column] | None = None,
    any_script: bool = True,
    index: lexical.LexicalIndex | None = None,
) -> DataFrame:
    """Catalogue hits end a question's search; otherwise vector and lexical lists are fused, cut to eligible and targeted items, reranked if wanted, and de-duplicated (or spread over documents for questions that ask for a list).

    index: of the corpus, where there is one already (`ChunkIndex.lexical_index`).
    """
    prepared = prepare(questions, settings, any_script)
    corpus = _with_metadata(corpus)
    hits = None
    if catalogue is not None:
        hits = catalogue_hits(prepared, catalogue, settings.top_k)
        prepared = prepared.join(hits.select("qid").distinct(), "qid", "left_anti")
    prepared, asked = persist(prepared, "questions"), persist(variants(prepared), "variants")
    if index is None and (settings.hybrid_search or backend is None):
        index = lexical.build_index(corpus, any_script)
    search = backend or keyword_backend(any_script, index.documents, max(settings.fetch_k, settings.aggregate_fetch_k))
    by_vector = vector_ranking(asked, corpus, search, settings.distance_metric).join(prepared.select("qid", "fetch_k"), "qid")
    fetched = by_vector.where(F.col("rank") <= F.col("fetch_k")).withColumn("strong", F.col("score") >= settings.similarity_threshold)
    lists = fetched.select("qid", F.lit(1).alias("list"), "rank", *fusion.KEY, "payload", "strong")
    if settings.hybrid_search:
        by_words = lexical_ranking(prepared, asked, corpus, index, settings, any_script)
        lists = lists.unionByName(by_words.select("qid", F.lit(2).alias("list"), "rank", *fusion.KEY, "payload", F.lit(True).alias("strong")))
    strong = F.max("strong").over(Window.partitionBy("qid", *fusion.KEY))
    lists = lists.withColumn("payload", F.struct(F.col("payload").alias("meta"), strong.alias("strong")))
    fused = fusion.reciprocal_rank_fusion(lists, settings.rrf_k).where("payload.strong")
    targets = target_documents(prepared, corpus)
    fused = fused.join(targets.withColumn("wanted", F.lit(True)), ["qid", "document"], "left")
    fused = fused.join(targets.select("qid").distinct().withColumn("targeted", F.lit(True)), "qid", "left").where("targeted is null or wanted").drop("wanted", "targeted")
    fused = fused.join(prepared.select("qid", "aggregate", "top_k", F.col("text").alias("question")), "qid")
    if settings.reranker_enabled:
        if reranker is None:
            raise ValueError("a reranker is needed")
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", lexical.DIGITS).desc(), "ordinal"))
        fused = fused.withColumn("ordinal", place).where(F.col("ordinal") <= settings.reranker_candidates).withColumn("score", reranker(F.col("question"), F.col("text")))
    spread = fusion.diversify(fused.where("aggregate"), "top_k", settings.aggregate_max_chunks_per_document, F.coalesce(F.nullif(F.col("payload.meta.source_url"), F.lit("")), F.col("document")))
    plain = fusion.deduplicate(fused.where("not aggregate"), "top_k")
    found = plain.unionByName(spread).select("qid", "rank", "document", "page", "text", "score", *(F.col(f"payload.meta.{c}").alias(c) for c in METADATA))
    return found if hits is None else found.unionByName(hits.select(*_RESULT))
