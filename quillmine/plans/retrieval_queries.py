"""Retrieval over documents, with the benchmark's items as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine.functions import fixed
from quillmine.functions.config import Settings
from quillmine.operators import answers, evaluation, fusion, lexical, patterns, vectors, versions
from quillmine.operators.retrieval import retrieve
from quillmine.plans.common import corpus, dealt_cases, dealt_values, literal as _text, questions, table

K = 10


def _rank():
    return F.col("rank").cast("long").alias("rank")


def _overlap(spark, sf_dir, k, documents=None):
    documents = lexical.tokenized(corpus(spark, sf_dir), any_script=False) if documents is None else documents
    return lexical.keyword_scores(documents, questions(spark, sf_dir), ["qid"], k, any_script=False)


def keyword_overlap_topk(spark, sf_dir):
    found = lexical.top(_overlap(spark, sf_dir, K), ["qid"], K)
    return found.select("qid", "ordinal", F.round("score", 6).alias("score"), _rank())


def bm25_stats(spark, sf_dir):
    index = lexical.build_index(corpus(spark, sf_dir), any_script=False)
    return index.frequencies.select("token", F.round("idf", 6).alias("idf"))


def _bm25(spark, sf_dir, k, index=None):
    index = index or lexical.build_index(corpus(spark, sf_dir), any_script=False)
    asked = questions(spark, sf_dir).select("qid", F.explode(lexical.tokens(F.col("text"), False)).alias("token"))
    return lexical.bm25(index, asked, k)


def bm25_topk(spark, sf_dir):
    return lexical.top(_bm25(spark, sf_dir, K), ["qid"], K).select("qid", "ordinal", F.round("score", 6).alias("score"), _rank())


def _vectors(metric):
    def query(spark, sf_dir):
        """Queries are the vectors whose id is divisible by 50."""
        rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").cast("array<double>").alias("vector"))
        found = vectors.nearest(rows, rows.where("ordinal % 50 = 0").withColumnRenamed("ordinal", "qid"), K, metric)
        return found.select("qid", "ordinal", _rank(), F.round(vectors.relevance(F.col("distance"), metric), 5).alias("relevance"))

    return query


def _evidence(spark, sf_dir):
    found = lexical.top(_overlap(spark, sf_dir, 50), ["qid"], 50)
    return found.drop("rank").join(corpus(spark, sf_dir), "ordinal").select("qid", "document", F.lit(None).cast("int").alias("page"), "text", "score", "ordinal")


def dedup_evidence(spark, sf_dir):
    return fusion.deduplicate(_evidence(spark, sf_dir), K).select("qid", _rank(), "document", F.round("score", 6).alias("score"), F.sha2("text", 256).alias("sha256"))


def diversify_rounds(spark, sf_dir):
    return fusion.diversify(_evidence(spark, sf_dir), K, 2).select("qid", _rank(), "document", F.round("score", 6).alias("score"), F.sha2("text", 256).alias("sha256"))


def rrf_fusion(spark, sf_dir):
    """The overlap list and the BM25 list of each question, fused."""
    rows = corpus(spark, sf_dir)
    index, lists = lexical.build_index(rows, any_script=False), None
    for number, scored in ((1, _overlap(spark, sf_dir, 20, index.documents)), (2, _bm25(spark, sf_dir, 20, index))):
        ranked = lexical.top(scored, ["qid"], 20).select("qid", F.lit(number).alias("list"), "rank", "ordinal")
        lists = ranked if lists is None else lists.unionByName(ranked)
    keyed = lists.join(rows, "ordinal").select("qid", "list", "rank", "document", "page", "text", F.lit(0).alias("payload"))
    return fusion.reciprocal_rank_fusion(keyed).select("qid", (F.col("page") - 1).cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


def hybrid_retrieval(spark, sf_dir):
    found = retrieve(questions(spark, sf_dir), corpus(spark, sf_dir), Settings(), any_script=False)
    return found.select("qid", _rank(), "document", "page", F.round("score", 6).alias("score"))


def citation_labels(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.select(F.col("ordinal").alias("doc_id"), answers.citation_label(F.col("document"), F.col("page"), F.lit(None).cast("string")).alias("label"), answers.citation_label(F.col("document"), F.lit(None).cast("int"), F.col("document")).alias("web_label"))


def prompt_context(spark, sf_dir):
    found = retrieve(questions(spark, sf_dir), corpus(spark, sf_dir), Settings(), any_script=False)
    return answers.prompts(questions(spark, sf_dir), found).select("qid", F.length("prompt").cast("long").alias("chars"), F.sha2("prompt", 256).alias("sha256"))


def _cases(spark, sf_dir):
    """Questions with the first document that has their passage whole, wherever it begins; the others should be refused."""
    passages = questions(spark, sf_dir).withColumnRenamed("text", "pattern")
    held = patterns.contained(corpus(spark, sf_dir).select("ordinal", "text"), passages, ["ordinal"])
    first = held.groupBy("pattern").agg(F.min("ordinal").alias("gold"))
    gold = passages.join(first, "pattern").groupBy("qid").agg(F.min("gold").alias("gold"))
    doc = F.concat(F.lit("d"), F.col("gold").cast("string"))
    out = questions(spark, sf_dir).join(gold, "qid", "left")
    return out.select("qid", F.col("text").alias("question"), F.when(F.col("gold").isNotNull(), doc).alias("relevant_document"), F.array((F.col("gold") + 1).cast("int")).alias("relevant_pages"), F.col("gold").isNull().alias("should_refuse"))


def eval_metrics(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("document", F.concat(F.lit("d"), F.col("ordinal").cast("string")))
    found = retrieve(questions(spark, sf_dir), rows, Settings(), any_script=False)
    out = evaluation.metrics(_cases(spark, sf_dir), found)
    return out.select(*(F.round(c, 6).alias(c) for c in ("recall_at_5", "mrr_at_10", "page_hit_rate", "refusal_accuracy")))


#: Evidence of two versions of one programme, one of another, and a page without a version.
_VERSIONS = [(1, 1, "金融学_适用于2022至23年度入学学生.pdf"), (1, 2, "金融学_适用于2023至24年度及以后入学学生.pdf"), (1, 3, "手册.pdf"), (2, 1, "手册.pdf"), (2, 2, "统计学_适用于2023至24年度入学学生.pdf"), (3, 1, "金融学_适用于2022至23年度入学学生.pdf")]
_ASKED = [(1, "How many credits does finance need"), (2, "统计学要多少学分"), (3, "2023级金融学要多少学分")]


def _version_tables(spark, sf_dir):
    """The cases dealt over the documents."""
    asked = dealt_cases(spark, sf_dir, _ASKED, "qid long, text string", "qid")
    return asked, dealt_cases(spark, sf_dir, _VERSIONS, "qid long, rank int, document string", "qid")


def version_scope(spark, sf_dir):
    asked, evidence = _version_tables(spark, sf_dir)
    _, scopes = versions.answer_scope(asked, evidence)
    return scopes.select("qid", "document", F.array_join("options", "|").alias("options"))


def version_clarification(spark, sf_dir):
    asked, evidence = _version_tables(spark, sf_dir)
    return versions.clarifications(asked, evidence).select("qid", "programme", F.array_join("options", "|").alias("options"))


QUERIES = {f.__name__: f for f in (keyword_overlap_topk, bm25_stats, bm25_topk, dedup_evidence, diversify_rounds, rrf_fusion, hybrid_retrieval, citation_labels, prompt_context, eval_metrics, version_scope, version_clarification)}
QUERIES |= {f"vector_topk_{m}": _vectors(m) for m in ("cosine", "l2", "ip")}

_BASE = """
t as (select doc_id, token, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as token from documents) group by all),
q as (select item_id as qid, token, count(*) as qf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as token from benchmark) group by all),
overlap as (
  select qid, doc_id, sum(least(tf, qf)) / any_value(total) as score from t join q using (token) join (select qid, sum(qf) as total from q group by qid) using (qid) group by qid, doc_id
),
n as (select count(*) as n from documents),
lengths as (select doc_id, sum(tf) as len from t group by doc_id),
mean as (select sum(len) / (select n from n) as avg_len from lengths),
idf as (select token, ln(1 + ((select n from n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from t group by token),
bm25 as (
  select qid, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as score
  from t join q using (token) join idf using (token) join lengths using (doc_id), mean group by qid, doc_id
),
overlap_ranked as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from overlap),
bm25_ranked as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from bm25 where score > 0)"""
_DEDUP = """
e as (select r.qid, d.source as document, d.text, r.score, r.doc_id, regexp_replace(lower(d.text), '\\s+', ' ', 'g') as form from overlap_ranked r join documents d using (doc_id) where rank <= 50),
u as (
  select *, min(doc_id) over (partition by qid, document, form) as place, row_number() over (partition by qid, document, form order by round(score, 9) desc, doc_id) as k from e
)"""
#: Ranks as the fused retrieval has them: the lexical list keeps what is over the threshold and closes up.
_HYBRID = """
merged as (
  select o.qid, d.source as document, d.doc_id + 1 as page, d.text, o.score, o.rank from overlap_ranked o join documents d using (doc_id) where rank <= 20
),
words as (
  select b.qid, d.source as document, d.doc_id + 1 as page, d.text, row_number() over (partition by b.qid order by b.rank) as rank
  from bm25_ranked b join overlap o using (qid, doc_id) join documents d using (doc_id) where b.rank <= 20 and o.score >= 0.4
),
lists as (
  select qid, 1 as list, rank, document, page, text, score >= 0.4 as strong from merged union all select qid, 2, rank, document, page, text, true from words
),
fused as (select qid, document, page, text, sum(1.0::double / (60 + rank)) as raw, min(list * 1000 + rank) as place, bool_or(strong) as strong from lists group by all),
scored as (select *, raw / max(raw) over (partition by qid) as score from fused),
eligible as (select *, regexp_replace(lower(text), '\\s+', ' ', 'g') as form from scored where strong),
best as (
  select *, min(place) over (partition by qid, document, page, form) as first, row_number() over (partition by qid, document, page, form order by round(score, 9) desc, place) as k from eligible
),
found as (select *, row_number() over (partition by qid order by round(score, 9) desc, first) as rank from best where k = 1)"""
_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[])"
_NORM = "sqrt(list_dot_product({0}.embedding::double[], {0}.embedding::double[]))"
_DISTANCE = {
    "cosine": f"1 - {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')})",
    "ip": f"1 - {_DOT}",
    "l2": f"greatest(0, list_dot_product(a.embedding::double[], a.embedding::double[]) + list_dot_product(b.embedding::double[], b.embedding::double[]) - 2 * {_DOT})",
}
_RELEVANCE = {"cosine": "1 - greatest(0, d)", "ip": "1 - greatest(0, d)", "l2": "1 / (1 + greatest(0, d))"}
#: The cases of versions, with the programme and the label that a document's name has.
_VERSIONED = f"""
q as (select qid, text, regexp_matches(text, '(?i)20\\d{{2}}\\s*(级|年|entry)|\\d{{2}}\\s*(至|-)\\s*\\d{{2}}') as names_year, regexp_matches(text, '[A-Za-z]') as english from {dealt_values(_ASKED, 'qid, text', 'qid')}),
e as (
  select qid, rank, document, names_year, english, document like '%适用于%.pdf' as versioned, split_part(document, '_适用于', 1) as programme, replace(split_part(document, '_适用于', 2), '.pdf', '') as label
  from {dealt_values(_VERSIONS, 'qid, rank, document', 'qid')} join q using (qid)
)"""
_OPTION = "case when english then 'For ' || replace(replace(replace(label, '至', '–'), '年度及以后入学学生', ' academic year and later entrants'), '年度入学学生', ' academic year entrants') else '适用于' || label end"
SQL = {
    "keyword_overlap_topk": f"with {_BASE} select qid, doc_id as ordinal, round(score, 6) as score, rank from overlap_ranked where rank <= {K}",
    "bm25_stats": f"with {_BASE} select token, round(idf, 6) as idf from idf",
    "bm25_topk": f"with {_BASE} select qid, doc_id as ordinal, round(score, 6) as score, rank from bm25_ranked where rank <= {K}",
    "dedup_evidence": f"""with {_BASE}, {_DEDUP}
select qid, row_number() over (partition by qid order by round(score, 9) desc, place) as rank, document, round(score, 6) as score, sha256(text) as sha256 from u where k = 1 qualify rank <= {K}""",
    "diversify_rounds": f"""with {_BASE}, {_DEDUP},
r as (select *, row_number() over (partition by qid, document order by round(score, 9) desc, place) as turn from u where k = 1)
select qid, row_number() over (partition by qid order by turn, round(score, 9) desc, place) as rank, document, round(score, 6) as score, sha256(text) as sha256 from r where turn <= 2 qualify rank <= {K}""",
    "rrf_fusion": f"""with {_BASE},
lists as (select qid, doc_id, rank from overlap_ranked where rank <= 20 union all select qid, doc_id, rank from bm25_ranked where rank <= 20),
raw as (select qid, doc_id, sum(1.0::double / (60 + rank)) as raw from lists group by all)
select qid, doc_id, round(raw / max(raw) over (partition by qid), 6) as score from raw""",
    "hybrid_retrieval": f"with {_BASE}, {_HYBRID} select qid, rank, document, page::int as page, round(score, 6) as score from found where rank <= 4",
    "citation_labels": "select doc_id, '【' || source || '，第 ' || (doc_id + 1) || ' 页】' as label, '【' || source || '，' || source || '】' as web_label from documents",
    "eval_metrics": f"""with {_BASE}, {_HYBRID},
gold as (select item_id as qid, min(doc_id) as gold from benchmark b join documents d on contains(d.text, b.text) group by item_id),
judged as (
  select b.item_id as qid, any_value(gold) as gold, min(case when page = gold + 1 then rank end) as first, count(rank) as n
  from benchmark b left join gold g on g.qid = b.item_id left join (select * from found where rank <= 4) f on f.qid = b.item_id group by b.item_id
)
select round(coalesce(avg(case when gold is not null then (first is not null)::int end), 0), 6) as recall_at_5, round(coalesce(avg(case when gold is not null then coalesce(1.0::double / first, 0) end), 0), 6) as mrr_at_10,
  round(coalesce(avg(case when gold is not null then (first is not null)::int end), 0), 6) as page_hit_rate, round(avg(((n = 0) = (gold is null))::int), 6) as refusal_accuracy from judged""",
    "version_scope": f"""
with {_VERSIONED},
chosen as (select * from e where versioned and not names_year qualify row_number() over (partition by qid order by rank) = 1)
select c.qid::bigint as qid, c.document, coalesce((select string_agg(distinct {_OPTION}, '|' order by {_OPTION}) from e where e.qid = c.qid and e.programme = c.programme and e.label <> c.label), '') as options from chosen c""",
    "version_clarification": f"""
with {_VERSIONED},
named as (select qid, programme, string_agg(distinct {_OPTION}, '|' order by {_OPTION}) as options, count(distinct label) as n, min(rank) as first from e where versioned and not names_year group by qid, programme having count(distinct label) > 1)
select qid::bigint as qid, programme, options from named qualify row_number() over (partition by qid order by n desc, first) = 1""",
    "prompt_context": f"""with {_BASE}, {_HYBRID},
context as (select qid, string_agg('证据 ' || rank || ' 【' || document || '，第 ' || page::int || ' 页】' || chr(10) || text, chr(10) || chr(10) order by rank) as context from found where rank <= 4 group by qid),
asked as (
  select item_id as qid, text, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 2 * length(regexp_replace(text, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')) as english,
    case when regexp_matches(text, '(?i){fixed.LEARNING_PATTERN}') then {_text(answers.MODE_RULES[fixed.LEARNING_PLAN] + answers.FORM_RULES[fixed.LEARNING_PLAN])} when regexp_matches(text, '(?i){fixed.COURSE_PATTERN}') then {_text(answers.MODE_RULES[fixed.COURSE_EXPLANATION] + answers.FORM_RULES[fixed.COURSE_EXPLANATION])}
      else {_text(answers.MODE_RULES[fixed.OFFICIAL_FACT] + answers.FORM_RULES[fixed.OFFICIAL_FACT])} end as task, not regexp_matches(text, '(?i){fixed.LEARNING_PATTERN}|{fixed.COURSE_PATTERN}') as fact from benchmark
),
p as (
  select qid, concat_ws(chr(10), '任务：' || task, case when english then {_text(answers.LANGUAGE_RULES['en'])} else {_text(answers.LANGUAGE_RULES['zh'])} end, {', '.join(map(_text, answers.COMMON_RULES))},
    case when fact then '拒答语：' || case when english then {_text(fixed.REFUSALS['en'])} else {_text(fixed.REFUSALS['zh'])} end end, '证据：' || chr(10) || coalesce(context, ''), '问题：' || text) as prompt from asked left join context using (qid)
)
select qid, length(prompt) as chars, sha256(prompt) as sha256 from p""",
}
SQL |= {
    f"vector_topk_{m}": f"""
select qid, ordinal, rank, round(greatest(0, least(1, {_RELEVANCE[m]})), 5) as relevance from (
  select a.vec_id as qid, b.vec_id as ordinal, {_DISTANCE[m]} as d, row_number() over (partition by a.vec_id order by round({_DISTANCE[m]}, 12), b.vec_id) as rank
  from embeddings a, embeddings b where a.vec_id % 50 = 0) where rank <= {K}"""
    for m in ("cosine", "l2", "ip")
}
