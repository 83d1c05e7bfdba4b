"""Text, chunking and bookkeeping over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.functions import fixed, text
from quillmine.operators import answers, chunking, indexing, lexical, records
from quillmine.plans.common import table

_SPACED = "replace(replace(text, ' ', '  '), chr(10), chr(13) || chr(10))"


def text_normalize(spark, sf_dir):
    spaced = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("\r\n"))
    out = table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(spaced).alias("t"))
    return out.select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("sha256"))


def _counted(n, d):
    return lambda w: F.struct(w.alias("token"), F.lit(n).alias("n"), F.lit(d).alias("d"))


def tokenize_counts(spark, sf_dir):
    """Tokens and each document's distinct tokens go through one aggregation."""
    docs = lexical.spread(table(spark, sf_dir, "documents").select("text")).select(text.tokens(F.col("text"), any_script=False).alias("all"))
    marked = [F.transform(c, _counted(n, d)) for c, n, d in (("all", 1, 0), (F.array_distinct("all"), 0, 1))]
    return docs.select(F.explode(F.concat(*marked)).alias("x")).groupBy("x.token").agg(F.sum("x.n").alias("n"), F.sum("x.d").alias("n_docs"))


def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


def classify_questions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", text.classify_query(F.col("text")).alias("mode"), text.is_aggregate_query(F.col("text"), any_script=False).alias("aggregate"))


def exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    first = Window.partitionBy("source", "sha256").orderBy("doc_id")
    return docs.withColumn("n", F.row_number().over(first)).select("doc_id", "source", (F.col("n") > 1).alias("repeated"))


def chunk_oversized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = docs.select("doc_id", F.posexplode(chunking.oversized_pieces(F.col("text"))).alias("at", "piece"))
    return cut.select("doc_id", (F.col("at") + 1).cast("long").alias("chunk_index"), F.length("piece").cast("long").alias("chars"), F.sha2("piece", 256).alias("sha256"))


def chunk_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    cut = chunking.split_pages(docs)
    return cut.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("file_hash", F.sha2("text", 256))
    return docs.select("doc_id", indexing.chunk_id(F.col("file_hash"), F.lit(1), F.col("doc_id"), F.col("text")).alias("chunk_id"))


def contact_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.contact_fields(F.col("text")).alias("f"))
    return docs.select("doc_id", F.array_join("f.emails", "|").alias("emails"), F.array_join("f.phones", "|").alias("phones"))


def manifest_changes(spark, sf_dir):
    """An earlier state that lacks some documents and has others with different text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("hash"), "doc_id")
    old = docs.where("doc_id % 7 <> 0").select(
        F.lit("pdf").alias("kind"), "key", F.when(F.col("doc_id") % 11 == 0, F.lit("-")).otherwise(F.col("hash")).alias("hash"), F.lit("").alias("document"), F.lit("c").alias("configuration"), F.lit(1).alias("n_chunks")
    )
    return indexing.changes(docs, old, "pdf", "c").select("doc_id", "status")


def history_window(spark, sf_dir):
    out = answers.history_windows(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", F.col("n_history").cast("long").alias("n_history"), F.sha2("query", 256).alias("query_sha256"))


def grade_status_summary(spark, sf_dir):
    """Return flags as grades: A, N and R."""
    lines = table(spark, sf_dir, "lineitem")
    status = records.grade_status(F.col("l_returnflag"))
    return lines.groupBy("l_linestatus", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


QUERIES = {f.__name__: f for f in (text_normalize, tokenize_counts, detect_language, classify_questions, exact_dedup, chunk_oversized, chunk_pages, chunk_ids, contact_fields, manifest_changes, history_window, grade_status_summary)}

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"
_AGGREGATE = " or ".join(f"regexp_matches(lower(text), '{p}')" for p in fixed.AGGREGATE_PATTERNS)
_EMAIL = r"([\w.+-]+@[\w.-]+\.[A-Za-z]{2,})(?:[^\w.-]|$)"
_FIELDS = "array_to_string(list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda p: list_position(x, p[1]) = p[2]), lambda p: p[1]), '|')"
SQL = {
    "text_normalize": f"""
select doc_id, length(t) as chars, sha256(t) as sha256 from (
  select doc_id, trim(regexp_replace(regexp_replace(replace({_SPACED}, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as t from documents)""",
    "tokenize_counts": f"select token, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest({_TOKENS}) as token from documents) group by token",
    "detect_language": "select doc_id, case when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 2 * length(regexp_replace(text, '[^\\x{3400}-\\x{9fff}]', '', 'g')) then 'en' else 'zh' end as language from documents",
    "classify_questions": f"""
select conv_id, turn, case when regexp_matches(text, '(?i){fixed.LEARNING_PATTERN}') then '{fixed.LEARNING_PLAN}' when regexp_matches(text, '(?i){fixed.COURSE_PATTERN}') then '{fixed.COURSE_EXPLANATION}'
  else '{fixed.OFFICIAL_FACT}' end as mode, ({_AGGREGATE}) as aggregate from conversations""",
    "exact_dedup": "select doc_id, source, row_number() over (partition by source, sha256(text) order by doc_id) > 1 as repeated from documents",
    "chunk_oversized": """
with recursive step as (
  select doc_id, text, 0 as start, 0 as stop, 0 as n from documents where length(text) > 0
  union all
  select doc_id, text, next, next + case when next + 1000 < length(text) and cut > 500 then cut + 1 else least(1000, length(text) - next) end, n + 1 from (
    select *, coalesce((select max(p) from (values (1000 - strpos(reverse(window_text), ' ')), (1000 - strpos(reverse(window_text), chr(10))), (1000 - strpos(reverse(window_text), '。'))) as v(p) where p < 1000), -1) as cut from (
      select *, substr(text, next + 1, 1000) as window_text from (
        select doc_id, text, n, stop, case when n = 0 then 0 else greatest(start + 1, stop - 150) end as next from step where n = 0 or stop < length(text))))
),
pieces as (select doc_id, n, trim(substr(text, start + 1, stop - start), ' ' || chr(10)) as piece from step where n > 0)
select doc_id, row_number() over (partition by doc_id order by n) as chunk_index, length(piece) as chars, sha256(piece) as sha256 from pieces where piece <> ''""",
    "chunk_pages": """
with recursive docs as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents),
cut as (select doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) as p, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) as pos from docs),
pars as (select doc_id, trim(p, ' ' || chr(10)) as p, row_number() over (partition by doc_id order by pos) as i from cut where trim(p, ' ' || chr(10)) <> ''),
walk as (
  select doc_id, i, p, 1 as grp, case when length(p) > 1000 then 0 else length(p) end as held from pars where i = 1
  union all
  select n.doc_id, n.i, n.p, w.grp + case when w.held > 0 and w.held + 2 + length(n.p) <= 1000 then 0 else 1 end,
    case when w.held > 0 and w.held + 2 + length(n.p) <= 1000 then w.held + 2 + length(n.p) when length(n.p) > 1000 then 0 else length(n.p) end
  from walk w join pars n on n.doc_id = w.doc_id and n.i = w.i + 1
),
groups as (select doc_id, grp, string_agg(p, chr(10) || chr(10) order by i) as text, max(length(p)) > 1000 as big from walk group by doc_id, grp),
step as (
  select doc_id, grp, text, 0 as start, 0 as stop, 0 as n from groups where big
  union all
  select doc_id, grp, text, next, next + case when next + 1000 < length(text) and cut > 500 then cut + 1 else least(1000, length(text) - next) end, n + 1 from (
    select *, coalesce((select max(p) from (values (1000 - strpos(reverse(window_text), ' ')), (1000 - strpos(reverse(window_text), chr(10))), (1000 - strpos(reverse(window_text), '。'))) as v(p) where p < 1000), -1) as cut from (
      select *, substr(text, next + 1, 1000) as window_text from (
        select doc_id, grp, text, n, stop, case when n = 0 then 0 else greatest(start + 1, stop - 150) end as next from step where n = 0 or stop < length(text))))
),
pieces as (
  select doc_id, grp, n, trim(substr(text, start + 1, stop - start), ' ' || chr(10)) as piece from step where n > 0
  union all select doc_id, grp, 0, text from groups where not big
)
select doc_id, row_number() over (partition by doc_id order by grp, n) as chunk_index, length(piece) as chars, sha256(piece) as sha256 from pieces where piece <> ''""",
    "chunk_ids": "select doc_id, sha256(sha256(text) || ':1:' || doc_id || ':' || text) as chunk_id from documents",
    "contact_fields": f"""
select e.doc_id, emails, phones from
  (select doc_id, {_FIELDS} as emails from (select doc_id, regexp_extract_all(text, '{_EMAIL}', 1) as x from documents)) e join
  (select doc_id, {_FIELDS} as phones from (select doc_id, list_transform(regexp_extract_all(text, '{fixed.FIELD_PATTERNS["phones"]}'), lambda v: trim(v)) as x from documents)) p on e.doc_id = p.doc_id""",
    "manifest_changes": "select doc_id, case when doc_id % 7 = 0 then 'new' when doc_id % 11 = 0 then 'changed' else 'unchanged' end as status from documents",
    "history_window": """
with t as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as k from conversations where role in ('user', 'assistant')
),
h as (
  select t.conv_id, t.turn, t.text, p.k, p.role, p.text as said, row_number() over (partition by t.conv_id, t.turn order by case when p.role = 'user' then 0 else 1 end, p.k desc) as back
  from t left join t p on p.conv_id = t.conv_id and p.k between t.k - 6 and t.k - 1 where t.role = 'user'
)
select conv_id, turn, count(k) as n_history,
  sha256(coalesce(string_agg(case when role = 'user' and back <= 2 then said || chr(10) || '相关上文：' end, '' order by k), '') || any_value(text)) as query_sha256
from h group by conv_id, turn""",
    "grade_status_summary": "select l_linestatus, case when l_returnflag = 'A' then 'passed' else 'unknown' end as status, count(*) as n, sum(l_quantity) as quantity from lineitem group by 1, 2",
}
