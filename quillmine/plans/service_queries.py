"""Stored items, patterns in questions, and answers from question to citation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmine.functions import fixed
from quillmine.functions.text import search_form, search_text
from quillmine.operators import answers, patterns
from quillmine.operators.store import KeyedStore
from quillmine.plans import retrieval_queries
from quillmine.plans.common import corpus, literal, questions, table
from quillmine.sources.tables import shared_folder


def stored_turns(spark, sf_dir):
    """All turns put by key, assistant turns put again with a mark, system turns deleted, compacted and read."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "conv_id", "turn", "role", "text")
    store = KeyedStore(spark, f"{shared_folder(spark)}/quillmine/turns-{uuid.uuid4().hex}")
    store.put(turns)
    store.put(turns.where("role = 'assistant'").withColumn("text", F.concat(F.lit("* "), F.col("text"))))
    store.delete(turns.where("role = 'system'").select("key"))
    store.compact()
    return store.read().select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha256"))


def _said(spark, sf_dir):
    """Questions, and the turns of conversations, under keys of their own."""
    asked = questions(spark, sf_dir).select(F.concat(F.lit("q"), F.col("qid")).alias("key"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("t"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("key"), "text")
    return asked.unionByName(turns).select("key", search_text(F.col("text"), any_script=False).alias("text"))


def source_mentions(spark, sf_dir):
    """Places where a question or turn has a word that is a document's source, or one of the synonyms."""
    names = table(spark, sf_dir, "documents").select(F.lower("source").alias("pattern"))
    words = spark.createDataFrame([(search_form(m),) for group in fixed.SYNONYM_GROUPS for m in group], "pattern string")
    # Frequent short words of the texts make the patterns of this query: the first words of all questions.
    first = questions(spark, sf_dir).select(F.split_part(F.lower("text"), F.lit(" "), F.lit(1)).alias("pattern"))
    found = patterns.occurrences(_said(spark, sf_dir), names.unionByName(words).unionByName(first), ["key"])
    return found.groupBy("key", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def answered_questions(spark, sf_dir):
    """From questions to checked answers, by a model that repeats the first label of its prompt."""
    model = lambda prompt: F.concat(F.lit("See "), F.regexp_extract(prompt, "证据 1 (【[^】]*】)", 1))
    out = answers.answer_questions(questions(spark, sf_dir), corpus(spark, sf_dir), model, any_script=False)
    return out.select("qid", "answer", F.size("sources").cast("long").alias("n_sources"), "grounded", "answer_mode")


QUERIES = {f.__name__: f for f in (stored_turns, source_mentions, answered_questions)}

_WORDS = ", ".join(f"({literal(search_form(m))})" for group in fixed.SYNONYM_GROUPS for m in group)
SQL = {
    "stored_turns": "select conv_id, turn, role, sha256(case when role = 'assistant' then '* ' || text else text end) as sha256 from conversations where role <> 'system'",
    "source_mentions": f"""
with said as (
  select key, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\b([a-z]{{2,4}})\\s*t\\s*(\\d{{4}}[a-z]?)\\b', '\\1t\\2', 'g'), '\\b([a-z]{{2,4}})\\s+(\\d{{4}}[a-z]?)\\b', '\\1\\2', 'g'), '\\s+', ' ', 'g')) as text
  from (select 'q' || item_id as key, text from benchmark union all select 't' || conv_id || '-' || turn, text from conversations)
),
p as (select distinct pattern from (select lower(source) as pattern from documents union all select * from (values {_WORDS}) union all select split_part(lower(text), ' ', 1) from benchmark) where pattern <> ''),
places as (
  select key, pattern, unnest(list_filter(range(1, length(text) - length(pattern) + 2), lambda i: substr(text, i, length(pattern)) = pattern
    and not regexp_matches(substr(' ' || text, i, 1), '[a-z0-9]') and not regexp_matches(substr(text || ' ', i + length(pattern), 1), '[a-z0-9]'))) as pos
  from said join p on contains(text, pattern)
)
select key, pattern, count(*) as n, min(pos) - 1 as first from places group by key, pattern""",
    "answered_questions": f"""with {retrieval_queries._BASE}, {retrieval_queries._HYBRID},
first as (select qid, '【' || document || '，第 ' || page::int || ' 页】' as label from found where rank = 1),
asked as (
  select item_id as qid, text, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 2 * length(regexp_replace(text, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')) as english,
    case when regexp_matches(text, '(?i){fixed.LEARNING_PATTERN}') then '{fixed.LEARNING_PLAN}' when regexp_matches(text, '(?i){fixed.COURSE_PATTERN}') then '{fixed.COURSE_EXPLANATION}' else '{fixed.OFFICIAL_FACT}' end as mode from benchmark
),
cited as (select f.qid, count(*) as n from found f join first using (qid) where f.rank <= 4 and '【' || f.document || '，第 ' || f.page::int || ' 页】' = label group by f.qid)
select qid, case when label is not null then 'See ' || label when mode <> '{fixed.OFFICIAL_FACT}' then 'See' when english then {literal(fixed.REFUSALS['en'])} else {literal(fixed.REFUSALS['zh'])} end as answer,
  coalesce(n, 0) as n_sources, label is not null or mode <> '{fixed.OFFICIAL_FACT}' as grounded, mode as answer_mode from asked left join first using (qid) left join cited using (qid)""",
}
