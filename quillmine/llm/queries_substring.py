"""Query of the substring deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import table
from quillmine.llm.substring import remove_repeats


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
SQL = {
    "op6_substring_dedup": """
with w as (
  select doc_id, i, s[i] as word from (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as s from documents
  ), unnest(generate_series(1, len(s))) as u(i)
),
g as (
  select doc_id, i, count(*) over f as n, array_to_string(list(word) over f, ' ') as seq
  from w window f as (partition by doc_id order by i rows between current row and 19 following)
),
r as (select doc_id, i, row_number() over (partition by seq order by doc_id, i) as k from g where n = 20),
c as (
  select w.doc_id, w.i, w.word, coalesce(max(case when r.k > 1 then 1 else 0 end) over (partition by w.doc_id order by w.i rows between 19 preceding and current row), 0) as gone
  from w left join r on w.doc_id = r.doc_id and w.i = r.i
),
a as (
  select doc_id, count(*) as n_words, sum(gone) as n_removed, string_agg(word, ' ' order by i) filter (gone = 0) as kept from c group by doc_id
)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join a on d.doc_id = a.doc_id
"""
}
