"""Query of the perspective rotation and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.chat import perspectives
from quillmine.llm.common import table


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m.start, m.start + m.length)), ",")
    return rows.select("conv_id", "perspective", "segment", "part", F.col("n_turns").cast("long").alias("n_turns"), "text", mask.alias("mask"))


QUERIES = {"op5_perspective_rotation": op5_perspective_rotation}
SQL = {
    "op5_perspective_rotation": """
with said as (
  select conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') as role, replace(coalesce(text, ''), '<|', '<\\|') as text,
    coalesce(floor(turn / 64.0), 0)::bigint as segment from conversations
),
cut as (select *, (row_number() over (partition by conv_id, segment order by turn nulls first, role, text) - 1) // 1024 as part from said),
speakers as (select distinct conv_id, role as perspective from said where lower(role) <> 'system'),
seen as (
  select s.conv_id, p.perspective, segment, part, turn, role, text,
    case when role = p.perspective then '<|assistant|>\n' when lower(role) = 'system' then '<|system|>\n'
      else '<|user name=' || replace(role, '<|', '<\\|') || '|>\n' end as head,
    role = p.perspective as own
  from cut s join speakers p on s.conv_id is not distinct from p.conv_id
),
placed as (
  select *, head || text || '<|end|>\n' as piece,
    coalesce(sum(length(head) + length(text) + 8) over (partition by conv_id, perspective, segment, part order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as pos
  from seen
)
select conv_id, perspective, segment, part, count(*) as n_turns, string_agg(piece, '' order by turn nulls first, role, text) as text,
  coalesce(string_agg(case when own then (pos + length(head))::bigint || ':' || (pos + length(piece))::bigint end, ',' order by pos), '') as mask
from placed group by conv_id, perspective, segment, part
"""
}
