"""Query of the URL verdicts and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import urls
from quillmine.llm.common import table

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    rows = urls.url_verdicts(pages, outcomes, RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


_UP = "least(greatest(coalesce(case when x > 0 then 1 / x - 1 else 1000.0 end, 1000.0), 1.0), 1000.0)"
_X = "(sum(n * (good / n - {r}) * (good / n - {r})) - sum({r} * (1 - {r}))) / nullif(sum((n - 1) * {r} * (1 - {r})), 0)"
_FITS = "\n      ".join(
    f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'"
    for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
)
QUERIES = {"op3_host_reputation": op3_host_reputation}
SQL = {
    "op3_host_reputation": f"""
with cut as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urls._UPPER}', '{urls._LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages
),
good as (select doc_id, min(quality) as good from labels where quality in (0, 1) group by doc_id),
hosts as (
  select host, count(good)::double as n, coalesce(sum(good), 0)::double as good,
    regexp_extract(host, '([^.]*[.])?[^.]*$') as domain, regexp_extract(host, '[^.]*$') as suffix
  from cut left join good on page_id = doc_id group by host
),
base as (select (sum(good) + 1) / (sum(n) + 2) as b from hosts),
l1 as (select suffix, sum(n) as n, sum(good) as good, any_value(b) as b from hosts, base group by suffix),
s1 as (select {_UP} as k from (select {_X.format(r='b')} as x from l1 where n > 0)),
m1 as (select suffix, (good + k * b) / (n + k) as m from l1, s1),
l2 as (select domain, any_value(m) as m, sum(n) as n, sum(good) as good from hosts join m1 using (suffix) group by domain),
s2 as (select {_UP} as k from (select {_X.format(r='m')} as x from l2 where n > 0)),
m2 as (select domain, (good + k * m) / (n + k) as m from l2, s2),
l3 as (select host, n, good, m from hosts join m2 using (domain)),
s3 as (select {_UP} as k from (select {_X.format(r='m')} as x from l3 where n > 0)),
p as (select host, (good + k * m) / (n + k) as mean, n + k + 1 as t from l3, s3),
q as (select host, mean - {urls.Z} * sqrt(mean * (1 - mean) / t) as bound from p),
r as (
  select page_id, host, path, bound, case {_FITS} end as rule from cut join q using (host)
)
select page_id, host, path, rule, case when rule in ({', '.join(f"'{r}'" for r, v in RULES if v == 'allow')}) then 'allow'
  when rule is not null then 'block' when bound < {urls.LIMIT} then 'block' else 'allow' end as verdict, round(bound, 6) as bound from r
"""
}
