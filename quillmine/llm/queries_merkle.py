"""Query of the Merkle manifest, with proofs checked against a tampered copy."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import merkle
from quillmine.llm.common import table


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = F.when(tampered, merkle.leaf(*fields, F.translate("text", ascii_uppercase, ascii_lowercase)))
    rows = docs.select("doc_id", "lang", merkle.leaf(*fields, F.col("text")).alias("leaf"), changed.alias("changed"))
    found = merkle.manifest(rows, F.col("lang"), [F.col("doc_id").asc_nulls_first(), F.col("leaf")], F.col("leaf"))
    folded = merkle.folded(F.coalesce("changed", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}

#: Levels of a tree that the SQL can climb: 8 ** 9 leaves.
_LEVELS = 9


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _climb(name: str, first: str) -> str:
    """Levels of all trees (tree, pos, h, n, left and right siblings) from a table (tree, pos, h, n)."""
    out = [f"{name}0 as (select * from {first})"]
    for k in range(_LEVELS):
        around = f"over (partition by tree, pos // 8 order by pos rows between {{}})"
        out.append(f"""{name}s{k} as (select tree, pos, n, h, coalesce(string_agg(h, '') {around.format('unbounded preceding and 1 preceding')}, '') as l,
  coalesce(string_agg(h, '') {around.format('1 following and unbounded following')}, '') as r from {name}{k})""")
        out.append(f"{name}{k + 1} as (select tree, pos // 8 as pos, case when any_value(n) > 1 then sha256(string_agg(h, '' order by pos)) else any_value(h) end as h, (any_value(n) + 7) // 8 as n from {name}{k} group by tree, pos // 8)")
    return ",\n".join(out)


def _fold(start: str, alias: str) -> str:
    """The root from a hash and the levels joined as alias0, alias1, and so on; a level of one node is its own root."""
    for k in range(_LEVELS):
        start = f"case when {alias}{k}.n > 1 then sha256({alias}{k}.l || ({start}) || {alias}{k}.r) else ({start}) end"
    return start


def _joins(name: str, alias: str, tree: str, pos: str) -> str:
    return " ".join(f"join {name}s{k} {alias}{k} on {alias}{k}.tree = {tree} and {alias}{k}.pos = {pos} // {8**k}" for k in range(_LEVELS))


def _siblings(alias: str) -> str:
    return " || ".join(f"case when {alias}{k}.n > 1 then {alias}{k}.l || {alias}{k}.r else '' end" for k in range(_LEVELS))


_CRC = "xor(4294967295, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::bigint))"
SQL = {
    "op11_merkle_manifest": f"""
with d as (
  select doc_id, dense_rank() over (order by lang nulls first) as tree, {_leaf('text')} as h, {_leaf(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")} as low, coalesce({_CRC} % 3 = 0, false) as tampered from documents
),
f as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by tree) as n from d),
{_climb('a', '(select tree, pos, h, n from f)')},
g as (select 0 as tree, tree - 1 as pos, h, count(*) over () as n from a{_LEVELS}),
{_climb('b', 'g')},
p as (
  select f.doc_id, f.h as leaf, t.h as subroot, (select h from b{_LEVELS}) as root, {_siblings('x')} || {_siblings('y')} as proof, case when tampered then f.low else f.h end as own,
    {_fold('case when tampered then f.low else f.h end', 'x')} as mid, t.pos as place from f {_joins('a', 'x', 'f.tree', 'f.pos')} join g t on t.pos = f.tree - 1 {_joins('b', 'y', '0', '(f.tree - 1)')}
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from (select p.*, {_fold('p.mid', 'y')} as folded from p {_joins('b', 'y', '0', 'p.place')})
"""
}
