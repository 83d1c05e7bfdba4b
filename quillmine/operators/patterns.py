"""Many fixed patterns found in texts in one pass.

Patterns are a table. All of them are compiled into one trie with failure links (Aho-Corasick), which travels to the tasks
while the patterns have at most `MOST_BYTES`. Larger tables are cut by the patterns' first characters into parts of that size,
each with a pass over the texts of its own, whose rows are written before the next part goes out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.sources.tables import persist

MOST_BYTES = 32 << 20
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _automaton(patterns: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def _finder(shared, by: list[str], bounded: bool):
    def run(batches):
        found = _automaton(shared.value)
        for batch in batches:
            rows, patterns, starts = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for last, p in found.iter(text) if text else ():
                    at = last - len(p) + 1
                    if bounded and ((at and text[at - 1] in _WORD) or (last + 1 < len(text) and text[last + 1] in _WORD)):
                        continue
                    rows.append(i)
                    patterns.append(p)
                    starts.append(at)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(b).take(take) for b in by), pa.array(patterns, pa.string()), pa.array(starts, pa.int64())], [*by, "pattern", "at"])

    return run


class _Within:
    """The patterns that a text has, once each. The trie is made once a task, at its first text."""

    def __init__(self, shared):
        self.shared, self.found = shared, None

    def __call__(self, text: str) -> list[str]:
        if self.found is None:
            self.found = _automaton(self.shared.value)
        return list({p for _, p in self.found.iter(text)})


def _parts(patterns: DataFrame, most: int) -> list[Column | None]:
    """Conditions on `pattern` that cut a table into parts of at most `most` bytes each, by hashes of first characters; a character with more has parts by the pattern's own hash."""
    size = F.sum(F.octet_length("pattern") + F.lit(8))
    total = patterns.agg(size).first()[0] or 0
    if total <= most:
        return [None]
    first = F.substring("pattern", 1, 1)
    heavy = {r.c: r.n for r in patterns.groupBy(first.alias("c")).agg(size.alias("n")).where(F.col("n") > most // 2).collect()}  # at most 2 * total / most rows
    out: list[Column | None] = []
    for c, n in sorted(heavy.items()):
        parts = -(-2 * n // most)
        out += [(first == c) & (F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k) for k in range(parts)]
    light = total - sum(heavy.values())
    parts = -(-4 * light // most)
    rest = ~first.isin(*heavy) if heavy else F.lit(True)
    return out + [rest & (F.pmod(F.xxhash64(first), F.lit(parts)) == k) for k in range(parts)]


def _by_part(spark: SparkSession, patterns: DataFrame, most: int, find: Callable[[Broadcast], DataFrame], schema: str) -> DataFrame:
    """What `find` makes of the patterns, part by part."""
    distinct = patterns.select("pattern").where("pattern <> ''").distinct()
    parts = _parts(distinct, most)
    distinct = distinct if len(parts) == 1 else persist(distinct, "patterns")
    out = None
    for part in parts:
        held = sorted(r.pattern for r in (distinct if part is None else distinct.where(part)).collect())
        if not held:
            continue
        shared = spark.sparkContext.broadcast(held)
        found = find(shared)
        if len(parts) > 1:
            found = persist(found, "pattern-places")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _keys(texts: DataFrame, by: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    return ", ".join(f"`{b}` {kinds[b]}" for b in by)


def occurrences(texts: DataFrame, patterns: DataFrame, by: list[str], bounded: bool = True, most: int | None = None) -> DataFrame:
    """by, pattern and at (from 0) of every place of every pattern in the texts (by, text), overlapping ones too.

    bounded: places beside a Latin lower-case letter or digit don't count. Null and empty patterns and texts have no places; a repeated pattern counts once.
    """
    schema = f"{_keys(texts, by)}, pattern string, at long"
    return _by_part(texts.sparkSession, patterns, most or MOST_BYTES, lambda shared: texts.select(*by, "text").mapInArrow(_finder(shared, by, bounded), schema), schema)


def contained(texts: DataFrame, patterns: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """by and pattern of each pattern that a text (by, text) has anywhere, a row each, as `contains` has it: case and spaces count, and an empty pattern is in every text that isn't null.

    Texts go to Python by the hundred: whole documents in Arrow's batches of thousands take memory on both sides.
    """
    some = texts.where("text <> ''")

    def find(shared: Broadcast) -> DataFrame:
        return some.select(*by, F.explode(F.udf(_Within(shared), "array<string>", useArrow=False)("text")).alias("pattern"))

    found = _by_part(texts.sparkSession, patterns, most or MOST_BYTES, find, f"{_keys(texts, by)}, pattern string")
    empty = patterns.select("pattern").where("pattern = ''").distinct()
    return found.unionByName(texts.where("text is not null").select(*by).crossJoin(F.broadcast(empty)))


def named_groups(texts: DataFrame, groups: DataFrame, by: list[str], bounded: bool = True) -> DataFrame:
    """by and group of each group (group, pattern) that a text (by, text) names by one of its patterns at least."""
    found = occurrences(texts, groups, by, bounded).select(*by, "pattern").distinct()
    return found.join(groups.select("group", "pattern").distinct(), "pattern").select(*by, "group").distinct()


def longest_named(texts: DataFrame, names: DataFrame, by: list[str], bounded: bool = False) -> DataFrame:
    """by and name of the longest names (name, pattern) that are in a text; several if they are equally long."""
    found = occurrences(texts, names, by, bounded).select(*by, "pattern").distinct()
    best = found.groupBy(*by).agg(F.max(F.length("pattern")).alias("__most"))
    longest = found.join(best, by).where(F.length("pattern") == F.col("__most"))
    return longest.join(names.select("name", "pattern").distinct(), "pattern").select(*by, "name").distinct()
