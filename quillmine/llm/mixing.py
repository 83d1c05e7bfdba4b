"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of `block_rows`. A source with n of the N blocks of a mix is a Pfair task of weight n / N: its block j may
not start before slot floor(j * N / n) and must be placed before slot ceil((j + 1) * N / n). Earliest deadline first over the
released blocks keeps every source within less than one block of its target in every prefix, at any size.

The schedule is made in frames of about `FRAME` slots, each by a task. Where a frame ends, every source has placed the whole part of its share or one block more.
Which sources have one more is `done_before`: it follows from the counts and the slot alone, so the tasks of two neighbouring frames
agree on it without talking. It leaves back the blocks with the latest deadlines, as far as there are slots for the others among those released
so far (a laminar matroid, for which greedy is exact). A frame that doesn't work out is an error, never a wrong order.

The mix ends where the first source can't keep its weight any more: of each source the first `kept` blocks are in the mix (in_mix).
What the sources have beyond that follows as a second mix of its own, by what is left of each (in_mix is false); no document leaves
unless the caller asks for the mix alone.

Weights are an argument. Without them sources weigh as much as they have blocks, none above `most_share`.

Defined results: a null source is a source of its own. Rows that share source and doc_id are one document
and get the same place. A null doc_id counts as an id. Other columns are not read. A source without a weight has none of
its blocks in the mix; they come after it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.common import id_text, persist
from quillmine.llm.ranks import ranked

BLOCK_ROWS = 16
FRAME = 50_000
#: Slots before a frame's end in which the blocks of other sources are looked at, and later ends that are tried.
LOOK_BACK, TRIES = 2_000, 64
#: The production target: sources in proportion to their documents, but none above this part of the mix.
MOST_SHARE = 0.30
#: The list of sources goes to the driver; a table of more is refused, never cut.
MOST_SOURCES = 1_000_000


@dataclass(frozen=True)
class Mix:
    """Blocks of each source that are in the mix, and those that come after it."""

    kept: dict[str | None, int]
    rest: dict[str | None, int]


def _order(source: str | None) -> tuple[bool, str]:
    return source is None, source or ""


def capped_weights(blocks: dict[str | None, int], most_share: float = MOST_SHARE) -> dict[str | None, Fraction]:
    """Sources in proportion to their blocks with none above most_share; where even equal weights exceed it (fewer than 1 / most_share sources), proportions hold unchanged."""
    blocks, most = {s: n for s, n in blocks.items() if n > 0}, Fraction(most_share).limit_denominator(10**6)
    total = sum(blocks.values())
    if len(blocks) * most <= 1:
        return {s: Fraction(n, total) for s, n in blocks.items()}
    capped: set = set()
    while True:
        rest = sum(n for s, n in blocks.items() if s not in capped)
        free = 1 - most * len(capped)
        over = {s for s, n in blocks.items() if s not in capped and Fraction(n, rest) * free > most}
        if not over:
            return {s: most if s in capped else Fraction(n, rest) * free for s, n in blocks.items()}
        capped |= over


def target_mix(blocks: dict[str | None, int], weights: dict[str | None, float | Fraction]) -> Mix:
    """The longest mix of the weights: it ends where the first source has used up its blocks."""
    weights = {s: w if isinstance(w, Fraction) else Fraction(w).limit_denominator(10**9) for s, w in weights.items() if w > 0 and blocks.get(s, 0) > 0}
    kept: dict[str | None, int] = {}
    if weights:
        total = sum(weights.values())
        length = min(blocks[s] * total / w for s, w in weights.items())
        kept = {s: n for s, w in weights.items() if (n := int(length * w / total))}
    return Mix(kept, {s: n - kept.get(s, 0) for s, n in blocks.items() if n > kept.get(s, 0)})


def done_before(counts: np.ndarray, total: int, at: int, look_back: int = LOOK_BACK) -> np.ndarray | None:
    """Blocks that each source has placed before slot `at`: the whole part of its share, or one more. None where the slots near `at` leave no choice that is sure to work."""
    done, part = np.divmod(at * counts, total)
    open_ = np.flatnonzero(part)
    late = int((total - part[open_]).sum() // total)  # so many of the open blocks are left for later
    if not len(open_):
        return done
    release = done[open_] * total // counts[open_]
    deadline = -(-(done[open_] + 1) * total // counts[open_])
    # Room for blocks left back: of those released before slot x, all but x must wait.
    lo = max(0, at - look_back)
    first = -(-lo * counts // total)
    later = np.maximum(0, -(-at * counts // total) - first)
    source = np.repeat(np.arange(len(counts)), later)
    number = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later) + first[source]
    released = np.bincount(number * total // counts[source] - lo, minlength=at - lo + 1)[: at - lo + 1]
    x = np.arange(lo, at + 1)
    room = int(first.sum()) + np.concatenate([[0], np.cumsum(released)[:-1]]) - x
    back, held = np.zeros(len(x), np.int64), 0
    stay = np.ones(len(open_), bool)
    for i in np.lexsort((-open_, -deadline)):
        if held == late:
            break
        begin = max(0, int(release[i]) + 1 - lo)
        if (back[begin:] + 1 <= room[begin:]).all():
            back[begin:] += 1
            stay[i] = False
            held += 1
    if held < late:
        return None
    done[open_[stay]] += 1
    return done


def frame_end(counts: np.ndarray, total: int, near: int) -> tuple[int, np.ndarray]:
    """A slot at or soon after `near` where a frame may end, and what is done before it."""
    if near <= 0:
        return 0, np.zeros(len(counts), np.int64)
    for at in range(near, min(near + TRIES, total)):
        done = done_before(counts, total, at)
        if done is not None:
            return at, done
    if near + TRIES >= total:
        return total, counts.copy()
    raise RuntimeError(f"no frame can end near slot {near}")


def frame_slots(counts: np.ndarray, total: int, start: int, stop: int, done: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source and block of each slot from start to stop: earliest deadline first among released blocks, ties by source."""
    n = then - done
    source = np.repeat(np.arange(len(counts)), n)
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + done[source]
    release = np.maximum(block * total // counts[source], start)
    deadline = np.minimum(-(-(block + 1) * total // counts[source]), stop)
    order = np.argsort(release, kind="stable")
    waiting = list(zip(release[order].tolist(), deadline[order].tolist(), source[order].tolist(), block[order].tolist()))
    if len(waiting) != stop - start:
        raise RuntimeError("a frame has other blocks than slots")
    ready: list[tuple[int, int, int]] = []
    at, out = 0, []
    for now in range(start, stop):
        while at < len(waiting) and waiting[at][0] <= now:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        if not ready or ready[0][0] <= now:
            raise RuntimeError(f"slot {now} can't be kept")
        out.append(heapq.heappop(ready)[1:])
    placed = np.array(out, np.int64).reshape(-1, 2)
    return placed[:, 0], placed[:, 1]


def frame_schedule(counts: np.ndarray, number: int, frame: int = FRAME) -> tuple[int, np.ndarray, np.ndarray]:
    """First slot of frame `number` of a mix of so many blocks of each source, and source and block of each of its slots."""
    total = int(counts.sum())
    (start, done), (stop, then) = (frame_end(counts, total, min(total, k * frame)) if k * frame < total else (total, counts.copy()) for k in (number, number + 1))
    return start, *frame_slots(counts, total, start, stop, done, then)


def schedule(spark: SparkSession, mix: Mix, frame: int = FRAME) -> DataFrame:
    """source, block, release, deadline, slot and in_mix of all blocks; a task makes a frame."""
    parts = []
    for counts, first in ((mix.kept, {}), (mix.rest, mix.kept)):
        names = sorted(counts, key=_order)
        parts.append((names, np.array([counts[s] for s in names], np.int64), np.array([first.get(s, 0) for s in names], np.int64)))
    offset = int(parts[0][1].sum())
    sizes = [-(-int(counts.sum()) // frame) for _, counts, _ in parts]
    schema = "source string, block long, release long, deadline long, slot long, in_mix boolean"
    if not sum(sizes):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(parts)

    def run(batches):
        for batch in batches:
            for p, k in zip(batch.column("part").to_pylist(), batch.column("frame").to_pylist()):
                names, counts, first = shared.value[p]
                start, source, block = frame_schedule(counts, k, frame)
                if not len(source):
                    continue
                total, base = int(counts.sum()), offset * p
                slot = np.arange(start, start + len(source))
                columns = (block + first[source], block * total // counts[source] + base, -(-(block + 1) * total // counts[source]) + base, slot + base, np.full(len(slot), p == 0))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(source)), *map(pa.array, columns)], ["source", "block", "release", "deadline", "slot", "in_mix"])

    first = sizes[0]
    numbers = spark.range(0, sum(sizes), 1, min(sum(sizes), 4 * spark.sparkContext.defaultParallelism))
    listed = numbers.select(F.when(F.col("id") < first, 0).otherwise(1).alias("part"), F.when(F.col("id") < first, F.col("id")).otherwise(F.col("id") - first).alias("frame"))
    return listed.mapInArrow(run, schema)


def block_counts(ids: DataFrame, block_rows: int = BLOCK_ROWS) -> dict[str | None, int]:
    """Blocks of each source of a table of distinct documents."""
    counts = ids.groupBy("source").count().limit(MOST_SOURCES + 1).collect()
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r.source: -(-r["count"] // block_rows) for r in counts}


def interleave(ids: DataFrame, mix: Mix, block_rows: int = BLOCK_ROWS, bucket_rows: int = 2_000, frame: int = FRAME) -> DataFrame:
    """For each (source, doc_id) of a table of distinct documents: block, its release, deadline and slot, in_mix, and position (slot and place in the block as one number)."""
    rows = ids.count()
    key = F.xxhash64(id_text(F.col("doc_id")))
    placed = ranked(ids, ["source"], [key, F.col("doc_id")], F.struct(F.col("doc_id"), F.lit(5)), max(64, rows // bucket_rows), "rank")
    placed = placed.withColumn("block", F.floor(F.col("rank") / block_rows))
    plan = persist(schedule(ids.sparkSession, mix, frame), "mix-slots").withColumnRenamed("source", "mix_source").withColumnRenamed("block", "mix_block")
    out = placed.join(plan, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("block") == F.col("mix_block")))
    return out.select(
        "doc_id", "source", "block", "release", "deadline", "slot", (F.col("slot") * block_rows + F.pmod("rank", F.lit(block_rows))).alias("position"), "in_mix",
    )


def places(docs: DataFrame, weights: dict[str | None, float] | None = None, most_share: float = MOST_SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`interleave` of the documents of docs by the target weights; the list of documents is written once and read by all steps."""
    ids = persist(docs.select("source", "doc_id").distinct(), "mix-ids")
    blocks = block_counts(ids, block_rows)
    mix = target_mix(blocks, capped_weights(blocks, most_share) if weights is None else weights)
    return interleave(ids, mix, block_rows)


def _placed(docs: DataFrame, weights, most_share: float, block_rows: int) -> DataFrame:
    """docs with __position and __in."""
    at = places(docs, weights, most_share, block_rows).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("position").alias("__position"), F.col("in_mix").alias("__in"))
    return docs.join(at, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")), "left")


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, most_share: float = MOST_SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs that are in the mix, in its order, all their columns: for a caller who wants the weights to hold and what exceeds them to go."""
    return _placed(docs, weights, most_share, block_rows).where("__in").orderBy("__position", F.xxhash64("text")).select(*docs.columns)


def ordered_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, most_share: float = MOST_SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of docs in order: the mix, then what the sources have beyond their weights, by slot."""
    return _placed(docs, weights, most_share, block_rows).orderBy(F.col("__in").desc(), "__position", F.xxhash64("text")).select(*docs.columns)
