"""SimHash fingerprints, exact links by tiled comparison, and their connected components.

Fingerprints are compared in tiles with numpy's exclusive or and bit counts, and a pair of tiles
whose population counts differ by more than the radius is skipped. Tiles are made within blocks: the
64 bits are cut into parts, and two fingerprints within the radius agree on all but `radius` parts,
so each pair meets in the block of some choice of equal parts and none is lost. The number of
parts follows the number of fingerprints, so that blocks stay small. A block that is larger than a
tile is dealt out as pairs of tiles. From each comparison only links that span its own components
come out, never all pairs. Components are joined by rounds of large-star and small-star steps
over written tables. Fingerprints and components that hold a large share of all rows meet their rows by a broadcast.
Star rounds that have not settled after `most_rounds` raise an error, never a wrong result.

Defined results: null and empty texts have fingerprint zero and are linked like others. Repeated
rows each get their row. A null doc_id takes part and never names a component, unless all ids of it are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import WORDS, persist, slices, small_batches, utf8

RADIUS = 3
SHINGLE = 3
TILE = 2048
#: A key with more than this part of all rows is common; there are fewer common keys than this.
COMMON = 10_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is one if it is set in over half of the hashes of the shingles, repeats included."""
    import xxhash

    words = [m.encode() for m in WORDS.findall(text)]
    if not words:
        return 0
    joined = b" ".join(words).translate(_LOWER)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    begins = (ends - lengths + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(begins)
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(begins[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text")).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def parts_for(count: int, radius: int = RADIUS) -> int:
    """Parts of the 64 bits: more of them, and so longer keys, for more fingerprints, so that a block has about 64 at most by chance."""
    parts = radius + 1
    while parts < radius + 4 and count > 64 << (64 * (parts - radius) // parts):
        parts += 1
    return parts


def _keys(parts: int, radius: int) -> list[int]:
    """Masks: every choice of parts that may be equal."""
    edges = [64 * i // parts for i in range(parts + 1)]
    bits = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(bits, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(nodes: np.ndarray, radius: int, tile: int = 256) -> list[tuple[int, int]]:
    """Links within `radius` bits that span the same components as all pairs within it."""
    nodes = nodes[np.argsort(np.bitwise_count(nodes), kind="stable")]
    counts = np.bitwise_count(nodes).astype(np.int64)
    label, out = np.arange(len(nodes)), []
    for i in range(0, len(nodes), tile):
        a = nodes[i : i + tile]
        for j in range(i, len(nodes), tile):
            if counts[j] - counts[min(i + tile, len(nodes)) - 1] > radius:
                break  # rows are in the order of population counts, so all later tiles differ too much as well
            b = nodes[j : j + tile]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            while True:
                apart = label[i + x] != label[j + y]
                x, y = x[apart], y[apart]
                if not len(x):
                    break
                p, q = sorted((label[i + x[0]], label[j + y[0]]))
                out.append((int(a[x[0]]), int(b[y[0]])))
                label[label == q] = p
    return out


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that join all pairs within the radius."""
    masks = _keys(parts_for(distinct.count(), radius), radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("choice", "key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size"))
    crowds = persist(sizes.where("size > 1"), "blocks")
    keyed = keyed.join(crowds, ["choice", "key"])
    # A large block becomes tiles t; the pair (t, u) meets under t * tiles + u.
    keyed = keyed.withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.least("t", u) * F.col("tiles") + F.greatest("t", u))
    met = keyed.select("fp", "choice", "key", F.explode(pairs).alias("meeting"))

    def run(batches):
        """Rows come sorted by block and meeting; a block is compared once its rows are together."""
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            ids = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "key", "meeting")])
            if not len(ids):
                continue
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            found = []
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(ids))):
                name = tuple(ids[lo])
                if name != last:
                    found += spanning_links(np.unique(np.concatenate(held)), radius) if held and sum(map(len, held)) > 1 else []
                    held, last = [], name
                held.append(fp[lo:hi])
            if found:
                yield _edges(found)
        if held and sum(map(len, held)) > 1:
            found = spanning_links(np.unique(np.concatenate(held)), radius)
            if found:
                yield _edges(found)

    ordered = met.repartition("choice", "key", "meeting").sortWithinPartitions("choice", "key", "meeting")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*found)], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root for every node of an edge table (a, b): the smallest node of its component, by large-star and small-star rounds."""
    now = persist(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        # Large star: each node links its larger neighbours to its smallest one.
        both = now.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(now.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        large = both.join(least, "n").where("m > n").select(F.col("least").alias("lo"), F.col("m").alias("hi")).distinct()
        # Small star: each node links its smaller neighbours and itself to its smallest one.
        small = large.groupBy("hi").agg(F.min("lo").alias("least"))
        joined = large.join(small, "hi")
        linked = joined.select(F.col("least").alias("lo"), F.col("lo").alias("hi")).unionByName(small.select(F.col("least").alias("lo"), "hi")).where("lo <> hi").distinct()
        now = persist(linked, "links")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach) of every row."""
    fps = persist(fingerprints(docs, shingle), "fingerprints")
    distinct = persist(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    owned = persist(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")), "owned")
    names = persist(owned.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "names")
    classes = persist(joined_by_share(owned.drop("first_id"), names, "root", "members").select("fp", "n", "component_id"), "classes")
    joined = joined_by_share(fps, classes, "fp", "n")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def joined_by_share(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the one fact of their key; facts: key, the number of rows that have it, and more.

    Keys that have more than one row in COMMON, fewer than COMMON keys by arithmetic, are broadcast, so no task of the
    shuffled join gets more than a small share of the rows for one key.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    common = F.broadcast(facts.where(F.col(count) * COMMON > total).drop(count))
    rare = facts.where(F.col(count) * COMMON <= total).drop(count)
    others = rows.join(F.broadcast(common.select(key)), key, "left_anti").join(rare, key)
    return rows.join(common, key).unionByName(others)
