"""SimHash near copies: wide fingerprints propose, shingle sets decide.

A text's fingerprint has 128 bits: two SimHash words over the distinct shingles, by two independent hashes. Texts of Jaccard
similarity 0.8 differ in about 19 of the bits, unrelated ones in 64. Fingerprints are compared tile by tile with exclusive
or and bit counts, as in `simhash`. No choice of equal parts covers so wide a radius, so the blocks in which
tiles are made come from `tables_for` samples of the bits: a block has the fingerprints that agree on one sample, and both
the length of a sample and the number of samples follow the number of fingerprints, so that a pair at the
similarity shares some block with chance 0.997 (more above it) while blocks stay small.

Links are held against the shingle sets in two rounds. The first settles most groups with few of them: a block of the first FIRST
samples gives the links of a spanning forest of fingerprints within RADIUS bits and each one's links to its NEAREST_IN_BLOCK closest, and of all
these the links to the NEAREST closest of each fingerprint are tried, so a group of n near copies gives links in proportion to n.
The second round (`rest`) goes over all samples and tries every other pair within the radius that shares a block and is in two groups still, without a
bound on partners, so the groups are the same whatever the first round leaves: the sets of its rows meet in pairs of tiles of the block, each pair in the first sample it shares, and
only links that join groups leave a tile. So no pair below the similarity is linked, and one above it is missed only if it
shares no block or is beyond the radius; recall is measured in the README.

Texts of equal shingle sets are one class, however many rows have them. In the first round a block of more than MOST_BLOCK fingerprints is
divided by further bits of its sample; the second takes whole blocks, and skips tiles of one group.

Defined results: null and empty texts are one class. A shorter text is one shingle. Letters A-Z count as a-z.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.llm.common import persist, slices, small_batches, utf8
from quillmine.llm.simhash import components
from quillmine.llm.wordhash import mix, rolling, text_bytes, word_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
#: Differing bits up to which a pair is held against its sets: the mean of a pair at the similarity is 19, and more where texts have few shingles.
RADIUS = 36
#: Fingerprints of a block by chance, and the chance that a pair at the similarity is in no common block.
BLOCK = 32
MISSED = 0.003
#: Bits of a sample that are sorted by; only blocks of more than MOST_BLOCK go beyond the first of them.
SAMPLE_BITS = 48
TILE = 1024
MOST_BLOCK = 1 << 16
#: Links of a fingerprint that the first round tries: those to its closest of all blocks. The second round tries the rest.
NEAREST = 8
#: Closest others that each fingerprint gives in one block in the first round.
NEAREST_IN_BLOCK = 2
#: Samples in whose blocks the first round looks for links, so that their number for a fingerprint doesn't grow with that of all samples. The second round goes over all.
FIRST = 8
#: Rows of a tile whose sets meet those of another tile in the second round.
SETS_TILE = 256
#: Links of one class from which they are dealt over several tasks.
HOT = 1_000
_KEYED = ["sample", "key", "node", "fp1", "fp2"]
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(text: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    data, offsets = text_bytes(utf8(text))
    data = _LOWER[data]
    starts, ends, docs = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, 5)
    cuts = np.searchsorted(docs, np.arange(len(text) + 1))
    return [np.unique(rolling(words[a:b], max(1, min(shingle, b - a)), 17)) for a, b in zip(cuts, cuts[1:])]


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two words as signed numbers; a bit is one if over half of the hashes have it. An empty set has zeros."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14)]
        both = np.column_stack([h, mix(h ^ _U(0x9E3779B97F4A7C15))])
        ones += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    a, b = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")
    return int(a), int(b)


def _class(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, class (equal for equal shingle sets), the fingerprint's words and the number of distinct shingles of every row."""

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            words = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([_class(s) for s in sets], pa.binary()), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array([len(s) for s in sets], pa.int64())],
                ["doc_id", "text_key", "class", "fp1", "fp2", "size"],
            )

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, class binary, fp1 long, fp2 long, size long")


def tables_for(count: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits of a sample and number of samples for so many fingerprints."""
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(SAMPLE_BITS, max(4, math.ceil(math.log2(max(1, count / BLOCK)))))
    return bits, math.ceil(math.log(MISSED) / math.log(1 - same**bits))


def samples(tables: int) -> np.ndarray:
    """Places of the bits of each sample; the first bits of the samples run evenly over all places."""
    rng = np.random.default_rng(41)
    return np.array([rng.permutation(BITS)[:SAMPLE_BITS] for _ in range(tables)])


def _keyed(places: np.ndarray):
    """One row a fingerprint and sample: the sample's number and its bits."""
    weights = 1 << np.arange(SAMPLE_BITS - 1, -1, -1, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                node, fp1, fp2 = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                bits = np.unpackbits(np.column_stack([fp1, fp2]).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                keys = np.column_stack([bits[:, p] @ weights for p in places])
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(node))), pa.array(keys.reshape(-1)), *(pa.array(np.repeat(x, n)) for x in (node, fp1, fp2))], _KEYED)

    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    far += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    return far


def forest(far: np.ndarray, radius: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Links (i, j, distance) of a minimum spanning forest of the pairs within the radius, and the tree of each row."""
    n = len(far)
    far = far.astype(np.int16)
    np.fill_diagonal(far, 999)
    tree, out = np.arange(n), []
    near = np.flatnonzero((far <= radius).any(axis=1))
    if not len(near):
        return out, tree
    far = far[np.ix_(near, near)]
    m = len(near)
    least, parent, free = np.full(m, 998, np.int16), np.zeros(m, np.int64), np.ones(m, bool)
    root = 0
    for _ in range(m):
        k = int(np.where(free, least, 1000).argmin())
        if least[k] > radius:
            root = k
        else:
            out.append((int(near[parent[k]]), int(near[k]), int(least[k])))
        free[k], tree[near[k]] = False, near[root]
        closer = far[k] < least
        least[closer], parent[closer] = far[k][closer], k
    return out, tree


def nearest_links(far: np.ndarray, radius: int, nearest: int) -> list[tuple[int, int, int]]:
    """Links (i, j, distance) of each row to its closest others within the radius."""
    far = far.astype(np.int16)
    np.fill_diagonal(far, 999)
    out = []
    for i in np.flatnonzero((far <= radius).any(axis=1)):
        j = np.flatnonzero(far[i] <= radius)
        if len(j) > nearest:
            j = j[np.argsort(far[i][j], kind="stable")[:nearest]]
        out += [(int(i), int(k), int(far[i][k])) for k in j]
    return out


def _top(up: dict[int, int], k: int) -> int:
    while k in up:
        k = up[k]
    return k


def block_links(words: np.ndarray, radius: int = RADIUS, nearest: int = NEAREST_IN_BLOCK) -> list[tuple[int, int, int]]:
    """Links (i, j, distance) within a block: forests and closest rows of its tiles, and close pairs of different tiles that join trees not yet joined. There are fewer than 1 + nearest a row.

    Rows are in the order of population counts, and tile pairs whose counts differ by more than the radius are skipped.
    """
    if len(words) <= TILE:
        far = _distances(words, words)
        return forest(far, radius)[0] + nearest_links(far, radius, nearest) if (far <= radius).sum() > len(far) else []
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    words, ones = words[order], ones[order]
    out, root = [], np.arange(len(words))
    for i in range(0, len(words), TILE):
        far = _distances(words[i : i + TILE], words[i : i + TILE])
        found, tree = forest(far, radius)
        out += [(i + a, i + b, d) for a, b, d in found + nearest_links(far, radius, nearest)]
        root[i : i + TILE] = i + tree
    for i in range(0, len(words), TILE):
        for j in range(i + TILE, len(words), TILE):
            if ones[j] - ones[min(i + TILE, len(words)) - 1] > radius:
                break
            far = _distances(words[i : i + TILE], words[j : j + TILE])
            x, y = np.nonzero((far <= radius) & (root[i : i + TILE, None] != root[None, j : j + TILE]))
            if len(x):
                d = far[x, y]
                p, q = root[i + x], root[j + y]
                by = np.lexsort((d, q, p))
                first = by[np.append(True, (p[by][1:] != p[by][:-1]) | (q[by][1:] != q[by][:-1]))]
                up = {}
                for k in first[np.argsort(d[first], kind="stable")]:
                    a, b = _top(up, int(p[k])), _top(up, int(q[k]))
                    if a != b:
                        up[b] = a
                        out.append((i + int(x[k]), j + int(y[k]), int(d[k])))
                name = np.arange(len(words))
                for b in up:
                    name[b] = _top(up, b)
                root = name[root]
    return [(int(order[a]), int(order[b]), d) for a, b, d in out]


def _divided(keys: np.ndarray, lo: int, hi: int, bit: int):
    """Parts of a block whose keys are sorted; one that is too large is cut where its next bit changes."""
    if hi - lo <= MOST_BLOCK or bit >= SAMPLE_BITS:
        for at in range(lo, hi, MOST_BLOCK):
            yield at, min(at + MOST_BLOCK, hi)
        return
    shift = SAMPLE_BITS - bit - 1
    middle = lo + int(np.searchsorted(keys[lo:hi] >> shift & 1, 1))
    for a, b in ((lo, middle), (middle, hi)):
        if b > a:
            yield from _divided(keys, a, b, bit + 1)


def _compared(bits: int, radius: int):
    """Rows come sorted by sample and key; a block is compared once its rows are together."""

    def block(rows):
        _, key, node, fp1, fp2 = rows
        for lo, hi in _divided(key, 0, len(key), bits):
            if hi - lo < 2:
                continue
            words = np.column_stack([fp1[lo:hi], fp2[lo:hi]]).view(np.uint64)
            for i, j, d in {(min(i, j), max(i, j), d) for i, j, d in block_links(words, radius)}:
                a, b = int(node[lo + i]), int(node[lo + j])
                yield min(a, b), max(a, b), d

    def links(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*set(found)), (pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "distance"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in _KEYED]
            prefix = rows[1] >> (SAMPLE_BITS - bits)
            cuts = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (prefix[1:] != prefix[:-1])) + 1
            found = []
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(prefix))):
                name = (rows[0][lo], prefix[lo])
                if name != last:
                    if held and (len(held) > 1 or len(held[0][1]) > 1):
                        found += block([np.concatenate(c) for c in zip(*held)])
                    held, last = [], name
                held.append([c[lo:hi] for c in rows])
            if found:
                yield links(found)
        if held:
            found = list(block([np.concatenate(c) for c in zip(*held)]))
            if found:
                yield links(found)

    return run


def candidates(classes: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, nearest: int = NEAREST) -> DataFrame:
    """Links (a, b) of classes (node, fp1, fp2) to be held against the sets: of each class to the first of its own fingerprint, and of each fingerprint to its closest."""
    distinct = persist(classes.groupBy("fp1", "fp2").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), "distinct")
    bits, tables = tables_for(distinct.count(), similarity)
    keyed = distinct.select("node", "fp1", "fp2").mapInArrow(_keyed(samples(min(FIRST, tables))), "sample int, key long, node long, fp1 long, fp2 long")
    keyed = keyed.withColumn("prefix", F.shiftright("key", SAMPLE_BITS - bits)).repartition("sample", "prefix").sortWithinPartitions("sample", "key")
    far = persist(keyed.select(*_KEYED).mapInArrow(_compared(bits, radius), "a long, b long, distance int").distinct(), "links")
    shared = distinct.where("n > 1").select(F.col("node").alias("a"), F.col("fp1").alias("x"), F.col("fp2").alias("y"))
    equal = classes.join(shared, (F.col("fp1") == F.col("x")) & (F.col("fp2") == F.col("y"))).where("node <> a").select("a", F.col("node").alias("b"))
    ends = far.select("a", "b", "distance", F.explode(F.array("a", "b")).alias("end"))
    order = Window.partitionBy("end").orderBy("distance", "a", "b")
    close = ends.withColumn("place", F.row_number().over(order)).where(F.col("place") <= nearest).select("a", "b").distinct()
    return persist(close.unionByName(equal), "candidates")


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """node and hashes of the classes in needed, from one row's text each."""

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    row = classes.join(needed, "node").select("node", F.col("row.doc_id").alias("row_id"), F.col("row.text_key").alias("row_key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    texts = texts.join(row, (F.col("text_key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("row_id"))).select("node", "text")
    return persist(texts.mapInArrow(run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    if min(len(p), len(q)) < similarity * max(len(p), len(q)) - 1e-9:
        return False
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return shared >= similarity * (len(p) + len(q) - shared) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes, a written table, whose sets have the similarity. A node with many pairs is dealt over several tasks."""
    tiles = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("tiles")).where("tiles > 1")
    hot = persist(tiles.select(F.col("a").alias("hot"), "tiles"), "hot")
    left = pairs.join(hot, F.col("a") == F.col("hot"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("tiles", F.lit(1))).cast("int").alias("tile"))
    first = sets.join(hot, F.col("node") == F.col("hot"), "left")
    first = first.select(F.col("node").alias("a"), F.col("hashes").alias("x"), F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("tile"))
    both = left.join(first, ["a", "tile"]).join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(alike(p, q, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return persist(both.mapInArrow(run, "a long, b long"), "verified")


_OPEN = ["sample", "prefix", "tile", "other", "side", "node", "label", "fp1", "fp2", "size"]


def _open_pairs(fps: np.ndarray, labels: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, earlier: np.ndarray, radius: int, similarity: float):
    """Pairs (i of x, j of y, distance) of rows within the radius that are in two groups, whose sizes allow the similarity, and which no earlier sample holds."""
    far = _distances(fps[x], fps[y])
    lo, hi = np.minimum(sizes[x][:, None], sizes[y][None, :]), np.maximum(sizes[x][:, None], sizes[y][None, :])
    i, j = np.nonzero((far <= radius) & (labels[x][:, None] != labels[y][None, :]) & (lo >= similarity * hi - 1e-9))
    if len(i) and x is y:
        i, j = i[i < j], j[i < j]
    if len(i) and len(earlier):
        new = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 14):
            part = slice(at, at + (1 << 14))
            differ = np.unpackbits((fps[x[i[part]]] ^ fps[y[j[part]]]).view(np.uint8), axis=1, bitorder="little")
            for places in earlier:
                new[part] &= differ[:, places].any(axis=1)
        i, j = i[new], j[new]
    return i, j, far[i, j]


def _runs(batches, columns: list[str], key: list[str]):
    """Lists of columns of rows of equal keys, which come together and may go over several batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in key])
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(ids))):
            if tuple(ids[lo]) != last:
                if held:
                    yield last, [pa.chunked_array(c).combine_chunks() for c in zip(*held)]
                held, last = [], tuple(ids[lo])
            held.append([batch.column(c).slice(lo, hi - lo) for c in columns])
    if held:
        yield last, [pa.chunked_array(c).combine_chunks() for c in zip(*held)]


def _numbers(columns) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in columns]


def _meetings(bits: int, places: np.ndarray, radius: int, similarity: float):
    """Rows come sorted by block; out come the rows of each pair of tiles that have an open pair in it."""

    def block(name, columns):
        node, label, fp1, fp2, size = _numbers(columns)
        if len(node) < 2 or (label == label[0]).all():
            return
        fps = np.column_stack([fp1, fp2]).view(np.uint64)
        ones = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
        order = np.lexsort((ones, label))  # tiles of one group, within it of like population counts
        tiles = [order[at : at + SETS_TILE] for at in range(0, len(order), SETS_TILE)]
        spans = [(ones[t].min(), ones[t].max(), label[t[0]], label[t[-1]]) for t in tiles]
        for t, x in enumerate(tiles):
            for u in range(t, len(tiles)):
                y = tiles[u]
                if spans[t][2] == spans[u][3] or max(spans[t][0], spans[u][0]) - min(spans[t][1], spans[u][1]) > radius:
                    continue
                i, j, _ = _open_pairs(fps, label, size, x, y, places[: name[0], :bits], radius, similarity)
                if len(i):
                    sides = [(0, x[np.unique(np.append(i, j))])] if t == u else [(0, x[np.unique(i)]), (1, y[np.unique(j)])]
                    for side, rows in sides:
                        n = len(rows)
                        same = [np.full(n, v) for v in (*name, t, u, side)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*same, node[rows], label[rows], fp1[rows], fp2[rows], size[rows])], _OPEN)

    def run(batches):
        small, n = [], 0
        for name, columns in _runs(batches, ["node", "label", "fp1", "fp2", "size"], ["sample", "prefix"]):
            for found in block(name, columns):
                small.append(found)
                n += found.num_rows
                if n > 4096:
                    yield from pa.Table.from_batches(small).combine_chunks().to_batches()
                    small, n = [], 0
        if small:
            yield from pa.Table.from_batches(small).combine_chunks().to_batches()

    return run


def _joined(bits: int, places: np.ndarray, radius: int, similarity: float):
    """Rows with their sets come sorted by meeting; out come links of labels that join groups."""

    def run(batches):
        for name, columns in _runs(batches, ["side", "node", "label", "fp1", "fp2", "size", "hashes"], ["sample", "prefix", "tile", "other"]):
            side, _, label, fp1, fp2, size = _numbers(columns[:6])
            fps = np.column_stack([fp1, fp2]).view(np.uint64)
            x = np.flatnonzero(side == 0)
            y = x if name[2] == name[3] else np.flatnonzero(side == 1)
            i, j, far = _open_pairs(fps, label, size, x, y, places[: name[0], :bits], radius, similarity)
            group, out = label.copy(), []
            for k in np.argsort(far, kind="stable"):
                a, b = x[i[k]], y[j[k]]
                if group[a] == group[b]:
                    continue
                p, q = (np.frombuffer(columns[6][int(r)].as_buffer(), np.uint64) for r in (a, b))
                if alike(p, q, similarity):
                    out.append((int(label[a]), int(label[b])))
                    group[group == group[b]] = group[a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def rest(docs: DataFrame, classes: DataFrame, labelled: DataFrame, sets: DataFrame, similarity: float, shingle: int, radius: int) -> DataFrame:
    """Links (a, b) of labels: of all pairs of nodes within the radius that share a block and have different labels, those that have the similarity and join groups."""
    bits, tables = tables_for(classes.select("fp1", "fp2").distinct().count(), similarity)
    places = samples(tables)
    keyed = labelled.select("node", "fp1", "fp2").mapInArrow(_keyed(places), "sample int, key long, node long, fp1 long, fp2 long")
    keyed = keyed.withColumn("prefix", F.shiftright("key", SAMPLE_BITS - bits)).drop("key").join(labelled.select("node", "label", "size"), "node")
    keyed = keyed.repartition("sample", "prefix").sortWithinPartitions("sample", "prefix")
    schema = ", ".join(f"{c} long" for c in _OPEN)
    met = persist(keyed.select("sample", "prefix", "node", "label", "fp1", "fp2", "size").mapInArrow(_meetings(bits, places, radius, similarity), schema), "meetings")
    missing = met.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    if not missing.isEmpty():
        sets = sets.unionByName(_sets(docs, classes, missing, shingle))
    rows = met.join(sets, "node").repartition("sample", "prefix", "tile", "other").sortWithinPartitions("sample", "prefix", "tile", "other")
    return persist(rows.select(*_OPEN, "hashes").mapInArrow(_joined(bits, places, radius, similarity), "a long, b long"), "rest")


def groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Classes (class, node, first: the first row's doc_id and text_key, root): classes of one root are one group."""
    rows = signatures(docs, shingle)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    owned = rows.groupBy("class").agg(F.min(place).alias("row"), F.first("fp1").alias("fp1"), F.first("fp2").alias("fp2"), F.first("size").alias("size"))
    classes = persist(owned.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs = candidates(classes, similarity, radius)
    sets = _sets(docs, classes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), shingle)
    roots = components(verified(pairs, sets, similarity)).withColumnRenamed("node", "member")
    labelled = classes.join(roots, F.col("node") == F.col("member"), "left").select("class", "node", "row", "fp1", "fp2", "size", F.coalesce("root", "node").alias("label"))
    labelled = persist(labelled, "labelled")
    joined = components(rest(docs, classes, labelled, sets, similarity, shingle, radius)).withColumnRenamed("node", "member")
    return labelled.join(joined, F.col("label") == F.col("member"), "left").select("class", "node", F.col("row").alias("first"), F.coalesce("root", "label").alias("root"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay: of each group that pairs of at least the similarity join the one with the smallest doc_id, ties by text hash, null ids last."""
    kept = groups(docs, similarity, shingle).groupBy("root").agg(F.min("first").alias("row"))
    kept = kept.select(F.col("row.doc_id").alias("__id"), F.col("row.text_key").alias("__key"))
    rows = docs.withColumn("__text", F.xxhash64("text")).withColumn("__own", F.col("doc_id").cast("long"))
    rows = rows.join(kept, (F.col("__text") == F.col("__key")) & F.col("__own").eqNullSafe(F.col("__id")), "left_semi")
    # Repeated rows and copies without an id share the key; one of them stays.
    return rows.dropDuplicates(["__own", "__text"]).select(*docs.columns)
