"""Removal of bytes in repeated byte strings, found in merged Burrows-Wheeler transforms.

A window is `length` bytes of a document's UTF-8. Its anchor is the leftmost smallest hash among its grams of length / 5
bytes, so equal windows have equal anchors. Every chosen place of all documents is counted by its gram; windows around a gram that
is chosen once can't repeat. Around each other place its context, all bytes of the windows that chose it, goes to the task of
its gram, a document at a time. There contexts are dealt into shards, each gets its transform (quillmine.llm.bwt),
and the transforms are merged to a depth of `length` bytes; the intervals left are the repeated strings, exactly.

Nothing is held against all pairs, nothing is broadcast, and no task holds a hot gram: places are joined with counts by a join that
Spark may split, equal contexts of a task are one row with the places they stand for, and a gram of n places is dealt over
1 + n // `MOST_CONTEXTS` tasks by the hashes of its windows, so that equal windows still meet.

Defined results: a null text has no bytes. Each row is a document, so a repeated row repeats. A document shorter than
`length` keeps all. A doc_id that is null or not unique is told apart by hashes of the text (128 bits in all). All columns are kept; those named
n_bytes, n_removed, n_spans or kept are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.bwt import grams, merged_intervals, shard_transform, symbol_numbers
from quillmine.llm.common import persist, slices, small_batches, utf8
from quillmine.llm.substring import _anchors
from quillmine.llm.wordhash import mix, text_bytes

LENGTH = 200
#: Symbols of a window.
DEPTH = 5
MOST_CONTEXTS = 4096
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")
_CHUNK = 1 << 20
_FLUSH_BYTES = 24 << 20
#: Bytes of contexts whose transforms are merged at once, and shards of them.
_MERGE_BYTES = 3 << 20
_SHARDS = 4
_U = np.uint64
_CONTEXTS = "gram long, salt int, context binary, members array<struct<own: long, key: long, lo: int>>"


def _check(length: int) -> int:
    if length % DEPTH or not DEPTH <= length <= 4000:
        raise ValueError(f"the length must be a multiple of {DEPTH} up to 4000")
    return length // DEPTH


def _places(data: np.ndarray, length: int, gram: int):
    """Anchors of one text, in chunks of windows: gram, place, first and last window start of each run of windows that chose it."""
    for at in range(0, len(data) - length + 1, _CHUNK):
        hashes = grams(data[at : at + _CHUNK + length - 1], gram)
        place, _ = _anchors(hashes, length - gram + 1)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        hi = np.append(lo[1:], len(place)) - 1
        yield hashes[place[lo]], at + place[lo], at + lo, at + hi


def _anchor_rows(length: int, counted: bool):
    """Of each document the chosen places. counted: only how often each gram is chosen, a row for each gram of a slice."""
    gram = _check(length)

    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(utf8(batch.column("text")))
            found, doc = [], []
            for i in np.flatnonzero(np.diff(offsets) >= length):
                for part in _places(data[offsets[i] : offsets[i + 1]], length, gram):
                    found.append(part)
                    doc.append((i, len(part[0])))
            if not found:
                continue
            hashes, place, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(4))
            if counted:
                key, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])
                continue
            rows = pa.array(np.repeat([i for i, _ in doc], [n for _, n in doc]))
            packed = (place << 24) | ((place - lo) << 12) | (place - hi)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("own").take(rows), batch.column("key").take(rows), pa.array(packed)], ["gram", "own", "key", "packed"])

    return run


def _context_rows(length: int):
    """The contexts of the places in `__places`; equal ones of a flush are one row with the places they stand for."""
    gram = _check(length)

    def give(held):
        rows = list(held.items())
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            counts = [len(m) // 3 for _, m in part]
            flat = np.array([x for _, m in part for x in m], np.int64).reshape(-1, 3)
            members = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(flat[:, 2].astype(np.int32))], ["own", "key", "lo"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), members)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([k[2] for k, _ in part], pa.binary()), lists], ["gram", "salt", "context", "members"])

    def run(batches):
        held, n = {}, 0
        for batch in slices(batches, "text"):
            own, key = (batch.column(c).to_pylist() for c in ("__own", "__key"))
            for i, (text, places) in enumerate(zip(batch.column("text"), batch.column("__places"))):
                raw = text.as_buffer().to_pybytes()
                data = np.frombuffer(raw, np.uint8)
                values = places.values
                packed, parts = (values.field(c).to_numpy(zero_copy_only=False) for c in ("packed", "parts"))
                place = packed >> 24
                lo, hi = place - ((packed >> 12) & 4095), place - (packed & 4095)
                # The gram again, from its bytes: places side by side, so that one call hashes all.
                cut = data[(place[:, None] + np.arange(gram)).reshape(-1)]
                name = grams(cut, gram)[::gram].view(np.int64)
                for p in np.argsort(place, kind="stable"):
                    a, b = int(lo[p]), int(hi[p]) + length
                    salts = (0,)
                    if parts[p] > 1:
                        inside = grams(data[a:b], gram)
                        windows = inside[: b - a - length + 1].copy()
                        for k in range(1, DEPTH):
                            windows = mix(windows + inside[k * gram : k * gram + len(windows)])
                        salts = np.unique(windows % _U(parts[p])).tolist()
                    for salt in salts:
                        held.setdefault((int(name[p]), salt, raw[a:b]), []).extend((own[i], key[i], a))
                    n += (b - a) * len(salts)
                if n > _FLUSH_BYTES:
                    yield from give(held)
                    held, n = {}, 0
        yield from give(held)

    return run


def repeated_windows(contexts: list[bytes], twice: np.ndarray, length: int = LENGTH, shards: int = _SHARDS) -> list[np.ndarray]:
    """For each of different contexts, whether the window at each of its starts repeats: in another context, elsewhere in it, or everywhere if the context stands for more than one place (twice)."""
    gram = length // DEPTH
    size = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    string = np.repeat(np.arange(len(contexts)), size)
    places = np.arange(len(data))
    places = places[places + gram <= ends[string]]
    number = symbol_numbers(data, places, gram)
    suffix = np.full(len(data) + gram, -1, np.int64)
    suffix[places] = np.arange(len(places))
    follow = np.where(places + gram < ends[string[places]], suffix[np.minimum(places + gram, len(data) - 1)], -1)
    cuts = np.searchsorted(ends[string[places]], np.linspace(0, len(data), min(shards, len(contexts)) + 1)[1:-1], side="right")
    transforms = []
    for lo, hi in zip([0, *cuts], [*cuts, len(places)]):
        if hi > lo:
            transforms.append(shard_transform(number[lo:hi], places[lo:hi], np.where(follow[lo:hi] >= 0, follow[lo:hi] - lo, -1), DEPTH))
    starts, _ = merged_intervals(transforms, DEPTH)
    hit = np.zeros(len(data), bool)
    hit[starts] = True
    begin = ends - size
    return [np.ones(n - length + 1, bool) if t else hit[b : b + n - length + 1] for b, n, t in zip(begin, size, twice)]


def _merge(length: int):
    """Runs of repeated window starts of every place; rows come sorted by gram and salt."""

    def settle(rows):
        groups: dict = {}
        for gram, salt, context, members in rows:
            groups.setdefault(gram, {}).setdefault(context, {}).setdefault(salt, []).append(members)
        contexts, twice, places = [], [], []
        out = []
        for group in groups.values():
            alone = len(group) == 1
            for context, salts in group.items():
                # A context of several salts is the same place again, so places count within a salt.
                many = any(sum(map(len, m)) > 1 for m in salts.values())
                members = [m for held in salts.values() for m in held]
                if alone:
                    if many:
                        out.append((members, np.zeros(1, np.int64), np.array([len(context) - length + 1])))
                    elif len(context) > length:  # windows of one context may still be equal
                        contexts.append(context), twice.append(False), places.append(members)
                else:
                    contexts.append(context), twice.append(many), places.append(members)
        if contexts:
            for hit, members in zip(repeated_windows(contexts, np.array(twice), length), places):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                if len(edge):
                    out.append((members, edge[::2], edge[1::2] - edge[::2]))
        if not out:
            return
        own, key, start, run = [], [], [], []
        for members, at, n in out:
            for m in members:
                held = m.values
                o, k, lo = (held.field(c).to_numpy(zero_copy_only=False) for c in ("own", "key", "lo"))
                own.append(np.repeat(o, len(at))), key.append(np.repeat(k, len(at)))
                start.append((lo[:, None] + at[None, :]).reshape(-1)), run.append(np.tile(n, len(lo)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(key)), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(run).astype(np.int32))], ["own", "key", "start", "run"])

    def run(batches):
        held, n, now = [], 0, None
        for batch in batches:
            for row in zip(batch.column("gram").to_pylist(), batch.column("salt").to_pylist(), batch.column("context").to_pylist(), batch.column("members")):
                if n > _MERGE_BYTES and row[:2] != now:
                    yield from settle(held)
                    held, n = [], 0
                now = row[:2]
                held.append(row)
                n += len(row[2])
        if held:
            yield from settle(held)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __own (doc_id, or a hash of the text where there is none) and __key (a second hash); neither is ever null."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.md5(F.col("text"))))
    return docs.withColumns({"__own": own, "__key": F.xxhash64("doc_id", "text")})


def repeated_starts(keyed: DataFrame, length: int = LENGTH, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """own, key, start and run: the runs of starts of windows that repeat. keyed: documents with __own and __key."""
    texts = keyed.select(F.col("__own").alias("own"), F.col("__key").alias("key"), "text").where(F.octet_length("text") >= length)
    counts = texts.select("text").mapInArrow(_anchor_rows(length, True), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    parts = (1 + F.floor(F.col("n") / most_contexts)).cast("int").alias("parts")
    # A written table: Spark splits a hot gram only where both sides of the join are plain shuffles.
    repeated = persist(counts.select("gram", parts), "grams")
    places = texts.mapInArrow(_anchor_rows(length, False), "gram long, own long, key long, packed long").join(repeated, "gram")
    listed = places.groupBy(F.col("own").alias("__o"), F.col("key").alias("__k")).agg(F.collect_set(F.struct("packed", "parts")).alias("__places"))
    # All columns stay, as in the last join of `remove_passages`, so that Spark shuffles the documents once for both.
    cut = keyed.join(listed, (F.col("__own") == F.col("__o")) & (F.col("__key") == F.col("__k"))).drop("__o", "__k")
    contexts = cut.mapInArrow(_context_rows(length), _CONTEXTS)
    return contexts.repartition("gram", "salt").sortWithinPartitions("gram", "salt").mapInArrow(_merge(length), "own long, key long, start int, run int")


def _kept(length: int, keep: list[str]):
    def run(batches):
        for batch in slices(batches):
            sizes, removed, spans, left = [], [], [], []
            for text, starts, runs in zip(batch.column("text"), batch.column("__starts").to_pylist(), batch.column("__runs").to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                sizes.append(len(raw))
                if not starts:
                    removed.append(0), spans.append(0), left.append(raw)
                    continue
                begin = np.array(starts)
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], (begin + np.array(runs) - 1 + length)[order]
                reach = np.maximum.accumulate(end)
                new = np.concatenate([[True], begin[1:] > reach[:-1]])
                a, b = begin[new], np.append(reach[:-1][new[1:]], reach[-1])
                out = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                removed.append(len(raw) - len(out)), spans.append(len(a)), left.append(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())], [*keep, *RESULTS])

    return run


def remove_passages(docs: DataFrame, length: int = LENGTH, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """All columns of docs with n_bytes, n_removed, n_spans (removed runs) and kept: the bytes that no repeated window covers."""
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    keyed = _keyed(small_batches(docs).select(*keep))
    found = repeated_starts(keyed, length, most_contexts).groupBy(F.col("own").alias("__o"), F.col("key").alias("__k")).agg(F.collect_list("start").alias("__starts"), F.collect_list("run").alias("__runs"))
    joined = keyed.join(found, (F.col("__own") == F.col("__o")) & (F.col("__key") == F.col("__k")), "left").drop("__o", "__k")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_bytes long, n_removed long, n_spans long, kept binary"
    return joined.mapInArrow(_kept(length, keep), schema)
