"""Exact removal of repeated word windows behind a count-min prefilter.

A window is `length` consecutive words of a document. Each window has an anchor: the smallest
hash among its runs of `GRAM` words. Equal windows have equal anchors at different places, so
the number of places at which an anchor is chosen is never below the number of its windows.
Pass one counts the chosen places of all documents in count-min sketches, one for each task,
as sparse lists of cells; they are merged cell by cell and keep "once" and "more than once".
Pass two emits only windows whose anchor the merged sketch puts at more than one place and
groups them, by 96 bits of the word sequence: every window but the first in the order of
(doc_id, start) is a repeat. A sketch that is too full lets more windows through; it loses none.

The merged sketch is broadcast. Its size follows the bytes of text, so that the share of cells in use stays the same. It has at
most 2 ** `most_bits` bits for each of its two rows (64 MB a row at the default); a corpus that needs more
is taken in ranges of anchor hashes, each with a sketch of its own and a pass over the texts that
looks at the windows of its range only. Passes are `ranges_for`(bytes): one up to about 6 GB of text at
the default, and half as many for each bit that executors have the memory for.

Hot windows: each task sends on only the first of equal windows that it sees, and tells the others
as runs of starts, so that a window in a third of all documents reaches the exact grouping as a few rows.

Defined results: a null text has no words. Rows that share doc_id and text are one document and
get the same result. Rows that share only doc_id are ordered by a hash of their text. A null
doc_id comes after all others, in the order of two hashes (128 bits) that tell such texts apart. All columns are kept; those named n_words, n_removed or kept are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.llm.common import WORDS, persist, slices, small_batches, utf8
from quillmine.llm.wordhash import mix, rolling, text_bytes, word_hashes, word_spans

LENGTH = 20
GRAM = 8
MOST_BITS = 29
#: Bytes of text for each cell of a row: there is an anchor in about 39 bytes, so about a quarter of the cells is in use.
BYTES_A_CELL = 11
ROWS = 2
_CHUNK = 1 << 20
_SHARD = 16
_FLUSH = 400_000
_SLICE = 2 << 20
_U = np.uint64


def _anchors(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start, the place of the leftmost smallest of `span` consecutive hashes, and that hash without its low bits."""
    bits = _U(22)
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, low = 1, keys
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = span - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & _U((1 << 22) - 1)).astype(np.int64), low >> bits


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchor ^ _U(0xA5A5A5A5 + 977 * row)) >> _U(64 - bits)


def _range(anchor: np.ndarray, ranges: int) -> np.ndarray:
    """The range of hashes that an anchor is in, from other bits than its cells."""
    return (mix(anchor ^ _U(0x5BD1E995)) >> _U(32)) * _U(ranges) >> _U(32)


def bits_for(n_bytes: int, most_bits: int = MOST_BITS) -> int:
    """Bits of a row's cell numbers: twice as many cells as BYTES_A_CELL asks for while there is one range."""
    return int(min(max(np.ceil(np.log2(max(1, 2 * n_bytes / BYTES_A_CELL))), 16), most_bits))


def ranges_for(n_bytes: int, most_bits: int = MOST_BITS) -> int:
    return max(1, int(np.ceil(n_bytes / (BYTES_A_CELL * 2**most_bits))))


def _chunks(words: np.ndarray, docs: np.ndarray, length: int):
    """First word, whether each window lies in one document, place and value of the anchors; chunks share length - 1 words."""
    gram = min(GRAM, length)
    for at in range(0, max(0, len(words) - length + 1), _CHUNK):
        w = words[at : at + _CHUNK + length - 1]
        d = docs[at : at + _CHUNK + length - 1]
        whole = d[: len(w) - length + 1] == d[length - 1 :]
        place, anchor = _anchors(rolling(w, gram, 11), length - gram + 1)
        yield at, whole, place, anchor


def _sketch(length: int, bits: int, ranges: int):
    """For each shard of cells, those that this task hit once and more than once, as two lists of 16-bit places. A range's shards follow those of the one before."""

    def flush(held):
        for row in range(ROWS):
            cells, counts = np.unique(np.concatenate([h[row] for h in held]), return_counts=True)
            shard = (cells >> _U(_SHARD)).astype(np.int64)
            place = (cells & _U(0xFFFF)).astype(np.uint16)
            more = counts > 1
            ids, starts = np.unique(shard, return_index=True)
            ends = np.append(starts[1:], len(shard))
            for lo in range(0, len(ids), 256):
                part = [(row, int(i), place[s:e].tobytes(), place[s:e][more[s:e]].tobytes()) for i, s, e in zip(ids[lo : lo + 256], starts[lo : lo + 256], ends[lo : lo + 256])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["row", "shard", "hit", "more"])

    def run(batches):
        held, n = [], 0
        for batch in slices(batches, "text", _SLICE):
            data, offsets = text_bytes(utf8(batch.column(0)))
            starts, ends, docs = word_spans(data, offsets)
            words = word_hashes(data, starts, ends, 1)
            for _, whole, place, anchor in _chunks(words, docs, length):
                place, anchor = place[whole], anchor[whole]
                chosen, first = np.unique(place, return_index=True)
                anchor = anchor[first]
                base = _range(anchor, ranges) << _U(bits)
                held.append([base + _cells(anchor, row, bits) for row in range(ROWS)])
                n += len(chosen)
            if n > 2_000_000:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _merge_shards(batches):
    """One bitmap a shard: cells hit by more than one task, or more than once by one. Rows come sorted by row and shard, so one shard's counts are held at a time."""
    counts, now, out = np.zeros(1 << _SHARD, np.uint8), None, []

    def give():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], ["row", "shard", "bitmap"])

    for batch in batches:
        for row, shard, hits, more in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (row, shard):
                if now is not None and counts.max() > 1:
                    out.append((*now, np.packbits(counts > 1, bitorder="little").tobytes()))
                    if len(out) == 64:
                        yield give()
                        out = []
                now = (row, shard)
                counts[:] = 0
            place = np.frombuffer(hits, np.uint16)
            counts[place] = np.minimum(counts[place] + 1, 2)
            counts[np.frombuffer(more, np.uint16)] = 2
    if now is not None and counts.max() > 1:
        out.append((*now, np.packbits(counts > 1, bitorder="little").tobytes()))
    if out:
        yield give()


def sketches(texts: DataFrame, length: int = LENGTH, most_bits: int = MOST_BITS):
    """For each range of anchors its number, the number of ranges, the merged sketch (for each row a bitmap of the cells with an estimate above one) and its bits."""
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, ranges = bits_for(n_bytes, most_bits), ranges_for(n_bytes, most_bits)
    parts = texts.mapInArrow(_sketch(length, bits, ranges), "row int, shard long, hit binary, more binary")
    merged = parts.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(_merge_shards, "row int, shard long, bitmap binary")
    if ranges > 1:
        merged = persist(merged, "sketch")
    shards = 1 << (bits - _SHARD)
    for k in range(ranges):
        maps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
        for r in merged.where(F.col("shard").between(k * shards, (k + 1) * shards - 1)).toLocalIterator():
            at = r.shard - k * shards
            maps[r.row][at << (_SHARD - 3) : (at + 1) << (_SHARD - 3)] = np.frombuffer(r.bitmap, np.uint8)
        yield k, ranges, maps, bits


def _windows(maps, bits: int, length: int, part: int = 0, ranges: int = 1):
    """Windows with an estimate above one: the first of those that are equal here with its hash, the others as runs of starts."""

    def emit(held):
        h1, h2, doc, null, text, start = (np.concatenate([h[i] for h in held]) for i in range(6))
        order = np.lexsort((start, text, doc, null, h2, h1))
        again = np.zeros(len(order), bool)
        again[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        # An equal window of the same document at the same start is the same window (a repeated row).
        same = np.zeros(len(order), bool)
        same[1:] = again[1:] & (doc[order][1:] == doc[order][:-1]) & (null[order][1:] == null[order][:-1]) & (text[order][1:] == text[order][:-1]) & (start[order][1:] == start[order][:-1])
        lead = np.maximum.accumulate(np.where(~again, np.arange(len(order)), 0))
        head = same & (doc[order] == doc[order][lead]) & (null[order] == null[order][lead]) & (text[order] == text[order][lead]) & (start[order] == start[order][lead])
        first, rest = order[~again], np.sort(order[again & ~head & ~same])
        run = np.ones(len(first), np.int32)
        if len(rest):
            o = np.lexsort((start[rest], text[rest], doc[rest], null[rest]))
            rest = rest[o]
            new = np.ones(len(rest), bool)
            new[1:] = (doc[rest][1:] != doc[rest][:-1]) | (null[rest][1:] != null[rest][:-1]) | (text[rest][1:] != text[rest][:-1]) | (start[rest][1:] != start[rest][:-1] + 1)
            at = np.flatnonzero(new)
            run = np.concatenate([run, np.diff(np.append(at, len(rest))).astype(np.int32)])
            rest = rest[at]
        pick = np.concatenate([first, rest])
        later = np.arange(len(pick)) >= len(first)
        for lo in range(0, len(pick), 100_000):
            p, late = pick[lo : lo + 100_000], later[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(late, mix(h1[p] ^ mix(doc[p].view(np.uint64)) ^ start[p].astype(np.uint64)), h1[p]).view(np.int64)),
                    pa.array(h2[p]),
                    pa.array(doc[p]),
                    pa.array(null[p]),
                    pa.array(text[p]),
                    pa.array(start[p]),
                    pa.array(run[lo : lo + 100_000]),
                    pa.array(late),
                ],
                ["h1", "h2", "own", "none", "text_key", "start", "run", "later"],
            )

    def run(batches):
        bitmaps, held, n = maps.value, [], 0
        for batch in slices(batches, "text", _SLICE):
            ids, null = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "none"))
            key = batch.column("text_key").to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(utf8(batch.column("text")))
            starts, ends, docs = word_spans(data, offsets)
            words, second = word_hashes(data, starts, ends, 1), None
            first_word = np.searchsorted(docs, np.arange(len(ids)))
            for at, whole, _, anchor in _chunks(words, docs, length):
                hot = whole if ranges == 1 else whole & (_range(anchor, ranges) == part)
                for row in range(ROWS):
                    cell = _cells(anchor, row, bits)
                    hot = hot & ((bitmaps[row][cell >> _U(3)] >> (cell & _U(7)).astype(np.uint8)) & 1).astype(bool)
                at_hot = np.flatnonzero(hot)
                if not len(at_hot):
                    continue
                if second is None:
                    second = word_hashes(data, starts, ends, 2)
                stop = at + len(whole) + length - 1
                h1 = rolling(words[at:stop], length, 21)[at_hot]
                h2 = (rolling(second[at:stop], length, 22)[at_hot] >> _U(32)).astype(np.uint32).view(np.int32)
                d = docs[at + at_hot]
                held.append((h1, h2, ids[d], null[d], key[d], (at + at_hot - first_word[d]).astype(np.int32)))
                n += len(at_hot)
            if n > _FLUSH:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _named(docs: DataFrame) -> DataFrame:
    """docs with __none (no doc_id), __own (doc_id, or a second hash of the text where there is none) and __key (a hash of the text)."""
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.md5("text"))).otherwise(F.col("doc_id").cast("long"))
    return docs.select("*", F.col("doc_id").isNull().alias("__none"), own.alias("__own"), F.xxhash64("text").alias("__key"))


def passed_windows(docs: DataFrame, length: int = LENGTH, most_bits: int = MOST_BITS) -> DataFrame:
    """The windows that the sketch puts at more than one place: of equal ones in a task the first, the others as runs of starts (later)."""
    docs = small_batches(docs).select("doc_id", "text").where("text is not null")
    keyed = _named(docs).select(F.col("__own").alias("own"), F.col("__none").alias("none"), F.col("__key").alias("text_key"), "text")
    windows = None
    for part, ranges, maps, bits in sketches(docs.select("text"), length, most_bits):
        shared = docs.sparkSession.sparkContext.broadcast(maps)
        found = keyed.mapInArrow(_windows(shared, bits, length, part, ranges), "h1 long, h2 int, own long, none boolean, text_key long, start int, run int, later boolean")
        if ranges > 1:  # a range's windows are written, so that one sketch is held at a time
            found = persist(found, "windows")
            shared.destroy()
        windows = found if windows is None else windows.unionByName(found)
    return windows


def repeated_starts(docs: DataFrame, length: int = LENGTH, most_bits: int = MOST_BITS) -> DataFrame:
    """For each document (none, own, text_key) with a repeated window, the runs of starts of those windows."""
    # Rows of one document at one start are one window; a dense rank keeps repeated rows together.
    order = Window.partitionBy("h1", "h2").orderBy("none", "own", "text_key", "start")
    ranked = passed_windows(docs, length, most_bits).withColumn("place", F.dense_rank().over(order)).where("later or place > 1")
    return ranked.groupBy("none", "own", "text_key").agg(F.collect_list("start").alias("starts"), F.collect_list("run").alias("runs"))


def _kept(length: int, keep: list[str]):
    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            out = []
            for text, starts, runs in zip(texts, batch.column("__starts").to_pylist(), batch.column("__runs").to_pylist()):
                words = WORDS.findall(text) if text else []
                if not starts:
                    out.append((len(words), 0, " ".join(words)))
                    continue
                cover = np.zeros(len(words) + 1, np.int32)
                begin = np.array(starts)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + np.array(runs) - 1 + length, -1)
                stay = np.cumsum(cover[:-1]) == 0
                left = [words[i] for i in np.flatnonzero(stay)]
                out.append((len(words), len(words) - len(left), " ".join(left)))
            n, removed, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*keep, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, most_bits: int = MOST_BITS) -> DataFrame:
    """All columns of docs with n_words, n_removed and kept: the words that no repeated window covers, joined by one space."""
    repeats = repeated_starts(docs, length, most_bits)
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    left = _named(docs.select(*keep)).alias("d")
    right = repeats.select(*(F.col(c).alias(f"__r_{c}") for c in repeats.columns))
    joined = left.join(right, (F.col("__none") == F.col("__r_none")) & (F.col("__own") == F.col("__r_own")) & (F.col("__key") == F.col("__r_text_key")), "left")
    joined = joined.select(*(F.col(f"d.`{c}`") for c in keep), F.col("__r_starts").alias("__starts"), F.col("__r_runs").alias("__runs"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_words long, n_removed long, kept string"
    return joined.mapInArrow(_kept(length, keep), schema)
