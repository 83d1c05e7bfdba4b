"""Minimum bin slack packing of token pieces into sequences.

Documents are tokenized whole, closed by an end token, and only longer ones are cut into pieces
of the sequence length. What matters for packing is the number of pieces of each length, at most
`capacity` numbers, and those alone go to the driver. There each bin is filled by a subset-sum
dynamic programme over the available lengths: a bitset of reachable sums finds the fullest feasible
combination that holds the longest piece left, and that combination is removed, at once as often as
the counts allow. Every combination uses up a length, so there are at most `capacity` of them
whatever the input. Pieces of one length are then numbered and dealt to the places of that length.

Defined results: a null text is empty and gives one piece, the end token. Repeated rows are packed each time;
rows with a null doc_id too. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.llm.common import persist, slices, small_batches, utf8
from quillmine.llm.ranks import ranked
from quillmine.llm.wordhash import text_bytes

CAPACITY = 2048
#: Documents that are packed together where their order counts; a task holds their pieces, without ids.
SEGMENT_ROWS = 50_000
END = 0
TOKENIZER = "word_bpe_49k.json"
#: Pieces in each of the two generations that a worker remembers; bounds memory, not results.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: What ends a word's last token in the vocabulary.
WORD_END = "</w>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Texts of white space, ASCII signs, letters and digits, and the letters U+00C0 to U+017F alone are plain: the tokenizer lowers them, then takes letters,
# single digits and runs of signs. They have no combining marks, and all their lower-case forms but that of U+0130 have as many bytes.
_SPACE, _SIGN, _DIGIT, _LETTER, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0x80:0xC0] = _KIND[0xC3:0xC6] = _LETTER
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_SMALL_FORM = np.array([ord(chr(c).lower()[0]) for c in range(0x180)], np.uint16)
#: Ends that the tokenizer takes together with the apostrophe before them.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text is plain and without the beginning of a special token."""
    after = np.append(data[1:], np.uint8(0))
    odd = (_KIND[data] == _OTHER) | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data == 0xC4) & (after == 0xB0)) | ((data == 60) & (after == 124))
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = False
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain texts in lower case, and the start and end of each piece that the tokenizer encodes by itself."""
    data = _SMALL[data]
    lead = np.flatnonzero(data >= 0xC3)
    code = _SMALL_FORM[((data[lead].astype(np.uint16) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    data[lead], data[lead + 1] = 0xC0 | (code >> 6), 0x80 | (code & 0x3F)
    kind = _KIND[data]
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    texts = np.zeros(len(data) + 1, bool)
    texts[offsets] = True
    begins |= texts[:-1]
    mark = np.flatnonzero((data == 39) & begins)
    padded = np.append(data, np.zeros(3, np.uint8))
    edge = np.append(texts, np.ones(3, bool))
    for end in _CONTRACTIONS:
        found = np.ones(len(mark), bool)
        for k, c in enumerate(end.encode(), 1):
            found &= (padded[mark + k] == c) & ~edge[mark + k]
        own = mark[found]
        begins[own + 1] = False
        rest = own + len(end) + 1
        begins[rest[rest < len(data)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    word = kind[starts] != _SPACE
    return data, starts[word], ends[word]


class Encoder:
    """Ids of texts by the ids of their pieces. Unknown pieces are encoded together; other texts than plain ones whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode_pieces(self, words: list[str]) -> list[bytes]:
        """The ids of each piece: those of all of them in one text, cut where a word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        held = ids.astype("<u4").tobytes()
        return [held[a:b] for a, b in zip([0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist())]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pieces, four little-endian bytes each."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        unknown = []
        for i in missing:
            x = found[i] = old.get(words[i])
            if x is None:
                unknown.append(i)
        for i, x in zip(unknown, self._encode_pieces([words[i] for i in unknown]) if unknown else ()):
            found[i] = x
        young.update((words[i], found[i]) for i in missing if len(words[i]) <= LONGEST_REMEMBERED)
        return found

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        data, starts, ends = cut(data, offsets)
        size = ends - starts
        place = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=place[1:])
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(place), pa.py_buffer(data[_KIND[data] != _SPACE])).dictionary_encode()
        ids = self.ids_of(pieces.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(length) - length
        table = np.frombuffer(b"".join(ids), "<u4")
        which = pieces.indices.to_numpy()
        n = length[which]
        begin = np.cumsum(n) - n
        out = table[np.repeat(first[which] - begin, n) + np.arange(int(n.sum()))] if len(which) else table
        edges = np.append(begin, len(out))[np.searchsorted(starts, offsets)]
        return [out[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, text: pa.Array, end: int = END) -> list[np.ndarray]:
        """The ids of each text and the end token."""
        data, offsets = text_bytes(utf8(text))
        plain = plain_texts(data, offsets)
        size = np.diff(offsets)
        kept = np.concatenate([[0], np.cumsum(size[plain])])
        own = iter(self._plain(data if plain.all() else data[np.repeat(plain, size)], kept))
        odd = text.filter(pa.array(~plain)).to_pylist()
        others = (np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in odd)
        last = np.array([end], np.uint32)
        return [np.concatenate([next(own if p else others), last]) for p in plain]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, copy: Column | None = None) -> DataFrame:
    """One row a piece: doc_id, copy (tells repeated rows apart; a number of one's own if given), piece, start, length, ids_crc32, and ids if asked for."""
    path = path or tokenizer_path()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, copy long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for batch in slices(batches):
            row, piece, length, crc, ids = [], [], [], [], []
            for i, stream in enumerate(_encoder(path).encode(utf8(batch.column("text")), end)):
                stream = stream.astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(stream), 4 * capacity)):
                    part = stream[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            number = np.array(piece, np.int32)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int32())), batch.column("copy").take(pa.array(row, pa.int32())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    number = F.monotonically_increasing_id() if copy is None else copy.cast("long")
    return small_batches(docs).select("doc_id", number.alias("copy"), "text").mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length and, of the rest, the combination whose sum comes nearest to the capacity; fewer and longer pieces first."""
    longest = max(counts)
    room, target = capacity - longest, 0
    steps: list[tuple[int, int, int]] = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        chunk = 1
        while left > 0:
            take = min(chunk, left)
            grown = (reach | (reach << (length * take))) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
                if reach >> room & 1:
                    break
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    used = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            target -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins use each."""
    left = {k: n for k, n in counts.items() if n > 0}
    out = []
    while left:
        used = fullest(left, capacity)
        bins = min(left[k] // n for k, n in used.items())
        out.append((used, bins))
        for k, n in used.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
    return out


def _places(combinations: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, its runs of places: first rank, first sequence, pieces a bin, first offset."""
    runs: dict[int, list] = {}
    seen: dict[int, int] = {}
    first = 0
    for used, bins in combinations:
        offset = 0
        for length in sorted(used, reverse=True):
            runs.setdefault(length, []).append((seen.get(length, 0), first, used[length], offset))
            seen[length] = seen.get(length, 0) + used[length] * bins
            offset += used[length] * length
        first += bins
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def _dealt(table: dict[int, tuple[np.ndarray, ...]], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, by their rank among those of their length."""
    sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    order = np.argsort(length, kind="stable")
    kinds, starts = np.unique(length[order], return_index=True)
    for k, own in zip(kinds, np.split(order, starts[1:])):
        first, base, each, at = table[int(k)]
        run_no = np.searchsorted(first, rank[own], side="right") - 1
        inside = rank[own] - first[run_no]
        sequence[own] = base[run_no] + inside // each[run_no]
        offset[own] = at[run_no] + inside % each[run_no] * int(k)
    return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 2_000) -> DataFrame:
    """parts (length and any columns) with sequence_id and offset. parts must give the same rows each time; a written table does."""
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = parts.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacity)))
    buckets = int(max(64, sum(histogram.values()) // bucket_rows // 8))
    rows = ranked(parts, ["length"], [F.col("copy"), F.col("piece")], F.struct("copy", "piece"), buckets, "__rank")
    names = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset int"

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
                sequence, offset = _dealt(places.value, length, rank.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset, pa.int32())], [*names, "sequence_id", "offset"])

    return rows.select(*names, "__rank").mapInArrow(run, schema)


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs with __place, the number of each row in the order in which its table was written; what doesn't come from files is written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = persist(docs, "in-order")
    laid = docs.select(*docs.columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = laid.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))  # a row a file; names of part files sort as they were written
    before = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = persist(sizes.select(F.col("__file").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "file-starts")
    return laid.join(starts, F.col("__file") == F.col("__of")).select(*docs.columns, (F.col("__start") + F.col("__row")).alias("__place"))


def pack_in_order(parts: DataFrame, capacity: int = CAPACITY, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """As `pack`, but sequences follow the documents' places (copy): each run of `segment_rows` documents is packed by itself, in one task, and its sequences are numbered before those of the next."""
    names = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset int"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("copy", "ascending"), ("piece", "ascending")])
        length = table.column("length").to_numpy()
        kinds, counts = np.unique(length, return_counts=True)
        order = np.argsort(length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
        sequence, offset = _dealt(_places(plan(dict(zip(kinds.tolist(), counts.tolist())), capacity)), length, rank)
        segment = table.column("__segment")[0].as_py()
        return pa.table([*(table.column(c) for c in names), pa.array(sequence + (segment << 32)), pa.array(offset, pa.int32())], names=[*names, "sequence_id", "offset"])

    return parts.withColumn("__segment", F.floor(F.col("copy") / segment_rows).cast("long")).groupBy("__segment").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack all documents; the pieces are written to the shared folder, so that each is tokenized once."""
    return pack(persist(pieces(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)


def pack_documents_in_order(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """`pack_in_order` of all documents in the order in which they were written."""
    return pack_in_order(persist(pieces(in_file_order(docs.select("doc_id", "text")), path, capacity, copy=F.col("__place")), "pieces"), capacity, segment_rows)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: their pieces in order, and the ids one after another (at most the capacity)."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("inside")).select(
        "sequence_id",
        F.transform("inside", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.offset.alias("offset"))).alias("pieces"),
        F.aggregate(F.transform("inside", lambda x: x.ids), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"),
    )
