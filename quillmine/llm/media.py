"""Media columns: byte payloads kept as lossless WebP images, read back as pixel arrays with features.

A payload is the UTF-8 text and zero bytes up to a positive multiple of 64. It becomes the green channel
of an image, 64 samples a row (more rows than the format allows make the rows wider, and the
last row is filled up). Lines that occur again are stored as back-references, unless a palette or a prediction of
samples makes the image smaller. A payload over FILE_BYTES becomes several files one after the other; their samples, read in
rows as wide as the first file's, are one pixel array.

Defined results: a null text is empty, and an empty text is 64 zero bytes. Repeated rows and null ids are kept. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmine.llm import webp
from quillmine.llm.common import slices, small_batches, utf8

ROW = 64
LEAST_LINE = 24
MOST_COPY = 4096
MOST_DISTANCE = (1 << 20) - 120
FILE_BYTES = 1 << 27


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW or (0 if text else ROW))


def row_width(size: int) -> int:
    return ROW * max(1, -(-size // (ROW * webp.LARGEST_SIDE)))


def line_copies(data: bytes) -> list[tuple[int, int, int]]:
    """Lines of LEAST_LINE bytes or more that occurred before, as (place, length, distance)."""
    out, seen, at = [], {}, 0
    for line in data.split(b"\n"):
        if len(line) >= LEAST_LINE:
            before = seen.get(line)
            if before is not None and at - before <= MOST_DISTANCE:
                out += [(at + k, min(MOST_COPY, len(line) - k), at - before) for k in range(0, len(line), MOST_COPY)]
            seen[line] = at
        at += len(line) + 1
    return out


def store(data: bytes) -> bytes:
    """The image file of a payload, or its files."""
    width = row_width(min(len(data), FILE_BYTES))
    out = []
    for at in range(0, len(data), FILE_BYTES):
        part = data[at : at + FILE_BYTES]
        out.append(webp.encode_grey(part + bytes(-len(part) % width), width, line_copies(part)))
    return b"".join(out)


def load(media: bytes) -> np.ndarray:
    """The samples (height, width) of a stored payload."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        parts.append((webp.decode(media[at : at + size]) >> np.uint32(8)).astype(np.uint8))
        at += size
    return np.concatenate(parts)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, mean step along rows and columns, and a histogram of 16 bins, of the samples."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    n = counts.sum()
    share = counts[counts > 0] / n
    values = np.arange(256)
    mean = (counts * values).sum() / n
    deviation = np.sqrt(max(0.0, (counts * values * values).sum() / n - mean * mean))
    wide = samples.astype(np.int16)
    along = np.abs(wide[:, 1:] - wide[:, :-1]).mean()
    down = np.abs(wide[1:] - wide[:-1]).mean() if len(wide) > 1 else 0.0
    bins = ",".join(f"{x:.4f}" for x in counts.reshape(16, 16).sum(axis=1) / n)
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};along={along:.4f};down={down:.4f};hist={bins}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and media (the file) of every row."""

    def run(batches):
        for batch in slices(batches):
            texts = utf8(batch.column("text")).cast(pa.binary()).to_pylist()
            data = [payload(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, data)), pa.int64()), pa.array(list(map(store, data)), pa.binary())],
                ["doc_id", "n_bytes", "payload_bytes", "media"],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, media binary")


def decode_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media, and what is read back: width, height, samples (the payload) and feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "media"]
    extra = ["width", "height", "samples", "feature"]

    def run(batches):
        for batch in slices(batches, "media"):
            rows = []
            for media, size in zip(batch.column("media").to_pylist(), batch.column("payload_bytes").to_pylist()):
                image = load(media)
                rows.append((image.shape[1], image.shape[0], image.tobytes()[:size], feature(image)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.string())))], [*names, *extra])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.select(*names).schema)
    return stored.select(*names).mapInArrow(run, f"{schema}, width int, height int, samples binary, feature string")
