"""Hashes of words and word windows for whole Arrow slices, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all (splitmix's finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=4)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A table of random values of bytes; powers of an odd base and of its inverse."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 1 << 64, 256, dtype=np.uint64)
    base = int(rng.integers(1, 1 << 62, dtype=np.uint64)) * 8 + 3
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(BLOCK + 1, np.uint64), np.ones(BLOCK + 1, np.uint64)
    up[1:] = np.multiply.accumulate(np.full(BLOCK, base % (1 << 64), np.uint64))
    down[1:] = np.multiply.accumulate(np.full(BLOCK, inverse, np.uint64))
    return values, up, down, base


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the place where each text starts (and the last ends)."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    edges = np.unique(offsets[1:-1])
    edges = edges[(edges > 0) & (edges < n)]
    head[edges] = inside[edges]
    tail[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each word, equal for equal words. Works block by block, so memory stays bounded."""
    values, up, down, base = _powers(seed)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))
        last = int(ends[stop - 1])
        if last - first > BLOCK:  # one word longer than a block
            total, power = 0, 1
            for b in range(first, last, BLOCK):
                piece = data[b : min(b + BLOCK, last)]
                total = (total + power * int((values[piece] * up[: len(piece)]).sum(dtype=np.uint64))) % (1 << 64)
                power = power * pow(base, BLOCK, 1 << 64) % (1 << 64)
            out[at] = total
        else:
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(values[data[first:last]] * up[: last - first], out=sums[1:])
            s = starts[at:stop] - first
            out[at:stop] = (sums[ends[at:stop] - first] - sums[s]) * down[s]
        at = stop
    return mix(out ^ ((ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))


def rolling(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each run of `length` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = _U(mix(np.array([seed], np.uint64))[0] | _U(1))
    acc = words[:n].copy()
    for k in range(1, length):
        acc *= factor
        acc += words[k : n + k]
    return mix(acc)
