"""Burrows-Wheeler transforms of shards of byte strings, and their merge by iterative interleave refinement.

A suffix starts at any byte and is read in symbols of `gram` bytes, so the symbol before the one at place i is that at
i - gram. Symbols are numbered exactly (by their bytes, with hashes only as sort keys). A shard's transform is its suffixes
in order, the symbol before each, and the place in that order of the suffix that starts one symbol earlier.

The merge never sorts suffixes of different shards against each other. It starts from the shards one after the other and
refines the interleave: going through the suffixes in the order by their first k symbols, each hands the suffix one symbol
earlier to the bucket of that symbol, which gives the order by k + 1. Neighbours of a bucket whose followers were in
different blocks part, so the round in which two neighbours part is their common prefix in symbols. After `depth`
rounds blocks are the intervals of suffixes that share `depth` symbols. A suffix that is alone in its block is settled, and so
is all that precedes it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from quillmine.llm.wordhash import mix

_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def _offsets(gram: int) -> tuple[int, list[int]]:
    """Bytes of a word, and where words must start to cover a gram."""
    if gram < 8:
        return 1, list(range(gram))
    return 8, [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]


def _words(data: np.ndarray, width: int) -> np.ndarray:
    """The little-endian number at each byte."""
    if width == 1:
        return data
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,)).astype(_U)


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """64 bits for the `gram` bytes at each place."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, _U)
    width, at = _offsets(gram)
    words = mix(_words(data, width).astype(_U))
    out = words[:n].copy()
    for k in at[1:]:
        out *= _U(0x9E3779B97F4A7C15)
        out += words[k : k + n]
        out ^= out >> _U(29)
    return mix(out)


def symbol_numbers(data: np.ndarray, places: np.ndarray, gram: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """A number for the gram at each place, equal for equal bytes only."""
    if not len(places):
        return np.zeros(0, np.int64)
    keys = (grams(data, gram) if hashes is None else hashes)[places]
    order = np.argsort(keys)
    width, at = _offsets(gram)
    words = _words(data, width)
    put = places[order]
    same = keys[order][1:] == keys[order][:-1]
    where = np.flatnonzero(same)
    unlike = np.zeros(len(where), bool)
    for k in at:
        unlike |= words[put[where] + k] != words[put[where + 1] + k]
    if unlike.any():  # two grams with one hash: number them by their bytes
        order = np.lexsort([words[places + k] for k in at])
        put = places[order]
        same = np.ones(len(places) - 1, bool)
        for k in at:
            same &= words[put[1:] + k] == words[put[:-1] + k]
    number = np.empty(len(places), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], ~same]))
    return number


class Transform(NamedTuple):
    """For each suffix in order: its first symbol, the symbol before it (-1: none), the place in this order of the suffix one symbol earlier (-1: none), and where it starts."""

    first: np.ndarray
    before: np.ndarray
    previous: np.ndarray
    start: np.ndarray


def shard_transform(symbols: np.ndarray, starts: np.ndarray, follow: np.ndarray, depth: int) -> Transform:
    """The transform of one shard. symbols: numbers of its suffixes' first symbols; follow: for each suffix the number of the one a symbol further on, or -1 at the end of a string."""
    rank, step, width = symbols, follow, 1
    while width < depth:
        key = (rank.astype(_U) << _U(32)) | np.where(step >= 0, rank[step] + 1, 0).astype(_U)
        order = np.argsort(key)
        put = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], put[1:] != put[:-1]]))
        step = np.where(step >= 0, step[step], -1)
        width *= 2
    key = (rank.astype(_U) << _U(32)) | np.arange(len(rank), dtype=_U)
    order = (np.sort(key) & _LOW).astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    back = np.full(len(order), -1, np.int64)
    has = np.flatnonzero(follow >= 0)
    back[follow[has]] = has
    back = back[order]
    none = back < 0
    return Transform(symbols[order], np.where(none, -1, symbols[back]), np.where(none, -1, place[back]), starts[order])


def _alone(block: np.ndarray) -> np.ndarray:
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    last = np.ones(len(block), bool)
    last[:-1] = new[1:]
    return new & last


def merged_intervals(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes that share at least `depth` symbols with another, in merged order, and the number of each one's interval."""
    base = np.cumsum([0, *(len(s.first) for s in shards)])
    first = np.concatenate([s.first for s in shards])
    before = np.concatenate([s.before for s in shards])
    previous = np.concatenate([np.where(s.previous >= 0, s.previous + b, -1) for s, b in zip(shards, base)])
    slots, block = np.arange(len(first)), np.zeros(len(first), np.int64)
    symbol = first
    for level in range(depth):
        if level:
            symbol = before[slots]
            has = symbol >= 0
            slots, block, symbol = previous[slots[has]], block[has], symbol[has]
        key = (symbol.astype(_U) << _U(32)) | np.arange(len(slots), dtype=_U)
        key.sort()
        order = (key & _LOW).astype(np.int64)
        slots, block, symbol = slots[order], block[order], (key >> _U(32)).astype(np.int64)
        part = np.zeros(len(slots), bool)
        part[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(part)
        stay = ~_alone(block)
        slots, block = slots[stay], block[stay]
    return np.concatenate([s.start for s in shards])[slots], block
