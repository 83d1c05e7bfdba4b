"""Lossless WebP images in numpy: a decoder for the whole format, and an encoder.

The decoder reads the container, the transforms (predictor, cross-colour, subtract green, palette with
bundled pixels), the colour cache, groups of prefix codes chosen by an entropy image, and back-references,
and gives the pixel array. Streams with one group of codes and no colour cache are decoded for all bit positions at
once: each position's symbol and next position come from a table, the chain of true positions from
doubled steps. Other streams are decoded symbol by symbol.

Pixels are 32-bit numbers: alpha, red, green, blue from the high byte down.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

#: The order in which lengths of the code for code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
MOST_LENGTH = 15
LARGEST_SIDE = 1 << 14
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Bits of a stream that are looked at together; bounds the memory of a long image.
WINDOW = 1 << 20


@lru_cache(maxsize=1)
def near_places() -> tuple[tuple[int, int], ...]:
    """The 120 places (dx, dy) of short distance codes: by distance, then by |dx|, right of the pixel before left of it."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))


# Prefix codes ---------------------------------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], most: int = MOST_LENGTH) -> dict[int, int]:
    """Code lengths of at most `most` bits, by pairing the rarest; counts are flattened until the lengths fit."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    while True:
        heap = [(n, s, None) for s, n in counts.items()]
        heapq.heapify(heap)
        fresh = 1 << 20
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], fresh, (a, b)))
            fresh += 1
        lengths, todo = {}, [(heap[0], 0)]
        while todo:
            (_, symbol, kids), depth = todo.pop()
            if kids is None:
                lengths[symbol] = depth
            else:
                todo += ((kids[0], depth + 1), (kids[1], depth + 1))
        if max(lengths.values()) <= most:
            return lengths
        counts = {s: (n + 1) // 2 for s, n in counts.items()}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each symbol its code, first bit lowest, and its length."""
    out, code, last = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in lengths.items() if n):
        code <<= length - last
        out[symbol] = (int(format(code, f"0{length}b")[::-1], 2), length)
        code, last = code + 1, length
    return out


class Code:
    """Decoding table of a prefix code: symbol and length for the next `bits` bits of the stream."""

    __slots__ = ("bits", "symbols", "sizes", "only")

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code is empty")
        if len(used) == 1:
            self.only, self.bits = int(used[0]), 0
            self.symbols, self.sizes = used.astype(np.int32), np.zeros(1, np.int32)
            return
        self.only = None
        sizes = lengths[used]
        order = np.argsort(sizes, kind="stable")
        used, sizes = used[order], sizes[order]
        bits = int(sizes[-1])
        spans = np.left_shift(1, bits - sizes)
        if int(spans.sum()) != 1 << bits:
            raise ValueError("a prefix code is not complete")
        back = _reversed(bits)
        self.bits = bits
        self.symbols = np.repeat(used, spans).astype(np.int32)[back]
        self.sizes = np.repeat(sizes, spans).astype(np.int32)[back]


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """Each number below 2 ** bits with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for k in range(bits):
        out = np.concatenate([out, out | (1 << (bits - 1 - k))])
    return out


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and extra bits of a length or distance code, 1 or more."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, high - 1, value & ((1 << (high - 1)) - 1)


# Reading --------------------------------------------------------------------------------------------------------------


class Bits:
    """Bits of a byte string, lowest first; zeros after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.size + 64:
            raise ValueError("the stream ends early")
        return value

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        k = self.peek() & ((1 << code.bits) - 1)
        self.at += int(code.sizes[k])
        if self.at > self.size + 64:
            raise ValueError("the stream ends early")
        return int(code.symbols[k])

    def value(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.take(extra) + 1


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.take(1):
        two = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for k in range(4 + bits.take(4)):
        own[LENGTH_ORDER[k]] = bits.take(3)
    inner = Code(own)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    symbols, sizes, width, data = inner.symbols.tolist(), inner.sizes.tolist(), (1 << inner.bits) - 1, bits.data
    at, k, last, pos = bits.at, 0, 8, []
    while k < alphabet and left:
        left -= 1
        window = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        i = window & width
        s, n = symbols[i], sizes[i]
        at += n
        if s < 16:
            if s:
                pos.append((k, s))
                last = s
            k += 1
        else:
            window >>= n
            if s == 16:
                again = 3 + (window & 3)
                at += 2
                pos += [(k + j, last) for j in range(again)]
            elif s == 17:
                again = 3 + (window & 7)
                at += 3
            else:
                again = 11 + (window & 127)
                at += 7
            k += again
            if k > alphabet:
                raise ValueError("too many code lengths")
    bits.at = at
    if pos:
        where, what = zip(*pos)
        lengths[list(where)] = what
    return Code(lengths)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels of an entropy-coded image, before any transform."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups, tile_bits = None, 0
    if main and bits.take(1):
        tile_bits = bits.take(3) + 2
        chosen = _read_image(bits, -(-width >> tile_bits), -(-height >> tile_bits), False)
        groups = (chosen >> 8 & 0xFFFF).reshape(-(-height >> tile_bits), -1)
    number = int(groups.max()) + 1 if groups is not None else 1
    codes = []
    for _ in range(number):
        codes.append([_read_code(bits, a + ((1 << cache_bits) if k == 0 and cache_bits else 0)) for k, a in enumerate(ALPHABETS)])
    if groups is None and not cache_bits:
        return _read_pixels_at_once(bits, width, height, codes[0])
    return _read_pixels_in_turn(bits, width, height, codes, cache_bits, groups, tile_bits)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = near_places()[code - 1]
    return max(1, dx + dy * width)


def _copy(pixels: np.ndarray, at: int, length: int, distance: int) -> None:
    if distance > at or at + length > len(pixels):
        raise ValueError("a back-reference leaves the image")
    if distance >= length:
        pixels[at : at + length] = pixels[at - distance : at - distance + length]
    else:
        pixels[at : at + length] = np.resize(pixels[at - distance : at], length)


def _read_pixels_in_turn(bits, width, height, codes, cache_bits, groups, tile_bits) -> np.ndarray:
    pixels, at, total = np.zeros(width * height, np.uint32), 0, width * height
    cache, shift = [0] * (1 << cache_bits if cache_bits else 0), 32 - cache_bits
    filled = 0  # pixels before this place are in the cache
    while at < total:
        own = codes[int(groups[(at // width) >> tile_bits, (at % width) >> tile_bits])] if groups is not None else codes[0]
        s = bits.symbol(own[0])
        if s < 256:
            red, blue, alpha = bits.symbol(own[1]), bits.symbol(own[2]), bits.symbol(own[3])
            pixels[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = bits.value(s - 256)
            _copy(pixels, at, length, _distance(bits.value(bits.symbol(own[4])), width))
            at += length
        else:
            for p in pixels[filled:at].tolist():
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            filled = at
            pixels[at] = cache[s - 280]
            at += 1
    return pixels


def _steps(data: np.ndarray, first: int, count: int, codes: list[Code]) -> tuple[np.ndarray, np.ndarray]:
    """For bit positions first .. first + count: the symbol of the first code there, and the position after a literal."""
    byte = first >> 3
    raw = data[byte : byte + (count + 7 >> 3) + 12].astype(np.uint32)
    n = len(raw) - 3
    words = raw[:n] | raw[1 : n + 1] << np.uint32(8) | raw[2 : n + 2] << np.uint32(16) | raw[3 : n + 3] << np.uint32(24)
    windows = (words[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)[first & 7 :]
    green = codes[0]
    if green.only is not None:
        symbols, after = np.full(count, green.only, np.int32), np.arange(count, dtype=np.int32)
    else:
        look = windows[:count] & np.uint32((1 << green.bits) - 1)
        symbols = green.symbols[look]
        after = np.arange(count, dtype=np.int32) + green.sizes[look]
    for code in codes[1:4]:
        if code.only is None:
            # Positions past the window are mended by the caller, which leaves a margin.
            at = np.minimum(after, len(windows) - 1)
            after = after + code.sizes[windows[at] & np.uint32((1 << code.bits) - 1)]
    return symbols, after


def _read_pixels_at_once(bits: Bits, width: int, height: int, codes: list[Code]) -> np.ndarray:
    total, pixels, at = width * height, np.zeros(width * height, np.uint32), 0
    if all(c.only is not None for c in codes[:4]) and codes[0].only < 256:
        pixels[:] = codes[3].only << 24 | codes[1].only << 16 | codes[0].only << 8 | codes[2].only
        return pixels
    margin = 64  # bits of one literal at most
    padded = np.concatenate([np.frombuffer(bits.data, np.uint8), np.zeros(64, np.uint8)])
    plain = all(c.only is not None for c in codes[1:4])
    while at < total:
        first = bits.at
        if first > bits.size:
            raise ValueError("the stream ends early")
        count = min(WINDOW, bits.size - first + margin + 8)
        symbols, one = _steps(padded, first, count, codes)
        stop = symbols >= 256  # copies end a run of literals, and so does the window's end
        stop[max(0, count - margin) :] = True
        one = np.where(stop, np.arange(count, dtype=np.int32), np.minimum(one, count - 1))
        two = one[one]
        four = two[two]
        eight = four[four]
        sixteen = memoryview(eight[eight])
        here = 0
        while at < total:
            coarse, p = [], here
            while (q := sixteen[p]) != p and len(coarse) << 4 < total - at:
                coarse.append(p)
                p = q
            if coarse:
                place = np.array(coarse, np.int32)
                for jump in (eight, four, two, one):
                    place = np.stack([place, jump[place]], axis=-1).reshape(-1)
                place = place[~stop[place]][: total - at]
                green = symbols[place].astype(np.uint32) << np.uint32(8)
                if plain:
                    pixels[at : at + len(place)] = green | np.uint32(codes[3].only << 24 | codes[1].only << 16 | codes[2].only)
                else:
                    pixels[at : at + len(place)] = green | _other_channels(padded, first, place, codes)
                at += len(place)
                here = int(one[place[-1]])
            if at == total:
                break
            if not stop[here]:
                continue
            if here >= count - margin:
                break
            bits.at = first + here
            s = bits.symbol(codes[0])
            if s >= 280:
                raise ValueError("a colour cache symbol without a cache")
            length = bits.value(s - 256)
            _copy(pixels, at, length, _distance(bits.value(bits.symbol(codes[4])), width))
            at += length
            here = bits.at - first
            if here >= count - margin:
                break
        if at < total and here == 0 and count < WINDOW:
            raise ValueError("the stream ends early")
        bits.at = first + here
    return pixels


def _other_channels(data: np.ndarray, first: int, place: np.ndarray, codes: list[Code]) -> np.ndarray:
    """Red, blue and alpha of the literals at the given positions."""
    at, out = place.astype(np.int64) + first, np.zeros(len(place), np.uint32)

    def window(p):
        b = p >> 3
        return (data[b].astype(np.uint32) | data[b + 1].astype(np.uint32) << np.uint32(8) | data[b + 2].astype(np.uint32) << np.uint32(16)) >> (p & 7).astype(np.uint32)

    if codes[0].only is None:
        at = at + codes[0].sizes[window(at) & np.uint32((1 << codes[0].bits) - 1)]
    for code, shift in zip(codes[1:4], (16, 0, 24)):
        if code.only is not None:
            out |= np.uint32(code.only << shift)
        else:
            look = window(at) & np.uint32((1 << code.bits) - 1)
            out |= code.symbols[look].astype(np.uint32) << np.uint32(shift)
            at = at + code.sizes[look]
    return out


# Transforms -----------------------------------------------------------------------------------------------------------


def _add(a, b):
    """Sum of two pixels, each channel modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    """The prediction of a pixel by one of the fourteen modes."""
    if mode == 0 or mode > 13:
        return OPAQUE
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    l, t, tl = _channels(left), _channels(top), _channels(top_left)
    if mode == 11:
        to_left = sum(abs(b - c) for b, c in zip(t, tl))
        to_top = sum(abs(a - c) for a, c in zip(l, tl))
        return left if to_left < to_top else top
    if mode == 12:
        return _joined([min(255, max(0, a + b - c)) for a, b, c in zip(l, t, tl)])
    mid = _channels(_average(left, top))
    return _joined([min(255, max(0, a + int((a - c) / 2))) for a, c in zip(mid, tl)])


def _prediction(rows, x: int, y: int, width: int, mode: int) -> int:
    if y == 0:
        return OPAQUE if x == 0 else rows[0][x - 1]
    if x == 0:
        return rows[y - 1][0]
    right = rows[y - 1][x + 1] if x + 1 < width else rows[y][0]
    return predict(mode, rows[y][x - 1], rows[y - 1][x], right, rows[y - 1][x - 1])


def _undo_sums(pixels: np.ndarray, width: int, height: int, mode: int) -> np.ndarray:
    """Where every tile predicts by the left (1) or the upper (2) pixel, the pixels are running sums of each channel."""
    parts = pixels.astype("<u4").view(np.uint8).reshape(height, width, 4).copy()
    parts[0, 0, 3:] += np.uint8(255)  # the first pixel is predicted opaque
    if mode == 1:
        parts[:, 0] = np.cumsum(parts[:, 0], axis=0, dtype=np.uint8)
        parts = np.cumsum(parts, axis=1, dtype=np.uint8)
    else:
        parts[0] = np.cumsum(parts[0], axis=0, dtype=np.uint8)
        parts = np.cumsum(parts, axis=0, dtype=np.uint8)
    return np.ascontiguousarray(parts).view("<u4").reshape(-1)


def _undo_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    kinds = np.unique(modes >> 8 & 255)
    if len(kinds) == 1 and kinds[0] in (1, 2):
        return _undo_sums(pixels, width, height, int(kinds[0]))
    rest = pixels.reshape(height, width).tolist()
    rows = [[0] * width for _ in range(height)]
    tiles = (modes >> 8 & 255).reshape(-(-height >> bits), -1).tolist()
    for y in range(height):
        line = tiles[y >> bits]
        for x in range(width):
            rows[y][x] = _add(rest[y][x], _prediction(rows, x, y, width, line[x >> bits]))
    return np.array(rows, np.uint32).reshape(-1)


def _cross(pixels: np.ndarray, width: int, height: int, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Cross-colour deltas added (sign 1, undo) or taken away (sign -1)."""
    tiles = elements.reshape(-(-height >> bits), -1)
    own = np.repeat(np.repeat(tiles, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width].reshape(-1)

    def signed(v):
        return (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)

    def delta(t, c):
        return signed(t) * signed(c) >> 5

    red, green, blue = (pixels >> 16 & 255).astype(np.int32), pixels >> 8 & 255, (pixels & 255).astype(np.int32)
    new_red = (red + sign * delta(own, green)) & 255
    seen_red = new_red if sign > 0 else red
    new_blue = (blue + sign * (delta(own >> 8, green) + delta(own >> 16, seen_red.astype(np.uint32)))) & 255
    return pixels & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    other = green << np.uint32(16) | green
    return pixels & np.uint32(0xFF00FF00) | ((pixels & np.uint32(0x00FF00FF)) + (other if sign > 0 else np.uint32(0x01000100) - other)) & np.uint32(0x00FF00FF)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(pixels: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    bundle = _bundle_bits(len(table))
    packed = (pixels >> 8 & 255).reshape(height, -1)
    if bundle:
        depth = 8 >> bundle
        packed = (packed[:, :, None] >> (depth * np.arange(1 << bundle, dtype=np.uint32)) & ((1 << depth) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[packed].reshape(-1)


def _chunk(data: bytes) -> bytes:
    """The lossless stream in a container."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless stream")


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width) of a lossless WebP file."""
    bits = Bits(_chunk(data))
    if bits.take(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    undo, narrow, seen = [], width, set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.take(3) + 2
            image = _read_image(bits, -(-narrow >> tile), -(-height >> tile), False)
            undo.append((kind, narrow, image, tile))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, narrow, None, 0))
        else:
            size = bits.take(8) + 1
            steps = _read_image(bits, size, 1, False)
            table = sum(np.cumsum(steps >> s & 255, dtype=np.uint32).astype(np.uint32) % 256 << s for s in (0, 8, 16, 24)).astype(np.uint32)
            undo.append((kind, narrow, table, 0))
            narrow = -(-narrow >> _bundle_bits(size))
    pixels = _read_image(bits, narrow, height, True)
    for kind, wide, image, tile in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, wide, height, image, tile)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, wide, height, image, tile, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            pixels = _undo_palette(pixels, wide, height, image)
    return pixels.reshape(height, width)


# Writing --------------------------------------------------------------------------------------------------------------


class _Out:
    """Values and their numbers of bits, packed at the end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._settle()
        self.parts.append((values, sizes))

    def _settle(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def packed(self) -> bytes:
        self._settle()
        values = np.concatenate([p[0] for p in self.parts]).astype(np.uint64, copy=False)
        sizes = np.concatenate([p[1] for p in self.parts]).astype(np.int64, copy=False)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[new]] = np.bitwise_or.reduceat(values << shift, new)
        over = np.flatnonzero((starts & 63) + sizes > 64)
        words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return words.tobytes()[: int(ends[-1]) + 7 >> 3]


def _write_code(out: _Out, lengths: dict[int, int], alphabet: int) -> None:
    """A prefix code: short form for one or two byte symbols, else lengths coded by a fixed complete code of 4 and 5 bits."""
    used = sorted(lengths)
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        short = used[0] < 2
        out.put(0 if short else 1, 1)
        out.put(used[0], 1 if short else 8)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    if len(used) == 1:
        lengths = {used[0]: 1}
    out.put(0, 1)
    out.put(15, 4)
    for _, n in _LENGTH_CODE_SIZES:
        out.put(n, 3)
    last = used[-1] + 1
    if last >= 2 and last < alphabet:
        out.put(1, 1)
    else:
        out.put(0, 1)
        last = alphabet
    items, k = [], 0
    while k < last:
        n, end = lengths.get(k, 0), k
        while end < last and lengths.get(end, 0) == n:
            end += 1
        run = end - k
        k = end
        if n:
            items.append((n, 0, 0))
            run -= 1
        while run >= 3:
            if n:
                take = min(run, 6)
                items.append((16, take - 3, 2))
            elif run < 11:
                take = run
                items.append((17, take - 3, 3))
            else:
                take = min(run, 138)
                items.append((18, take - 11, 7))
            run -= take
        items += [(n, 0, 0)] * run
    if last < alphabet:
        width = max(1, (len(items) - 2).bit_length() - 1 >> 1)
        out.put(width, 3)
        out.put(len(items) - 2, 2 + 2 * width)
    for s, extra, size in items:
        out.put(*_LENGTH_CODE[s])
        if size:
            out.put(extra, size)


#: Thirteen symbols of 4 bits and six of 5 bits make a complete code.
_LENGTH_CODE_SIZES = [(s, 5 if s in (1, 12, 13, 14, 15, 16) else 4) for s in LENGTH_ORDER]
_LENGTH_CODE = canonical(dict(_LENGTH_CODE_SIZES))


def _container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def _header(out: _Out, width: int, height: int) -> None:
    if not (0 < width <= LARGEST_SIDE and 0 < height <= LARGEST_SIDE):
        raise ValueError("a side of the image is out of range")
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1)
    out.put(0, 3)


def _bits(samples: np.ndarray) -> float:
    """About how many bits samples take as literals, their code included."""
    counts = np.bincount(samples, minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(len(samples) / counts)).sum()) + 4 * len(counts) if len(samples) else 0.0


def _transformed(data: np.ndarray, width: int, plain: float) -> tuple[int | None, np.ndarray, int, np.ndarray]:
    """The transform that makes grey samples smallest, if any does: its kind, the samples after it, their width, and its colours or mode.

    A palette where at most 16 values occur, so that several fit a pixel, or a prediction by the left or the upper sample. The other
    transforms and the colour cache save nothing where one channel alone has values.
    """
    best, least = (None, data, width, data[:0]), plain
    grid = data.reshape(-1, width)
    for mode in (1, 2):
        rest = grid.copy()
        if mode == 1:
            rest[:, 1:] -= grid[:, :-1]
            rest[1:, 0] -= grid[:-1, 0]
        else:
            rest[1:] -= grid[:-1]
            rest[0, 1:] -= grid[0, :-1]
        cost = _bits(rest.reshape(-1)) + 64
        if cost < least:
            best, least = (PREDICTOR, rest.reshape(-1), width, np.array([mode], np.uint8)), cost
    used = np.flatnonzero(np.bincount(data, minlength=256))
    if len(used) <= 16:
        bundle = _bundle_bits(len(used))
        narrow = -(-width >> bundle)
        index = np.zeros((len(grid), narrow << bundle), np.uint8)
        index[:, :width] = np.searchsorted(used, grid)
        depth = 8 >> bundle
        packed = np.bitwise_or.reduce(index.reshape(len(grid), narrow, 1 << bundle) << (depth * np.arange(1 << bundle, dtype=np.uint8)), axis=2).astype(np.uint8).reshape(-1)
        cost = _bits(packed) + 12 * len(used) + 64
        if cost < least:
            best = (PALETTE, packed, narrow, used.astype(np.uint8))
    return best


def _write_transform(out: _Out, kind: int, width: int, height: int, values: np.ndarray) -> None:
    out.put(1, 1)
    out.put(kind, 2)
    if kind == PREDICTOR:
        out.put(7, 3)  # tiles of 512 pixels a side
        across, down = -(-width >> 9), -(-height >> 9)
        _write_image(out, np.full(across * down, int(values[0]) << 8 | OPAQUE, np.uint32), across, 0, False, 1, False, 0)
    else:
        out.put(len(values) - 1, 8)
        steps = np.diff(values, prepend=np.uint8(0)).astype(np.uint32) << np.uint32(8)
        steps[0] |= np.uint32(OPAQUE)
        _write_image(out, steps, len(values), 0, False, 1, False, 0)


def encode_grey(samples: bytes, width: int, copies: list[tuple[int, int, int]] = ()) -> bytes:
    """A file whose green channel has the samples, one a pixel, the length a multiple of the width.

    copies: (place, length, distance) of runs that are equal to the samples `distance` before, in order, not overlapping. They
    are used unless a transform of all samples takes less.
    """
    data = np.frombuffer(samples, np.uint8)
    out = _Out()
    height = len(data) // width
    _header(out, width, height)
    kept = np.ones(len(data), bool)
    for place, length, _ in copies:
        kept[place : place + length] = False
    kind, data, _, values = _transformed(data, width, _bits(data[kept] if copies else data) + 40 * len(copies))
    if kind is not None:
        copies = ()
        _write_transform(out, kind, width, height, values)
    out.put(0, 1)  # no more transforms
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one group of codes
    runs, at = [], 0
    tokens = []
    for place, length, distance in copies:
        runs.append(data[at:place])
        tokens.append((prefix_of(length), prefix_of(distance + 120)))
        at = place + length
    runs.append(data[at:])
    literal = np.concatenate(runs) if copies else data
    counts = np.bincount(literal, minlength=256)
    used = np.flatnonzero(counts)
    greens = dict(zip(used.tolist(), counts[used].tolist()))
    distances: dict[int, int] = {}
    for (a, _, _), (b, _, _) in tokens:
        greens[256 + a] = greens.get(256 + a, 0) + 1
        distances[b] = distances.get(b, 0) + 1
    lengths = code_lengths(greens)
    _write_code(out, lengths, ALPHABETS[0])
    for only in (0, 0, 0 if kind == PREDICTOR else 255):
        _write_code(out, {only: 1}, 256)
    spans = code_lengths(distances or {0: 1})
    _write_code(out, spans, ALPHABETS[4])
    if len(lengths) > 1 or tokens:
        code = canonical(lengths) if len(lengths) > 1 else {next(iter(lengths)): (0, 0)}
        values, sizes = np.zeros(280, np.uint64), np.zeros(280, np.int64)
        for s, (v, n) in code.items():
            values[s], sizes[s] = v, n
        far = canonical(spans) if len(spans) > 1 else {next(iter(spans)): (0, 0)}
        for k, run in enumerate(runs):
            if len(run):
                out.put_all(values[run], sizes[run])
            if k < len(tokens):
                (a, an, ax), (b, bn, bx) = tokens[k]
                out.put(*code[256 + a])
                out.put(ax, an)
                out.put(*far[b])
                out.put(bx, bn)
    return _container(out.packed())


def encode(pixels: np.ndarray, transforms=(), cache_bits: int = 0, copies: bool = True, groups: int = 1, mode: int = 11, element: int = 0x00102030, tile_bits: int = 3) -> bytes:
    """A file of any pixels (height, width), with the transforms asked for in the order given; plain and slow, it exercises the whole format."""
    height, width = pixels.shape
    out = _Out()
    _header(out, width, height)
    flat = pixels.astype(np.uint32).reshape(-1)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PREDICTOR:
            out.put(tile_bits - 2, 3)
            modes = (np.arange((-(-width >> tile_bits)) * (-(-height >> tile_bits)), dtype=np.uint32) + mode) % 14 << 8 | OPAQUE
            _write_image(out, modes.astype(np.uint32), -(-width >> tile_bits), 0, False, 1, False, 0)
            rows = flat.reshape(height, width).tolist()
            tiles = (modes >> 8 & 255).reshape(-(-height >> tile_bits), -1).tolist()
            guess = np.array([[_prediction(rows, x, y, width, tiles[y >> tile_bits][x >> tile_bits]) for x in range(width)] for y in range(height)], np.uint32).reshape(-1)
            flat = ((flat | 0x00FF00FF) - (guess & 0xFF00FF00)) & 0xFF00FF00 | ((flat & 0x00FF00FF | 0x01000100) + 0 - (guess & 0x00FF00FF)) & 0x00FF00FF
            flat = flat.astype(np.uint32)
        elif kind == CROSS_COLOUR:
            out.put(tile_bits - 2, 3)
            elements = np.full((-(-width >> tile_bits)) * (-(-height >> tile_bits)), element | OPAQUE, np.uint32)
            _write_image(out, elements, -(-width >> tile_bits), 0, False, 1, False, 0)
            flat = _cross(flat, width, height, elements, tile_bits, -1)
        elif kind == SUBTRACT_GREEN:
            flat = _green(flat, -1)
        else:
            table, index = np.unique(flat, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            out.put(len(table) - 1, 8)
            steps = sum(((table >> s & 255).astype(np.int64) - np.concatenate([[0], table[:-1] >> s & 255]).astype(np.int64)) % 256 << s for s in (0, 8, 16, 24))
            _write_image(out, steps.astype(np.uint32), len(table), 0, False, 1, False, 0)
            bundle = _bundle_bits(len(table))
            narrow = -(-width >> bundle)
            wide = np.zeros((height, narrow << bundle), np.uint32)
            wide[:, :width] = index.reshape(height, width)
            depth = 8 >> bundle
            packed = (wide.reshape(height, narrow, 1 << bundle) << (depth * np.arange(1 << bundle, dtype=np.uint32))).sum(axis=2).astype(np.uint32)
            flat, width = (packed << 8 | OPAQUE).reshape(-1).astype(np.uint32), narrow
    out.put(0, 1)
    _write_image(out, flat, width, cache_bits, copies, groups, True, tile_bits)
    return _container(out.packed())


def _tokens(flat: list[int], width: int, cache_bits: int, copies: bool):
    """Literals (pixel,), cache hits (index, None) and copies (length, distance code, 0) with the place of each."""
    cache, seen, out, at = {}, {}, [], 0
    near = {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(near_places())))}
    while at < len(flat):
        key = tuple(flat[at : at + 3])
        source = seen.get(key) if copies else None
        length = 0
        if source is not None:
            while at + length < len(flat) and length < 4096 and flat[source + length] == flat[at + length]:
                length += 1
        slot = (CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if length >= 3:
            distance = at - source
            out.append((at, (length, near.get(distance, distance + 120), 0)))
        elif cache_bits and cache.get(slot) == flat[at]:
            out.append((at, (slot, None)))
            length = 1
        else:
            out.append((at, (flat[at],)))
            length = 1
        for k in range(at, at + length):
            if cache_bits:
                cache[(CACHE_FACTOR * flat[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
            seen[tuple(flat[k : k + 3])] = k
        at += length
    return out


def _write_image(out: _Out, flat: np.ndarray, width: int, cache_bits: int, copies: bool, groups: int, main: bool, tile_bits: int) -> None:
    if cache_bits:
        out.put(1, 1)
        out.put(cache_bits, 4)
    else:
        out.put(0, 1)
    height = len(flat) // width
    across = -(-width >> tile_bits)
    if main:
        out.put(int(groups > 1), 1)
        if groups > 1:
            out.put(tile_bits - 2, 3)
            chosen = np.arange(across * -(-height >> tile_bits), dtype=np.uint32) % groups << 8
            _write_image(out, chosen.astype(np.uint32), across, 0, False, 1, False, 0)
            groups = int(chosen.max() >> 8) + 1
    own = lambda at: ((at // width) >> tile_bits) * across % groups + 0 if groups == 1 else (((at // width) >> tile_bits) * across + ((at % width) >> tile_bits)) % groups
    tokens = _tokens(flat.tolist(), width, cache_bits, copies)
    counts = [[{} for _ in ALPHABETS] for _ in range(groups)]
    items = []
    for at, token in tokens:
        g = own(at)
        if len(token) == 1:
            p = token[0]
            parts = [(0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)]
            extra = [None] * 4
        elif len(token) == 2:
            parts, extra = [(0, 280 + token[0])], [None]
        else:
            a, an, ax = prefix_of(token[0])
            b, bn, bx = prefix_of(token[1])
            parts, extra = [(0, 256 + a), (4, b)], [(ax, an), (bx, bn)]
        for k, s in parts:
            counts[g][k][s] = counts[g][k].get(s, 0) + 1
        items.append((g, parts, extra))
    codes = []
    for g in range(groups):
        codes.append([])
        for k, alphabet in enumerate(ALPHABETS):
            lengths = code_lengths(counts[g][k] or {0: 1})
            _write_code(out, lengths, alphabet + ((1 << cache_bits) if k == 0 and cache_bits else 0))
            codes[-1].append(canonical(lengths) if len(lengths) > 1 else {s: (0, 0) for s in lengths})
    for g, parts, extra in items:
        for (k, s), more in zip(parts, extra):
            out.put(*codes[g][k][s])
            if more:
                out.put(*more)
