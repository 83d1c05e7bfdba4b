import hashlib
import zlib

import numpy as np
import pytest

from quillmine.llm import media, queries_media, webp
from tests.llm.helpers import frame, odd_docs


def test_short_distances():
    places = webp.near_places()
    assert len(set(places)) == 120 and places[:8] == ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)) and places[-1] == (8, 7)


def test_prefix_values():
    for value in [*range(1, 300), 4096, 1 << 20]:
        symbol, size, extra = webp.prefix_of(value)
        bits = webp.Bits(extra.to_bytes(4, "little"))
        assert bits.value(symbol) == value and size <= 20


def images():
    r = np.random.default_rng(0)
    for h, w in ((1, 1), (1, 7), (9, 1), (17, 23)):
        base = r.integers(0, 1 << 32, (h, w), dtype=np.uint32)
        yield base
        yield r.choice(base.reshape(-1)[:12], (h, w))
        yield r.choice(base.reshape(-1)[:2], (h, w))
        yield ((np.add.outer(np.arange(h), np.arange(w)) * 0x01010203) & 0xFFFFFFFF).astype(np.uint32)


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (0, 1, 2), (2, 0), (3,), (3, 0), (3, 0, 2)])
@pytest.mark.parametrize("cache", [0, 3, 8])
def test_round_trips(transforms, cache):
    for pixels in images():
        if 3 in transforms and len(np.unique(pixels)) > 256:
            continue
        for copies in (False, True):
            for groups in (1, 3):
                assert (webp.decode(webp.encode(pixels, transforms, cache, copies, groups)) == pixels).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    pixels = np.random.default_rng(mode).integers(0, 1 << 32, (9, 11), dtype=np.uint32)
    assert (webp.decode(webp.encode(pixels, (0,), mode=mode)) == pixels).all()


def test_predictor_formulas():
    left, top, corner = 0x10203040, 0x50607080, 0x20304050
    assert webp.predict(7, left, top, 0, corner) == 0x30405060
    assert webp.predict(12, left, top, 0, corner) == 0x40506070
    assert webp.predict(13, left, top, 0, corner) == 0x38485868
    assert webp.predict(11, left, top, 0, corner) == top


def test_a_known_file():
    """One green pixel, written by hand: signature, size 1x1, no transforms, five codes of one symbol."""
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)))
    for symbol in (200, 0, 0, 255, 0):
        bits += "1" + "0" + "1" + format(symbol, "08b")[::-1]
    bits += "0" * (-len(bits) % 8)
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert webp.decode(webp._container(stream)).tolist() == [[0xFF00C800]]


def test_broken_files():
    good = webp.encode_grey(bytes(range(64)), 64)
    for bad in (b"", b"RIFF0000WEBPVP8X", good[:24], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_length_limit_of_codes():
    counts = {k: 1 << k for k in range(40)}
    lengths = webp.code_lengths(counts)
    assert max(lengths.values()) <= 15 and sum(2.0**-n for n in lengths.values()) == 1


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 64, "日本語\n".encode() * 99, bytes(range(256)) * 9, (b"a line that is long enough to count\n" * 50) + b"end", b"q" * 1_100_000])
def test_payloads(text):
    data = media.payload(text)
    assert len(data) % 64 == 0 and len(data) > 0
    stored = media.store(data)
    assert media.load(stored).tobytes()[: len(data)] == data and media.store(data) == stored


def kind_of(stored):
    """The first transform of a file, none if it has none."""
    bits = webp.Bits(webp._chunk(stored))
    for n in (8, 14, 14, 1, 3):
        bits.take(n)
    return bits.take(2) if bits.take(1) else None


@pytest.mark.parametrize(
    "data, kind",
    [
        (b"0110" * 160, webp.PALETTE), (b"0123456789+-" * 300, webp.PALETTE), (bytes(k * 3 % 256 for k in range(6400)), webp.PREDICTOR),
        (b"".join(bytes([(37 * x * x + y) % 256 for x in range(64)]) for y in range(100)), webp.PREDICTOR), ("Plain words, of the ordinary kind; nothing else is in them. ".encode() * 3, None),
    ],
)
def test_the_smallest_form_is_chosen(data, kind):
    stored = media.store(media.payload(data))
    assert kind_of(stored) == kind and media.load(stored).tobytes()[: len(data)] == data


@pytest.mark.parametrize("mode", [1, 2])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (13, 17)])
def test_running_sums_are_the_prediction_undone(mode, shape):
    pixels = np.random.default_rng(mode).integers(0, 1 << 32, shape, dtype=np.uint32)
    rest = np.random.default_rng(9).integers(0, 1 << 32, shape, dtype=np.uint32).reshape(-1)
    h, w = shape
    rows = [[0] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            rows[y][x] = webp._add(int(rest[y * w + x]), webp._prediction(rows, x, y, w, mode))
    assert webp._undo_predictor(rest, w, h, np.array([mode << 8], np.uint32), 9).tolist() == [p for row in rows for p in row]
    assert (webp.decode(webp.encode(pixels, (0,), mode=mode, tile_bits=9)) == pixels).all()


def test_payloads_of_several_files(monkeypatch):
    monkeypatch.setattr(media, "FILE_BYTES", 256)
    data = media.payload(b"a line that is long enough to count\n" * 30 + bytes(range(256)))
    stored = media.store(data)
    assert stored.count(b"RIFF") == -(-len(data) // 256) and media.load(stored).tobytes()[: len(data)] == data


def test_repeated_lines_are_references():
    line = b"some words that stand in a line of their own\n"
    data = media.payload(line * 200)
    assert len(media.line_copies(data)) > 150 and len(media.store(data)) < len(data) / 4


def test_odd_rows(spark):
    rows = media.decode_media(media.encode_media(odd_docs(spark))).collect()
    assert len(rows) == 10 and all(len(r.samples) == r.payload_bytes for r in rows)
    nothing = next(r for r in rows if r.n_bytes == 0)
    assert bytes(nothing.samples) == bytes(64) and nothing.width == 64
    assert media.decode_media(media.encode_media(odd_docs(spark).limit(0))).count() == 0


def test_query(spark, tmp_path):
    texts = ["", None, "a", "a", "ü" * 100, "line one is here and it is long\n" * 5]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries_media.op2_lossless_webp(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.store(data)).hexdigest() and r.media_bytes == len(media.store(data))
    assert rows[2][1:] == rows[3][1:] and rows[0][1:] == rows[1][1:]
