import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmine.llm import packing, queries_packing
from quillmine.llm.ranks import ranked
from tests.llm.helpers import frame, odd_docs, rng, words_text


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


ODD = ["", "a", "Don't we'LL it's o''s .'s 'S", "J̌ xİy ΣΑΣ. Ⱥ", "<|endoftext|> hi<|startoftext|>x", "x\x1cy\x85z\xa0w", "½ ²3 12,5€ ﬁ ①", "ÀÉ ŉ ſ ×÷ 12ab'll", "word$$$ the&&&", "日本語 テスト", "áë ́x", "​ab 　c", "K Å"]


def test_encoding_is_the_tokenizers():
    r, letters = rng(1), "abcXYZ é'’sST.,!$#019 \n\tßŸİſ́日 ΣσŒ"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(800)]
    plain = tokenizer()
    for text, got in zip(texts, packing.Encoder(packing.tokenizer_path()).encode(pa.array(texts))):
        assert got.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0], text


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    encoder = packing.Encoder(packing.tokenizer_path())
    ids = lambda texts: [x.tolist() for x in encoder.encode(pa.array(texts))]
    first = ids(["one two three four", "five six"])
    assert ids(["seven eight nine", "one two three four", "five six"])[1:] == first
    assert ids(["z" * 100]) == [x.tolist() for x in packing.Encoder(packing.tokenizer_path()).encode(pa.array(["z" * 100]))]
    for _ in range(4):
        assert ids(["seven eight", "one two three four", "five six"])[1:] == first
    assert len(encoder.young) + len(encoder.old) < 30


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=8))
def test_the_fullest_combination(counts):
    capacity = 30
    used = packing.fullest(counts, capacity)
    items = [k for k, n in counts.items() for _ in range(n)]
    items.remove(max(items))
    sums = {max(counts)}
    for x in items:
        sums |= {s + x for s in sums if s + x <= capacity}
    assert sum(k * n for k, n in used.items()) == max(sums)
    assert all(n <= counts[k] for k, n in used.items()) and used[max(counts)] >= 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_the_plan_uses_every_piece(counts):
    combinations = packing.plan(counts, 64)
    used = {}
    for lengths, bins in combinations:
        assert bins > 0 and sum(k * n for k, n in lengths.items()) <= 64
        for k, n in lengths.items():
            used[k] = used.get(k, 0) + n * bins
    assert used == counts and len(combinations) <= 64


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_in_spark(spark):
    r = rng(2)
    docs = frame(spark, [words_text(r, r.randint(0, 70)) for _ in range(300)] + ["v1 v2 v3"] * 200 + ["", None])
    packed = packing.pack_documents(docs, capacity=64, with_ids=True)
    rows = packed.collect()
    total = sum(x.length for x in rows)
    assert check_places(rows, 64) <= 1.02 * total / 64 + 2
    whole = packing.Encoder(packing.tokenizer_path())
    texts = {d.doc_id: d.text for d in docs.collect()}
    pieces = {}
    for x in rows:
        pieces.setdefault(x.doc_id, []).append(x)
    for i, own in pieces.items():
        own.sort(key=lambda x: x.piece)
        assert b"".join(bytes(x.ids) for x in own) == whole.encode(pa.array([texts[i] or ""]))[0].astype("<u4").tobytes()
        assert [x.piece for x in own] == list(range(len(own))) and all(x.length == 64 for x in own[:-1])
        assert all(x.start == 64 * x.piece and x.ids_crc32 == zlib.crc32(x.ids) for x in own)
    for s in packing.sequences(packed).collect():
        assert bytes(s.ids) == b"".join(bytes(x.ids) for x in sorted((x for x in rows if x.sequence_id == s.sequence_id), key=lambda x: x.offset))


def test_ranks(spark):
    rows = spark.createDataFrame([(k % 3 if k % 4 else None, k) for k in range(200)], "g int, v long")
    got = {}
    for r in ranked(rows, ["g"], [rows.v], rows.v, 8).collect():
        got.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in got.values()) and sum(map(len, got.values())) == 200


def test_odd_rows(spark):
    rows = packing.pack_documents(odd_docs(spark)).collect()
    check_places(rows, 2048)
    assert sum(r.doc_id == 1 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack_documents(odd_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    rows = queries_packing.op7_best_fit_packing(spark, f"/root/testdata/{sf}").collect()
    total = sum(r.length for r in rows)
    assert check_places(rows, 2048) <= 1.01 * total / 2048 + 1
