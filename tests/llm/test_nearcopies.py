import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmine.llm import nearcopies
from tests.llm.helpers import WORD, Sets, frame, odd_docs, rng, words_text

SF = "/root/testdata/sf0.001"


def by_hand(rows, similarity=0.8):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").lower())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    groups = Sets(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                groups.join(a, b)
    named = {}
    for k, (i, _) in enumerate(rows):
        named.setdefault(groups.root(k), []).append(i)
    return {min(v, key=lambda i: (i is None, i)) for v in named.values()}


def edited(r, text, n):
    words = text.split()
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_groups_by_hand(spark):
    r = rng(12)
    whole = [words_text(r, 120) for _ in range(30)]
    texts = whole + [edited(r, t, n) for t in whole for n in (1, 2, 4, 12)] + [t.upper() for t in whole[:3]] + ["", None, "a b", "A  b"]
    got = nearcopies.keep_first(frame(spark, texts)).collect()
    assert sorted(x.doc_id for x in got) == sorted(by_hand(list(enumerate(texts))))


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "HOT", 20)
    r = rng(13)
    text = words_text(r, 200)
    texts = [edited(r, text, r.randrange(3)) for _ in range(150)] + [words_text(r, 50) for _ in range(50)]
    got = nearcopies.keep_first(frame(spark, texts)).collect()
    assert sorted(x.doc_id for x in got) == sorted(by_hand(list(enumerate(texts))))


def test_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, SF).collect()
    assert sorted(x.doc_id for x in rows) == sorted(by_hand([(x.doc_id, x.text) for x in docs.collect()]))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    # Both texts under id 1, both without an id (the null text is a class with the empty ones, of which id 2 stays).
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text) for x in rows) == sorted(
        (x.doc_id is None, x.doc_id or 0, x.text) for x in docs.dropDuplicates(["doc_id", "text"]).where("text is not null and coalesce(doc_id, 0) <> 3").collect()
    )
    assert nearcopies.keep_first(docs.limit(0)).count() == 0


def test_copies_without_an_id_are_one(spark):
    rows = nearcopies.keep_first(frame(spark, ["a text of some words"] * 5, ids=[None] * 5)).collect()
    assert len(rows) == 1


def test_forest_and_large_blocks(monkeypatch):
    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    words = np.repeat(centres, 40, axis=0)
    for row in words:
        for at in r.choice(128, 6, replace=False):
            row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    far = np.bitwise_count(words[:, None] ^ words[None, :]).sum(axis=2)
    want = Sets(range(len(words)))
    for a, b in zip(*np.nonzero(far <= 30)):
        want.join(int(a), int(b))
    for tile in (1024, 32):
        monkeypatch.setattr(nearcopies, "TILE", tile)
        found, got = nearcopies.block_links(words, 30), Sets(range(len(words)))
        for a, b, d in found:
            assert far[a, b] == d <= 30
            got.join(a, b)
        assert [got.root(i) for i in range(len(words))] == [want.root(i) for i in range(len(words))]
        assert len(found) < 240 * (nearcopies.NEAREST + 1) or tile == 32
    keys = np.sort(r.integers(0, 1 << 48, 500))
    monkeypatch.setattr(nearcopies, "MOST_BLOCK", 64)
    parts = list(nearcopies._divided(keys, 0, 500, 0))
    assert [p for p, _ in parts] == [0] + [q for _, q in parts[:-1]] and parts[-1][1] == 500 and all(b - a <= 64 for a, b in parts)


def test_no_link_is_lost_in_a_crowd(spark):
    """Variants of one text whose similarities lie on both sides of the bound: most of each one's closest are no links."""
    r = rng(14)
    text = words_text(r, 100)
    tight = [edited(r, text, 7) for _ in range(12)]
    texts = [edited(r, text, r.randrange(1, 12)) for _ in range(80)] + [edited(r, t, n) for t in tight for n in (1, 2, 3, 4)] + tight
    got = nearcopies.keep_first(frame(spark, texts)).collect()
    assert sorted(x.doc_id for x in got) == sorted(by_hand(list(enumerate(texts))))


def test_tiles_of_a_block_hold_every_open_pair(monkeypatch):
    r = np.random.default_rng(5)
    centre = r.integers(0, 1 << 63, 2, dtype=np.uint64)
    fps = np.tile(centre, (60, 1))
    for row in fps:
        for at in r.choice(128, r.integers(0, 30), replace=False):
            row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    labels, sizes, nodes = r.integers(0, 9, 60), r.integers(50, 80, 60), np.arange(60)
    far = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2)
    fits = np.minimum(sizes[:, None], sizes) >= 0.8 * np.maximum(sizes[:, None], sizes) - 1e-9
    want = {(a, b) for a, b in zip(*np.nonzero((far <= 36) & (labels[:, None] != labels) & fits)) if a < b}
    batch = {"sample": [0] * 60, "prefix": [3] * 60, "node": nodes, "label": labels, "fp1": fps[:, 0].view(np.int64), "fp2": fps[:, 1].view(np.int64), "size": sizes}
    rows = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in batch.items()})
    for tile in (256, 7):
        monkeypatch.setattr(nearcopies, "SETS_TILE", tile)
        met = {}
        for found in nearcopies._meetings(4, nearcopies.samples(1), 36, 0.8)([rows.slice(0, 25), rows.slice(25)]):
            for x in found.to_pylist():
                met.setdefault((x["tile"], x["other"]), {}).setdefault(x["side"], []).append(x["node"])
        pairs = {(a, b) for (t, u), sides in met.items() for a in sides[0] for b in sides[0 if t == u else 1]}
        assert want <= {(min(p), max(p)) for p in pairs}
        assert len(met) > 1 or tile == 256


def crowd(r, n, flips=10, centres=1):
    words = np.repeat(r.integers(0, 1 << 63, (centres, 2), dtype=np.uint64), n // centres, axis=0)
    for row in words:
        for at in r.choice(128, flips, replace=False):
            row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    return words


def test_links_of_a_fingerprint_do_not_grow_with_samples_or_tiles(spark, monkeypatch):
    made, compared = spark.sparkContext.accumulator(0), nearcopies._compared

    def counted(*given):
        def run(batches, f=compared(*given)):
            for batch in f(batches):
                made.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(nearcopies, "_compared", counted)
    n = 200
    fps = crowd(np.random.default_rng(6), n).view(np.int64).tolist()
    classes = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(fps)], "node long, fp1 long, fp2 long")
    rows = []
    for tables in (12, 48):
        monkeypatch.setattr(nearcopies, "tables_for", lambda *_: (4, tables))
        before = made.value
        assert nearcopies.candidates(classes).count()
        rows.append(made.value - before)
    assert rows[0] == rows[1] <= nearcopies.FIRST * n * (1 + nearcopies.NEAREST_IN_BLOCK)
    monkeypatch.setattr(nearcopies, "TILE", 8)
    words = crowd(np.random.default_rng(7), 240, 6, 6)
    far = np.bitwise_count(words[:, None] ^ words[None, :]).sum(axis=2)
    found, want, got = nearcopies.block_links(words, 30), Sets(range(240)), Sets(range(240))
    assert len(found) < 240 * (1 + nearcopies.NEAREST_IN_BLOCK)
    for a, b in zip(*np.nonzero(far <= 30)):
        want.join(int(a), int(b))
    for a, b, d in found:
        assert far[a, b] == d <= 30
        got.join(a, b)
    assert [got.root(i) for i in range(240)] == [want.root(i) for i in range(240)]


def test_groups_do_not_depend_on_the_samples_of_the_first_round(spark, monkeypatch):
    r = rng(15)
    text = words_text(r, 100)
    texts = [edited(r, text, r.randrange(1, 9)) for _ in range(60)] + [edited(r, t, n) for t in [words_text(r, 90) for _ in range(20)] for n in (0, 1, 3)]
    want = sorted(by_hand(list(enumerate(texts))))
    for first in (1, 1000):
        monkeypatch.setattr(nearcopies, "FIRST", first, raising=False)
        assert sorted(x.doc_id for x in nearcopies.keep_first(frame(spark, texts)).collect()) == want
