import numpy as np
import pytest
import xxhash

from quillmine.llm import queries_simhash, simhash
from tests.llm.helpers import WORD, Sets, frame, odd_docs, rng, words_text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    r = rng(1)
    for text in ["", None, "One", "One TWO", "a b c", "a b c d", "ÄÖ äö É x", "x " * 500, *[words_text(r, r.randint(1, 60)) for _ in range(40)]]:
        assert simhash.fingerprint(text or "") == by_hand(text)


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("ab c dé",)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64)
    assert got == xxhash.xxh64_intdigest("ab c dé".encode(), 42)


def clusters(n, seed):
    g = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        x = int(g.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(int(g.integers(1, 12))):
            out.append(x)
            for b in g.choice(64, int(g.integers(1, 4)), replace=False):
                x ^= 1 << int(b)
    return list(dict.fromkeys(out))[:n]


def components_of(values):
    sets = Sets(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                sets.join(i, j)
    return [sets.root(i) for i in range(len(values))]


@pytest.mark.parametrize("tile", [2, 256])
def test_spanning_links(tile):
    values = clusters(400, 2)
    links = simhash.spanning_links(np.array(values, np.uint64), 3, tile)
    at = {v: i for i, v in enumerate(values)}
    sets = Sets(range(len(values)))
    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        sets.join(at[a], at[b])
    assert [sets.root(i) for i in range(len(values))] == components_of(values) and len(links) < len(values)


@pytest.mark.parametrize("parts", [4, 5, 6])
@pytest.mark.parametrize("tile", [4, 2048])
def test_links_in_spark(spark, monkeypatch, parts, tile):
    monkeypatch.setattr(simhash, "parts_for", lambda n, radius=3: parts)
    values = clusters(250, 3) + [0, 1, 3, 7, (1 << 64) - 1, (1 << 63) - 1]
    values = list(dict.fromkeys(values))
    frame_ = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame_, 3, tile)).collect()}
    want = components_of(values)
    got = [roots.get(simhash._signed(v), simhash._signed(v)) for v in values]
    assert {(w, g) for w, g in zip(want, got)}.__len__() == len(set(want)) == len(set(got))


def test_parts_follow_the_count():
    assert simhash.parts_for(10) == simhash.parts_for(1 << 22) == 4 and simhash.parts_for(1 << 30) == 5 and simhash.parts_for(1 << 36) == 6


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 400), (600, 601), (601, 600)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 101)) and got[500] == 400 and got[601] == 600 and 400 not in got


def test_documents(spark):
    r = rng(4)
    base = [words_text(r, 200) for _ in range(12)]
    texts = []
    for b in base:
        words = b.split()
        for k in range(4):
            texts.append(" ".join(words))
            words[r.randrange(len(words))] = f"new{k}"
    texts += ["", None, " ", base[0].upper()]
    got = sorted(simhash.near_duplicates(frame(spark, texts).repartition(3)).collect(), key=lambda x: x.doc_id)
    values = [by_hand(t) for t in texts]
    assert [int(x.fingerprint, 16) for x in got] == values and [x.component_id for x in got] == components_of(values)
    assert len(set(components_of(values))) < len(texts) - 10


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 10
    assert {x.component_id for x in got if int(x.fingerprint, 16) == 0} == {2}
    alone = frame(spark, ["only text"], ids=[None])
    assert [tuple(x)[2] for x in simhash.near_duplicates(alone).collect()] == [None]
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    values = [by_hand(d.text) for d in docs]
    got = sorted(queries_simhash.op8_simhash(spark, sf).collect(), key=lambda x: x.doc_id)
    assert [x.fingerprint for x in got] == [format(v, "016x") for v in values]
    assert [x.component_id for x in got] == [docs[i].doc_id for i in components_of(values)]


@pytest.mark.parametrize("common", [1, 3, 10_000])
def test_common_keys_meet_their_rows(spark, monkeypatch, common):
    """Whatever part of the keys is broadcast, each row meets its one fact."""
    monkeypatch.setattr(simhash, "COMMON", common)
    keys = [0] * 40 + [1] * 15 + [2, 3, 3, 4]
    rows = spark.createDataFrame(list(enumerate(keys)), "row long, k long")
    facts = spark.createDataFrame([(k, keys.count(k), f"f{k}") for k in set(keys)], "k long, n long, fact string")
    got = simhash.joined_by_share(rows, facts, "k", "n").select("row", "fact").collect()
    assert sorted(map(tuple, got)) == [(i, f"f{k}") for i, k in enumerate(keys)]
    assert simhash.joined_by_share(rows.limit(0), facts.limit(0), "k", "n").count() == 0
