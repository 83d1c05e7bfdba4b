import hashlib
from collections import defaultdict

import numpy as np
import pytest

from quillmine.llm import bwt
from quillmine.llm.passages import remove_passages, repeated_windows
from quillmine.llm.queries_passages import op13_suffix_array_dedup
from tests.llm.helpers import frame, odd_docs, rng


def brute(texts, length):
    """n_bytes, n_removed, n_spans and kept of each text, by a table of all windows."""
    raw = [(t or "").encode() for t in texts]
    at = defaultdict(list)
    for i, r in enumerate(raw):
        for s in range(len(r) - length + 1):
            at[r[s : s + length]].append((i, s))
    gone = [np.zeros(len(r) + 1, bool) for r in raw]
    for places in at.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = True
    out = []
    for r, g in zip(raw, gone):
        g = g[:-1]
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((len(r), int(g.sum()), spans, np.frombuffer(r, np.uint8)[~g].tobytes()))
    return out


def results(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.orderBy("doc_id").collect()]


def test_grams_and_symbols_are_exact(monkeypatch):
    data = np.frombuffer(bytes(rng(1).choices(b"ab", k=3000)), np.uint8)
    for gram in (1, 3, 8, 11, 40):
        names = [data[i : i + gram].tobytes() for i in range(len(data) - gram + 1)]
        places = np.arange(len(names))
        for hashes in (None, np.zeros(len(names), np.uint64)):  # the second: every hash collides
            number = bwt.symbol_numbers(data, places, gram, hashes)
            assert len(set(zip(names, number.tolist()))) == len(set(names)) == len(set(number.tolist()))


def test_merged_order_is_that_of_all_suffixes():
    """The intervals of merged shards are those of sorting all suffixes, and hold equal symbols."""
    r = rng(2)
    texts = [bytes(r.choices(b"xyz", k=r.randrange(12, 90))) for _ in range(40)]
    for shards in (1, 3, 7):
        hits = repeated_windows(texts, np.zeros(len(texts), bool), 10, shards)
        seen = defaultdict(int)
        for t in texts:
            for s in range(len(t) - 9):
                seen[t[s : s + 10]] += 1
        assert [h.tolist() for h in hits] == [[seen[t[s : s + 10]] > 1 for s in range(len(t) - 9)] for t in texts]


@pytest.mark.parametrize("length,most", [(20, 4096), (20, 2), (40, 4096), (200, 3)])
def test_equals_brute_force(spark, length, most):
    r = rng(length + most)
    shared = ["".join(r.choices("abcdé \n", k=r.randrange(length // 2, 3 * length))) for _ in range(6)]
    texts = []
    for _ in range(70):
        texts.append("".join(r.choice(shared) if r.random() < 0.5 else "".join(r.choices("abcdeü日", k=r.randrange(1, length))) for _ in range(r.randrange(0, 6))))
    texts += [texts[3], "a" * 700, "ab" * 400, None, "", "x" * length, "y" * (length - 1)]
    assert results(remove_passages(frame(spark, texts).repartition(3), length, most)) == brute(texts, length)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = remove_passages(docs, 200)
    assert out.columns == [*(c for c in docs.columns if c not in ("kept",)), "n_bytes", "n_removed", "n_spans", "kept"]
    rows = out.collect()
    assert len(rows) == docs.count()
    text = [r.text for r in rows]
    for r, want in zip(rows, brute(text, 200)):
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want
    assert remove_passages(docs.limit(0)).count() == 0


def test_rows_of_one_id_and_without_one(spark):
    long = "".join(rng(5).choices("abcdefgh", k=500))
    other = "".join(rng(6).choices("abcdefgh", k=500))
    texts = [long, other, long, "z" + long, other[:300]]
    docs = frame(spark, texts, ids=[None, None, None, 7, 7])
    found = {(r.doc_id, r.text): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_passages(docs).collect()}
    for text, i, want in zip(texts, [None, None, None, 7, 7], brute(texts, 200)):
        assert found[i, text] == want


def test_length_is_checked(spark):
    with pytest.raises(ValueError):
        remove_passages(frame(spark, ["a"]), 201)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {r.doc_id: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, brute([r.text for r in rows], 200))}
    got = {r.doc_id: tuple(r)[1:] for r in op13_suffix_array_dedup(spark, sf).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 5


def test_documents_are_shuffled_once(spark):
    """Beyond broadcast sizes both joins of the documents read one exchange."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = op13_suffix_array_dedup(spark, "/root/testdata/sf0.001")
        plan.collect()
        assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
