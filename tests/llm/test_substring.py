import hashlib

import numpy as np
import pytest

from quillmine.llm import queries_substring, substring, wordhash
from tests.llm.helpers import WORD, frame, odd_docs, rng, words_text


def by_hand(rows, length):
    """(doc_id, text) pairs in any order; the same pair twice is one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, {}
    for key in order:
        words = WORD.findall(key[1] or "")
        gone = set()
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if seen.setdefault(w, (key, i)) != (key, i):
                gone |= set(range(i, i + length))
        out[key] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def texts():
    r = rng(1)
    passage = words_text(r, 60)
    out = [words_text(r, r.randint(0, 80), 40) for _ in range(60)]
    out += [f"{words_text(r, 30)} {passage} {words_text(r, 30)}" for _ in range(40)]
    out += [out[0]] * 30 + [out[70]] * 30 + ["a b " * 50, "a " * 90, "", None, " \n\t ", "x" * 3000, "ünï 日本 " * 40]
    return out


@pytest.mark.parametrize("length", [1, 3, 8, 20])
@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, length, parts):
    rows = list(enumerate(texts()))
    docs = frame(spark, [t for _, t in rows]).repartition(parts)
    want = by_hand(rows, length)
    got = substring.remove_repeats(docs, length).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.text]


def test_a_full_sketch_loses_nothing(spark):
    rows = list(enumerate(texts()))
    docs = frame(spark, [t for _, t in rows])
    small = {r.doc_id: (r.n_removed, r.kept) for r in substring.remove_repeats(docs, 20, most_bits=16).collect()}
    assert small == {r.doc_id: (r.n_removed, r.kept) for r in substring.remove_repeats(docs, 20).collect()}


def test_ranges_lose_nothing(spark, monkeypatch):
    rows = list(enumerate(texts()))
    want = by_hand(rows, 20)
    monkeypatch.setattr(substring, "BYTES_A_CELL", 0.25)
    docs = frame(spark, [t for _, t in rows])
    assert substring.ranges_for(sum(len(t or "") for _, t in rows), 16) > 2
    assert all((r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.text] for r in substring.remove_repeats(docs, 20, most_bits=16).collect())


def test_the_sketch_keeps_filtering(spark):
    """A corpus of any size is cut into ranges that use as much of a sketch as here, where 2 ** 16 cells stand for 2 ** 29."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = {}
    for text, in docs.select("text").collect():
        words = WORD.findall(text or "")
        for i in range(len(words) - 19):
            w = hash(tuple(words[i : i + 20]))
            seen[w] = seen.get(w, 0) + 1
    true = sum(n for n in seen.values() if n > 1)
    n_bytes = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert substring.ranges_for(n_bytes, 16) >= 3
    passed = substring.passed_windows(docs, most_bits=16).selectExpr("sum(run)").first()[0]
    # Repeats of a window by one and the same document's row only; `passed` counts each window once.
    assert true <= passed < 1.3 * true


def test_texts_without_an_id_are_told_apart(spark):
    """Two texts of equal 32-bit hash, both without an id."""
    r, seen, pair = np.random.default_rng(5), {}, None
    texts = [f"t{a:x} t{b:x}" for a, b in r.integers(0, 1 << 40, (160_000, 2))]
    for row in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "hash(text) as h").collect():
        if seen.setdefault(row.h, row.text) != row.text:
            pair = seen[row.h], row.text
            break
    assert pair
    long = words_text(rng(3), 50)
    rows = [(None, pair[0]), (None, pair[1]), (None, f"{long} {long}"), (None, long)]
    got = {x.text: (x.n_words, x.n_removed) for x in substring.remove_repeats(frame(spark, [t for _, t in rows], ids=[None] * 4)).collect()}
    assert got[pair[0]] == got[pair[1]] == (2, 0) and got[f"{long} {long}"][1] + got[long][1] == 100


def test_small_flushes(spark, monkeypatch):
    rows = list(enumerate(texts()))
    want = by_hand(rows, 20)
    monkeypatch.setattr(substring, "_FLUSH", 50)
    held = []
    docs = frame(spark, [t for _, t in rows])
    for r in substring.remove_repeats(docs).collect():
        held.append((r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.text])
    assert all(held)


def test_estimates_are_never_too_low():
    """Equal windows have equal anchors at different places."""
    r = np.random.default_rng(0)
    words = r.integers(0, 30, 4000).astype(np.uint64)
    words[2000:2100] = words[100:200]
    words[3000:3300] = 7
    place, anchor = substring._anchors(wordhash.rolling(wordhash.mix(words), 8, 11), 13)
    windows = {}
    for i in range(len(words) - 19):
        windows.setdefault(tuple(words[i : i + 20].tolist()), []).append(i)
    for own in windows.values():
        assert len({int(anchor[i]) for i in own}) == 1 and len({int(place[i]) for i in own}) == len(own)


def test_word_hashes(monkeypatch):
    import pyarrow as pa

    text = ["one two  one", None, "", "two\tone\n", "é one" + "z" * 50]
    data, offsets = wordhash.text_bytes(pa.array([t or "" for t in text]))
    starts, ends, docs = wordhash.word_spans(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["one", "two", "one", "two", "one", "é", "one" + "z" * 50] and docs.tolist() == [0, 0, 0, 3, 3, 4, 4]
    hashes = wordhash.word_hashes(data, starts, ends, 1)
    assert len(set(hashes.tolist())) == len(set(words))
    monkeypatch.setattr(wordhash, "BLOCK", 16)
    wordhash._powers.cache_clear()
    assert wordhash.word_hashes(data, starts, ends, 1).tolist() == hashes.tolist()
    wordhash._powers.cache_clear()
    adjacent, at = wordhash.text_bytes(pa.array(["ab", "cd"]))
    assert [a.tolist() for a in wordhash.word_spans(adjacent, at)] == [[0, 2], [2, 4], [0, 1]]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = docs.select("doc_id", "text").collect()
    want = by_hand([tuple(r) for r in rows], 2)
    got = substring.remove_repeats(docs, 2).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"score", "tail", "kept", "n_words"}
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.text]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = list(enumerate(texts()))
    frame(spark, [t for _, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    want = by_hand(rows, 20)
    for r in queries_substring.op6_substring_dedup(spark, str(tmp_path)).collect():
        n, removed, kept = want[r.doc_id, rows[r.doc_id][1]]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
