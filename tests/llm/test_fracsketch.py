import hashlib

import xxhash
from pyspark.sql import functions as F

from quillmine.llm import fracsketch, queries_fracsketch
from tests.llm.helpers import WORD, frame, odd_docs, rng, words_text


def shingle_hashes(text):
    """Spark's hashes of five-word shingles: a word's hash, and the hashes of five words in a chain."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [xxhash.xxh64_intdigest((w if isinstance(w, bytes) else w.encode()), 42) for w in WORD.findall(text)]

    def chain(part):
        held = 42
        for w in part:
            held = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), held)
        return signed(held)

    return {chain(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def sketch_by_hand(hashes, parts=(4, 2)):
    for k in parts:
        kept = {h for h in hashes if h < -(1 << 63) + (1 << 64) // k}
        if len(kept) >= 16:
            return kept, -(1 << 63) + (1 << 64) // k - 1
    return hashes, (1 << 63) - 1


def near_by_hand(a, b):
    (x, lx), (y, ly) = sketch_by_hand(a), sketch_by_hand(b)
    x, y = ({h for h in s if h <= min(lx, ly)} for s in (x, y))
    if not x or not y:
        return float(len(x) == len(y))
    return len(x & y) / min(len(x), len(y))


def ring_by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return {r[0]: (r[1] or "", order[(k + 1) % len(order)][1] or "") for k, r in enumerate(order)}


def test_ring(spark):
    texts = [f"text {i}" for i in range(57)] + ["", None]
    ids = [i * i - 40 for i in range(59)]
    want = ring_by_hand(list(zip(ids, texts)))
    for rows in (1, 7, 1000):
        got = fracsketch.neighbours(frame(spark, texts, ids=ids), bucket_rows=rows).collect()
        assert {r.doc_id: (r.text, r.next_text) for r in got} == want and len(got) == 59


def test_sketch_by_hand(spark):
    r = rng(4)
    texts = ["", "one", "a b c d e f g a b c d e", *(words_text(r, n) for n in (4, 5, 10, 19, 20, 40, 46, 50, 54, 70, 200, 2000))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("s", fracsketch.sketch(F.col("t")))
    got = rows.select("k", "s", fracsketch.limit(F.col("s")), fracsketch.as_text(F.col("s"))).orderBy("k").collect()
    for (k, s, last, shown), text in zip(got, texts):
        want, limit = sketch_by_hand(shingle_hashes(text))
        assert (s, last) == (sorted(want), limit)
        assert [int.from_bytes(bytes.fromhex(shown[i : i + 16]), "big", signed=True) for i in range(0, len(shown), 16)] == s
    assert len({g[2] for g in got}) == 3
    for scale, parts in ((1, ()), (2, (2,)), (8, (8, 4, 2))):
        text = texts[-2]
        assert spark.createDataFrame([(text,)], "t string").select(fracsketch.sketch(F.col("t"), scale=scale)).first()[0] == sorted(sketch_by_hand(shingle_hashes(text), parts)[0])


def test_containment_is_estimated(spark):
    r = rng(6)
    whole = words_text(r, 6000, 5000)
    part = " ".join(whole.split()[:1000])
    other = words_text(r, 3000, 5000)
    rows = spark.createDataFrame([(whole, part), (whole, other), (whole, whole), ("", ""), ("", whole), ("a b", "a b")], "a string, b string")
    got = [x[0] for x in rows.select(fracsketch.containment(fracsketch.sketch(F.col("a")), fracsketch.sketch(F.col("b")))).collect()]
    assert got[0] == 1.0 and got[1] < 0.02 and got[2:] == [1.0, 1.0, 0.0, 1.0]
    mixed = spark.createDataFrame([(f"{part} {other}", whole)], "a string, b string").select(fracsketch.containment(fracsketch.sketch(F.col("a")), fracsketch.sketch(F.col("b")))).first()[0]
    assert abs(mixed - 0.25) < 0.08


def test_near_by_hand(spark):
    """Texts of all lengths against each other: equal levels, unequal ones, empty ones."""
    r = rng(8)
    texts = ["", "a b", *(words_text(r, n, 60) for n in (3, 6, 12, 25, 40, 60, 90, 300))]
    texts += [f"{t} {u}" for t, u in zip(texts, texts[1:])]
    pairs = [(a, b) for a in texts for b in texts]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").withColumn("x", fracsketch.sketch(F.col("a"))).withColumn("y", fracsketch.sketch(F.col("b")))
    got = [g[0] for g in rows.orderBy("k").select(fracsketch.near(F.col("x"), F.col("y"))).collect()]
    assert got == [near_by_hand(shingle_hashes(a), shingle_hashes(b)) for a, b in pairs]
    assert 0.0 < sum(got) / len(got) < 1.0


def test_merged_sketches_are_those_of_the_union(spark):
    r = rng(11)
    texts = [(k % 9, words_text(r, 5 + (k % 9) * (k % 4) * 9)) for k in range(27)] + [(8, "")]
    rows = spark.createDataFrame(texts, "g int, t string")
    got = rows.withColumn("s", fracsketch.sketch(F.col("t"))).groupBy("g").agg(fracsketch.merged(F.col("s")).alias("s")).collect()
    want = {g: sorted(sketch_by_hand(set().union(*(shingle_hashes(t) for k, t in texts if k == g)))[0]) for g in range(9)}
    assert {x.g: x.s for x in got} == want


def test_merging(spark):
    r = rng(7)
    a, b = words_text(r, 300), words_text(r, 300)
    rows = spark.createDataFrame([(1, a), (1, b), (2, None), (2, "")], "g int, t string").withColumn("s", fracsketch.sketch(F.coalesce("t", F.lit(""))))
    got = {x.g: x.s for x in rows.groupBy("g").agg(fracsketch.merged(F.col("s")).alias("s")).collect()}
    own = [x.s for x in rows.where("g = 1").collect()]
    assert got[1] == sorted(set(own[0]) | set(own[1])) and got[2] == []


def test_odd_rows(spark):
    got = fracsketch.neighbours(odd_docs(spark)).collect()
    assert len(got) == 10 and all(r.text is not None and r.next_text is not None for r in got)
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got)
    assert fracsketch.neighbours(odd_docs(spark).limit(0)).count() == 0
    (alone,) = fracsketch.neighbours(frame(spark, ["just one"])).collect()
    assert alone.next_text == "just one"


def test_smallest_id(spark):
    docs = frame(spark, ["a", "b", "c"], ids=[-(1 << 63), 0, 5])
    assert {r.text: r.next_text for r in fracsketch.neighbours(docs).collect()} == {"c": "b", "b": "a", "a": "c"}


def test_no_python_in_the_plan(spark):
    plan = queries_fracsketch.op9_scaled_sketch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ring = ring_by_hand(docs)
    rows = queries_fracsketch.op9_scaled_sketch(spark, sf).collect()
    seen = {}
    for r in rows:
        text, after = ring[r.doc_id]
        half = len(text) // 2
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        own, edited = shingle_hashes(text), shingle_hashes(text[: len(text) - half] + after[:half])
        assert (r.near_edited, r.near_next) == (near_by_hand(own, edited), near_by_hand(own, shingle_hashes(after)))
        assert r.edited_fingerprint == "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(sketch_by_hand(edited)[0]))
    assert sum(r.near_edited for r in rows) / len(rows) > 0.4 > 0.1 > sum(r.near_next for r in rows) / len(rows)
