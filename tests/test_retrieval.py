import math
import random
from collections import Counter
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmine.functions.config import Settings
from quillmine.operators import evaluation, fusion, lexical, retrieval, vectors
from quillmine.plans import retrieval_queries

CORPUS = [
    (0, "图书馆开放时间为 8:00 至 22:00", "guide.pdf", 1),
    (1, "The library opens at eight and closes at ten", "guide.pdf", 2),
    (2, "奖学金申请需要成绩单", "aid.pdf", 1),
    (3, "Scholarship applications need a transcript", "aid.pdf", 2),
    (4, "金融学 需要 120 学分", "金融学_适用于2023至24年度入学学生.pdf", 1),
    (5, "统计学 需要 120 学分", "统计学_适用于2023至24年度入学学生.pdf", 1),
]


def corpus(spark):
    return spark.createDataFrame(CORPUS, "ordinal long, text string, document string, page int")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def evidence(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "qid long, document string, page int, text string, score double, ordinal long")


def test_keyword_scores(spark):
    docs = lexical.tokenized(spark.createDataFrame([(0, "aa bb bb cc"), (1, ""), (2, "zz"), (3, None)], "ordinal long, text string"))
    questions = asked(spark, "aa bb bb bb", "", "zz zz")
    assert {(r.qid, r.ordinal): r.score for r in lexical.keyword_scores(docs, questions, ["qid"], 5).collect()} == {(0, 0): 0.75, (2, 2): 0.5}
    pairs = spark.createDataFrame([(0, 0), (0, 2), (2, 2)], "qid long, ordinal long")
    assert {(r.qid, r.ordinal): r.score for r in lexical.pair_scores(pairs, docs, questions, ["qid"]).collect()} == {(0, 0): 0.75, (2, 2): 0.5}
    assert lexical.keyword_scores(docs.limit(0), questions, ["qid"], 5).count() == 0 == lexical.keyword_scores(docs, questions.limit(0), ["qid"], 5).count()


def test_questions_in_batches(spark, monkeypatch):
    """The same best rows, ties by ordinal, however questions and documents are cut."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(25))) for _ in range(90)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "ordinal long, text string")
    questions = asked(spark, *texts[:23])
    index = lexical.build_index(corpus)
    tokens = lexical.asked_tokens(questions, ["qid"])

    def found():
        return [sorted((x.qid, x.rank, x.ordinal, round(x.score, 9)) for x in lexical.top(s, ["qid"], 4).collect()) for s in (lexical.keyword_scores(index.documents, questions, ["qid"], 4), lexical.bm25(index, tokens, 4))]

    want = found()
    overlap = []
    for q, text in enumerate(texts[:23]):
        own = Counter(text.split())
        scored = sorted((-sum((own & Counter(t.split())).values()) / max(1, sum(own.values())), d) for d, t in enumerate(texts))
        overlap += [(q, k, d, round(-s, 9)) for k, (s, d) in enumerate((x for x in scored[:4] if x[0] < 0), 1)]
    assert want[0] == overlap
    monkeypatch.setattr(lexical, "QUESTIONS", 5)
    monkeypatch.setattr(lexical, "DOCUMENTS", 7)
    assert found() == want


def test_bm25_against_plain_python(spark):
    docs = ["aa bb cc", "aa aa dd", "ee", "bb aa"]
    index = lexical.build_index(spark.createDataFrame(list(enumerate(docs)), "ordinal long, text string"))
    words = [d.split() for d in docs]
    mean = sum(map(len, words)) / len(words)
    idf = lambda t: math.log(1 + (4 - sum(t in w for w in words) + 0.5) / (sum(t in w for w in words) + 0.5))
    want = {k: sum(idf(t) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in ("aa", "dd")) for k, w in enumerate(words) if (c := Counter(w)) and ("aa" in c or "dd" in c)}
    tokens = spark.createDataFrame([(1, "aa"), (1, "dd"), (1, "aa"), (1, "nope")], "qid long, token string")
    assert {r.ordinal: pytest.approx(r.score) for r in lexical.bm25(index, tokens, 9).collect()} == want


@pytest.mark.parametrize("metric, distance, wanted", [("cosine", 0.2, 0.8), ("cosine", -0.1, 1.0), ("cosine", 1.5, 0.0), ("l2", 1.0, 0.5), ("ip", 0.25, 0.75)])
def test_relevance(spark, metric, distance, wanted):
    assert spark.range(1).select(vectors.relevance(F.lit(distance), metric)).first()[0] == pytest.approx(wanted)


def test_relevance_of_unknown_metric(spark):
    with pytest.raises(ValueError):
        vectors.relevance(F.lit(1.0), "x")


def test_nearest(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None)], "ordinal long, vector array<double>")
    ask = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "qid long, vector array<double>")
    assert [(r.qid, r.ordinal, r["rank"]) for r in vectors.nearest(rows, ask, 2).orderBy("rank").collect()] == [(7, 0, 1), (7, 2, 2)]


def test_nearest_in_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "ordinal long, vector array<double>")
    ask = spark.createDataFrame([(f"q{i}", [float(i), 1.0]) for i in range(12)], "qid string, vector array<double>")
    got = []
    for most in (1 << 20, 40):
        monkeypatch.setattr(vectors, "MOST_QUERY_BYTES", most)
        got.append(sorted((r.qid, r.ordinal, r.distance, r["rank"]) for r in vectors.nearest(rows, ask, 3, "l2").collect()))
    assert got[0] == got[1] and len(got[0]) == 36 and [g[:2] for g in got[0] if g[3] == 1 and g[0] == "q7"] == [("q7", 7)]
    assert vectors.nearest(rows, ask.limit(0), 3).schema["qid"].dataType.simpleString() == "string"


def test_fusion(spark):
    rows = [(1, 1, 1, "a", None, "x"), (1, 1, 2, "b", 2, "y"), (1, 2, 1, "b", 2, "y"), (1, 2, 2, "a", None, "x"), (1, 2, 3, "c", 1, "z")]
    lists = spark.createDataFrame(rows, "qid long, list int, rank int, document string, page int, text string").withColumn("payload", F.col("list"))
    got = [(r.document, r.score, r.payload) for r in fusion.reciprocal_rank_fusion(lists).orderBy(F.desc("score"), "ordinal").collect()]
    assert [g[0] for g in got] == ["a", "b", "c"] and got[0][1] == 1.0 and got[2][1] < 1 and got[0][2] == 2


def test_deduplicate(spark):
    rows = [("d", 1, "A  b", 0.5, 1), ("d", 1, "a b", 0.9, 2), ("d", 2, "a b", 0.5, 3), ("d", None, "a b", 0.9, 4), ("d", None, "A B", 0.9, 5)]
    got = [(r["rank"], r.page, r.text, r.score) for r in fusion.deduplicate(evidence(spark, rows), 3).orderBy("rank").collect()]
    assert got == [(1, 1, "a b", 0.9), (2, None, "a b", 0.9), (3, 2, "a b", 0.5)]


def test_diversify(spark):
    rows = [("a", 1, f"t{k}", 0.9 - k / 100, k) for k in range(4)] + [("b", 1, "u", 0.5, 9), ("c", 1, "v", 0.4, 10)]
    got = [r.text for r in fusion.diversify(evidence(spark, rows), 4, 2).orderBy("rank").collect()]
    assert got == ["t0", "u", "v", "t1"]
    assert [r.text for r in fusion.diversify(evidence(spark, rows), 2, 2).orderBy("rank").collect()] == ["t0", "u"]


def test_variants(spark):
    prepared = retrieval.prepare(asked(spark, "Library hours", "bios", "圖書館"), Settings())
    got = {}
    for r in retrieval.variants(prepared).orderBy("qid", "vno").collect():
        got.setdefault(r.qid, []).append(r.text)
    assert got == {0: ["Library hours", "图书馆", "library"], 1: ["bios"], 2: ["圖書館", "图书馆", "library"]}


def test_targets(spark):
    prepared = retrieval.prepare(asked(spark, "金融学要多少学分", "统计学和金融学"), Settings())
    got = {(r.qid, r.document[:3]) for r in retrieval.target_documents(prepared, corpus(spark)).collect()}
    assert got == {(0, "金融学"), (1, "金融学"), (1, "统计学")}


def test_retrieve(spark):
    found = retrieval.retrieve(asked(spark, "图书馆开放时间", "scholarship transcript", "金融学 需要 120 学分", "nothing at all here"), corpus(spark))
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.document, r.page))
    assert got[0][0] == ("guide.pdf", 1) and got[1][0] == ("aid.pdf", 2)
    assert {d for d, _ in got[2]} == {"金融学_适用于2023至24年度入学学生.pdf"}
    assert 3 not in got


def test_catalogue_comes_first(spark):
    catalogue = spark.createDataFrame(
        [(0, "CSC3160", "s.pdf", "4", "CSC3160"), (1, "CSC3160", "s.pdf", "5", "CSC3160 Operating Systems 3"), (2, "CSC3160", "s.pdf", "6", "CSC3160 Operating Systems 3"), (3, "MAT1001", "s.pdf", "5", "MAT1001 Calculus 3")],
        "ordinal long, course_code string, source_document string, page string, excerpt string",
    )
    rows = retrieval.retrieve(asked(spark, "what about csc 3160?"), corpus(spark), catalogue=catalogue).collect()
    assert [(r.text, r.page, r.score, r.source_type) for r in rows] == [("CSC3160 Operating Systems 3", 5, 1.0, "course_catalog")]


def test_reranker_and_threshold(spark):
    settings = replace(Settings(), reranker_enabled=True, similarity_threshold=0.1)
    found = retrieval.retrieve(asked(spark, "需要 学分 120"), corpus(spark), settings, reranker=lambda q, t: F.when(F.contains(t, F.lit("统计")), 0.9).otherwise(0.1))
    assert found.orderBy("rank").first().text.startswith("统计学")
    with pytest.raises(ValueError):
        retrieval.retrieve(asked(spark, "x"), corpus(spark), settings)


def test_web_evidence_has_no_page(spark):
    rows = corpus(spark).limit(1).withColumn("source_type", F.lit("web")).withColumn("source_url", F.lit("u"))
    got = retrieval.retrieve(asked(spark, "图书馆开放时间"), rows).first()
    assert got.page is None and got.source_url == "u"


def test_evaluate(spark):
    cases = spark.createDataFrame(
        [(0, "图书馆开放时间", "guide.pdf", [1], False), (1, "quantum chromodynamics lattice", None, None, True)],
        "qid long, question string, relevant_document string, relevant_pages array<int>, should_refuse boolean",
    )
    got = evaluation.evaluate(cases, corpus(spark)).first().asDict()
    assert got.pop("average_response_time_ms") > 0
    assert got == dict.fromkeys(("recall_at_5", "mrr_at_10", "page_hit_rate", "refusal_accuracy", "retrieval_hit_rate", "citation_accuracy"), 1.0)


def test_empty_tables(spark):
    none = corpus(spark).limit(0)
    assert retrieval.retrieve(asked(spark, "图书馆"), none).count() == 0
    assert retrieval.retrieve(asked(spark, "图书馆").limit(0), corpus(spark)).count() == 0


def test_every_document_that_has_a_passage_counts(spark, tmp_path):
    """Passages within words, after other signs, of few words, of no whole word and empty ones, as in SQL."""
    whole = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [None, "nothing to see", f'Intro "{whole}" end', f"{whole} x", "pre(short question).", "one two three four five six seven eight. More", "says: lead word here of it all again and again", "donaudampfschifffahrt", ""]
    asked = [whole, "short question", "one two three four five six seven eight", " lead word here of it all again and", "dampfschiff", "absent thing", "pha beta gamma delta epsilon zeta eta theta", None, ""]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gold = {r.qid: r.relevant_document for r in retrieval_queries._cases(spark, str(tmp_path)).collect()}
    assert gold == {0: "d2", 1: "d4", 2: "d5", 3: "d6", 4: "d7", 5: None, 6: "d2", 7: None, 8: "d1"}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.sql(retrieval_queries.SQL["eval_metrics"])
    assert retrieval_queries.eval_metrics(spark, str(tmp_path)).first().asDict() == dict(zip(found.columns, found.fetchall()[0]))
