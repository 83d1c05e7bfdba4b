import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmine.functions import fixed
from quillmine.operators import answers, indexing, retrieval, versions

EVIDENCE = "qid long, rank int, document string, page int, text string, score double, source_type string, source_url string, section string, department string, crawled_at string"


def evidence(spark, *rows):
    return spark.createDataFrame(list(rows), EVIDENCE)


def item(qid, rank, document, page=1, text="body", kind="pdf", section=None):
    return (qid, rank, document, page, text, 0.5, kind, None, section, "registry", None)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def test_labels(spark):
    rows = evidence(spark, item(0, 1, "a.pdf", 3), item(0, 2, "w", None, section="s"), item(0, 3, "w", None))
    got = [r[0] for r in rows.orderBy("rank").select(answers.citation_label(F.col("document"), F.col("page"), F.col("section"))).collect()]
    assert got == ["【a.pdf，第 3 页】", "【w，s】", "【w】"]


def test_answers(spark):
    questions = asked(spark, "多少学分", "多少学分", "CSC3160 学分", "怎么学编程", "credits", "多少学分?")
    rows = evidence(
        spark, item(1, 1, "a.pdf"), item(1, 2, "b.pdf"), item(2, 1, "s.pdf", 5, "CSC3160 Operating Systems 3", "course_catalog"), item(3, 1, "a.pdf"), item(4, 1, "a.pdf", text="x"), item(5, 1, "a.pdf")
    )
    model = lambda p: F.when(F.contains(p, F.lit("多少学分?")), F.lit("没有引用")).when(F.contains(p, F.lit("credits")), F.lit(" ")).otherwise(F.lit("见【b.pdf，第 1 页】"))
    got = {r.qid: r for r in answers.answer(questions, rows, model).collect()}
    assert got[0].answer == fixed.REFUSALS["zh"] and not got[0].grounded and got[0].sources == []
    assert got[1].grounded and [s.document for s in got[1].sources] == ["b.pdf"] and got[1].sources[0].department_zh == "教务处"
    assert got[2].answer == "CSC3160 是 Operating Systems 3 【s.pdf，第 5 页】" and got[2].grounded
    assert got[3].grounded and got[3].disclaimer == fixed.DISCLAIMERS[fixed.LEARNING_PLAN] and got[3].sources == []
    assert got[4].answer == fixed.REFUSALS["en"]
    assert got[5].answer == fixed.REFUSALS["zh"] and not got[5].grounded


def test_from_question_to_answer(spark, tmp_path):
    """Index with vectors, search them, answer with citations; the history's question finds what the last one doesn't name."""
    names = ("library", "canteen", "visa")

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(n in t.lower()) for n in names])

    index = indexing.ChunkIndex(spark, f"file://{tmp_path}/i", encode=encode)
    rows = [(f"The {n} rules of the campus.", f"{n}.pdf", f"/{n}.pdf", 1, "m", n) for n in names]
    pages = spark.createDataFrame(rows, "text string, document string, source_path string, page int, modified_at string, sha256 string")
    assert index.update_documents(pages).indexed == 3
    more = pages.limit(0).unionByName(pages.where("page = 1 and sha256 <> 'visa'")).unionByName(spark.createDataFrame([("The visa office.", "visa.pdf", "/visa.pdf", 1, "m", "new")], pages.schema))
    assert index.update_documents(more).indexed == 1
    corpus = index.corpus()
    assert {r.document: list(r.vector) for r in corpus.collect()} == {n: v for n, v in zip([f"{n}.pdf" for n in names], ([1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]))}
    requests = spark.createDataFrame([(0, "library rules", None), (1, "and what are the rules there", [("user", "the canteen")]), (2, "swimming", [])], "qid long, text string, history array<struct<role:string,content:string>>")
    model = lambda p: F.concat_ws(" ", F.lit("See"), F.regexp_extract(p, r"证据 1 (【[^】]*】)", 1))
    got = {r.qid: r for r in answers.answer_questions(requests, corpus, model, backend=retrieval.vector_backend(encode)).collect()}
    assert got[0].answer == "See 【library.pdf，第 1 页】" and [s.document for s in got[0].sources] == ["library.pdf"]
    assert got[1].answer == "See 【canteen.pdf，第 1 页】" and not got[2].grounded and got[2].sources == []


def test_history(spark):
    turns = [(1, k, r, t) for k, (r, t) in enumerate([("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "d"), ("user", " e ")])]
    got = {r.turn: r["query"] for r in answers.history_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    mark = fixed.CONTEXT_MARK
    assert got == {1: "a", 3: f"a{mark}c", 4: f"a{mark}c{mark}d", 5: f"c{mark}d{mark}e"}


def test_requests(spark):
    schema = "question string, history array<struct<role:string,content:string>>"
    good, bad = answers.valid_requests(spark.createDataFrame([("q", []), ("q", None), ("", []), ("q", [("system", "x")]), ("q", [("user", "")]), (None, []), ("q", [("user", "x")] * 11)], schema))
    assert (good.count(), bad.count()) == (2, 5)


def test_prompt_has_what_the_model_needs(spark):
    questions = spark.createDataFrame([(0, "library hours", [("user", "hi"), ("assistant", "yo")])], "qid long, text string, history array<struct<role:string,content:string>>")
    got = answers.prompts(questions, evidence(spark, item(0, 1, "a.pdf", 2))).first().prompt
    for part in ("证据 1 【a.pdf，第 2 页】\nbody", "同学：hi\n助手：yo", "library hours", fixed.REFUSALS["en"], answers.LANGUAGE_RULES["en"]):
        assert part in got


@pytest.mark.parametrize(
    "title, year, wanted",
    [
        ("2023至24", 2023, True), ("2023-24", 2024, False), ("2022-23 and thereafter", 2024, True), ("2020至21年度至2024至25", 2022, True),
        ("2020至21年度及以后", 2019, False), ("2021至22、2022至23", 2022, True), ("none", 2022, False),
    ],
)
def test_applies_to_year(spark, title, year, wanted):
    assert spark.createDataFrame([(title,)], "t string").select(versions.applies_to_year(F.col("t"), F.lit(year))).first()[0] is wanted


def test_choose_document(spark):
    rows = [("m", 1, "2020至21及以后", "u1"), ("m", 2, "2023至24", "u2"), ("m", 3, "2021至22及以后", "u3"), ("n", 1, "2021至22及以后", "v1"), ("o", 1, "2019至20", "w1")]
    got = versions.choose_document(spark.createDataFrame(rows, "major string, ordinal int, title string, url string"), F.lit(2023), ["major"])
    assert {(r.major, r.url) for r in got.collect()} == {("m", "u2"), ("n", "v1")}


def test_scope_and_clarification(spark):
    a, b = "金融学_适用于2022至23年度入学学生.pdf", "金融学_适用于2023至24年度及以后入学学生.pdf"
    questions = asked(spark, "金融学要多少学分", "2023级金融学")
    rows = evidence(spark, *[item(q, k, d) for q in (0, 1) for k, d in enumerate((a, b, "手册.pdf"), 1)])
    kept, scopes = versions.answer_scope(questions, rows)
    assert sorted((r.qid, r["rank"]) for r in kept.collect()) == [(0, 1), (0, 3), (1, 1), (1, 2), (1, 3)]
    scope = scopes.collect()
    assert [(s.qid, s.document, s.options) for s in scope] == [(0, a, ["适用于2023至24年度及以后入学学生"])]
    cited = f"【{a}，第 1 页】"
    good = {r.qid: r for r in answers.ask(questions, rows, lambda p: F.lit(cited)).collect()}
    assert good[0].scope_notice.startswith("目前按适用于2022至23年度入学学生") and good[0].scope_options and good[1].scope_notice is None
    doubt = {r.qid: r for r in answers.ask(questions, rows, lambda p: F.lit("?")).collect()}
    assert doubt[0].needs_clarification and len(doubt[0].clarification_options) == 2 and not doubt[0].grounded
    assert doubt[1].needs_clarification is None and doubt[1].answer == fixed.REFUSALS["zh"]
