import time
import zlib

import pytest

from quillmine.llm import queries_toxicity, toxicity
from tests.llm.helpers import frame, odd_docs, rng, words_text


def corpus(spark, n=600):
    r = rng(3)
    bad = ["zorgle", "blatfink", "snarvile"]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = words_text(r, r.randint(10, 60)).split()
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(bad))
        elif i % 29 == 0:
            words[3:3] = ["kindly", "snarvile"]  # an exception phrase
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus(spark)
    return toxicity.fit(docs, toxicity.training_labels(labels))


def test_held_out_accuracy(spark, model):
    docs, labels = corpus(spark)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert len(rows) > 100 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_disguises_and_length(model):
    hit = model.signals("so zorgle you")
    assert hit[0] > 0
    for text in ("so Z0RGLE you", "so zоrgle you", "so ｚｏｒｇｌｅ you", "so zor​gle you", "so z0rg1e you".replace("1", "l")):
        assert model.signals(text)[0] == hit[0], text
    assert model.signals("so zorgle you " + "v1 " * 500)[2] < hit[2]
    assert model.signals("kindly snarvile")[0] == 0 < model.signals("old snarvile")[0]


def test_one_and_bar_stand_for_l_and_i(model):
    hit = model.signals("so zorgle you")
    for text in ("so z0rg1e you", "so zorg|e you", "so zorg!e you", "so ZORGIE you"):
        assert model.signals(text)[0] == hit[0], text
    start = toxicity.ToxicityModel({toxicity.fold("clown"): 1.0, toxicity.fold("loser"): 1.0})
    assert all(start.signals(t)[0] == 1.0 for t in ("a clown", "a c1own", "a c|own", "a c!own", "a 1oser", "a lоser", "a ӏoser"))
    assert start.signals("a crown")[0] == 0


def test_given_exceptions(spark):
    docs, labels = corpus(spark)
    told = toxicity.fit(docs, labels, exceptions=["zorgle grass"])
    assert told.signals("the Zorgle  grass grows")[0] == 0 < told.signals("the zorgle grows")[0]


def test_matching_against_substrings(model):
    r = rng(5)
    for _ in range(50):
        text = words_text(r, 20) + " " + r.choice(["zorgle", "blatfinks", "x"])
        folded = toxicity.fold(text)
        best = max((w for e, w in model.weights.items() if e in folded), default=0.0)
        assert model.signals(text)[0] == pytest.approx(best)


def test_odd_rows(spark, model):
    rows = toxicity.score(odd_docs(spark), model).collect()
    assert len(rows) == 10
    nothing = float(model.score(__import__("numpy").array([model.signals("")]))[0])
    assert all(r.score == pytest.approx(nothing) for r in rows if r.doc_id in (2, 3))
    assert toxicity.score(odd_docs(spark).limit(0), model).count() == 0
    kept = toxicity.score(odd_docs(spark), model, keep=["doc_id", "text", "kept"])
    assert kept.columns[:3] == ["doc_id", "text", "kept"]


def test_no_labels(spark):
    docs, labels = corpus(spark, 20)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("cast(null as long) doc_id", "quality", "toxic")):
        empty = toxicity.fit(docs, some)
        assert empty.weights == {} and {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_query(spark):
    rows = queries_toxicity.op1_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)


def test_a_long_text_of_exceptions_takes_linear_time():
    model = toxicity.ToxicityModel({" idiot ": 2.0, " other ": 1.0}, (" iovabie idiot ",), ())
    automaton = model.automaton()
    spent = []
    for n in (20_000, 80_000):
        text = "lovable idiot " * n + "idiot"
        start = time.perf_counter()
        signals = model.signals(text, automaton)
        spent.append(time.perf_counter() - start)
        assert signals[0] == 2.0
    assert spent[1] < 12 * spent[0] + 0.5
