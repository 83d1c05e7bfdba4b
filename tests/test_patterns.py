import random
import re

import pytest
from pyspark.sql import functions as F

from quillmine.functions import fixed
from quillmine.functions.conversion import Conversion
from quillmine.functions.text import search_form, search_text, tokens
from quillmine.operators import patterns, retrieval


def brute(texts, wanted, bounded):
    out = []
    for key, text in texts:
        for p in set(filter(None, wanted)):
            for at in range(len(text or "") - len(p) + 1):
                beside = (text[at - 1 : at] if at else "") + text[at + len(p) : at + len(p) + 1]
                if text.startswith(p, at) and not (bounded and re.search("[a-z0-9]", beside)):
                    out.append((key, p, at))
    return sorted(out)


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("most", [None, 120, 30])
def test_occurrences(spark, bounded, most):
    """Nested, overlapping and repeated patterns, in one automaton or in parts; a character that has most of them."""
    r = random.Random(1)
    word = lambda n: "".join(r.choice("aaab书 馆1") for _ in range(n))
    texts = [(i, word(r.randrange(0, 50))) for i in range(40)] + [(90, None), (91, ""), (91, "aa a1 书馆")]
    wanted = [word(r.randrange(1, 5)) for _ in range(30)] + ["a", "a", "aa", "", None, "书馆"]
    found = patterns.occurrences(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in wanted], "pattern string"), ["id"], bounded, most)
    assert sorted(map(tuple, found.collect())) == brute(texts, wanted, bounded)


@pytest.mark.parametrize("most", [None, 30])
def test_contained(spark, most):
    """As `in`: inside words, with spaces, several places once; an empty pattern is in every text, a null one in none."""
    texts = [(0, 'say "aab b" a'), (1, "aaaaaa"), (2, "书馆 1"), (3, ""), (4, None)]
    wanted = ["aab b", "b", "aa", "a", "aa", " ", '"a', "馆 1", "aab  b", "A", "", "", None]
    found = patterns.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in wanted], "pattern string"), ["id"], most)
    assert sorted(map(tuple, found.collect())) == sorted((i, w) for i, t in texts for w in set(wanted) if None not in (t, w) and w in t)


def test_no_patterns_or_texts(spark):
    texts = spark.createDataFrame([(1, "x")], "id int, text string")
    none = spark.createDataFrame([], "pattern string")
    assert patterns.occurrences(texts, none, ["id"]).count() == 0 == patterns.occurrences(texts.limit(0), none.union(spark.createDataFrame([("x",)], "pattern string")), ["id"]).count()


def test_groups_are_those_of_the_question_variants(spark):
    asked = ["where is the LIBRARY", "credits of electives", "biology", "bio", "symbiosis", "学生证 and 校园卡", "奖学金申请", "osaka", "nothing"]
    questions = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    groups = spark.createDataFrame([(g, search_form(m)) for g, members in enumerate(fixed.SYNONYM_GROUPS) for m in members], "group int, pattern string")
    forms = questions.select("qid", search_text(F.col("text")).alias("text"))
    found = {(r.qid, r.group) for r in patterns.named_groups(forms, groups, ["qid"]).collect()}
    variants = questions.select("qid", retrieval.query_variants(search_text(F.col("text")), F.col("text")).alias("v")).collect()
    want = {(r.qid, g) for r in variants for g, members in enumerate(fixed.SYNONYM_GROUPS) if set(members) <= set(r.v)}
    assert found == want and len(found) > 5


def test_longest_names(spark):
    names = spark.createDataFrame([("a.pdf", "data"), ("b.pdf", "data science"), ("c.pdf", "data science"), ("d.pdf", "law")], "name string, pattern string")
    asked = spark.createDataFrame([(1, "about data science"), (2, "law and data"), (3, "none")], "qid long, text string")
    found = sorted((r.qid, r.name) for r in patterns.longest_named(asked, names, ["qid"]).collect())
    assert found == [(1, "b.pdf"), (1, "c.pdf"), (2, "a.pdf")]


def test_conversion_takes_the_longest_match(spark):
    own = Conversion.from_lines(["後 \t后", "皇后\t皇后", "頭髮\t头发", "髮\t发 髪", "理髮店\t理发店", "bad line", "\t x"], {"頭": "头", "後": "后"})
    assert own.convert("皇后後頭髮理髮店髮") == "皇后后头发理发店发" and own.convert("plain") == "plain" and own.convert("") == ""
    rows = spark.createDataFrame([("頭髮", "头发"), ("頭髮", "zz"), ("頭", "头"), ("", "x"), ("y", None)], "phrase string, form string")
    table = Conversion.from_table(rows)
    assert table.table == {"頭髮": "头发", "頭": "头"} or table.table["頭髮"] == "zz"
    texts = spark.createDataFrame([("頭髮  A",), (None,), ("plain TEXT",)], "text string")
    assert [r[0] for r in texts.select(search_text(F.col("text"), conversion=own)).collect()] == ["头发 a", None, "plain text"]
    assert texts.select(tokens(F.col("text"), conversion=own)).first()[0] == ["头", "发", "头发"]
    assert [r[0] for r in texts.select(own.column(F.col("text"))).collect()] == ["头发  A", None, "plain TEXT"]


def test_conversion_is_bounded(monkeypatch):
    monkeypatch.setattr(Conversion, "MOST_ENTRIES", 1)
    with pytest.raises(ValueError):
        Conversion({"a": "b", "c": "d"})
