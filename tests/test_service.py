import pytest

from quillmine.operators import indexing, service
from quillmine.operators.rules import RULES_SCHEMA
from quillmine.operators.service import Transcripts, health
from quillmine.plans.web_queries import RULES, TRANSCRIPT


@pytest.fixture
def store(spark, tmp_path):
    return Transcripts(spark, f"file://{tmp_path}/t")


def pages(spark):
    return spark.createDataFrame(TRANSCRIPT, "key string, page int, text string")


def requests(spark, *rows):
    return spark.createDataFrame(rows, "key string, programme string, admission_year int")


def test_health(spark, tmp_path):
    index = indexing.ChunkIndex(spark, f"file://{tmp_path}/i")
    assert health(index) == "degraded"
    index.update_documents(spark.createDataFrame([("text", "a.pdf", "/a.pdf", 1, "m", "1")], "text string, document string, source_path string, page int, modified_at string, sha256 string"))
    assert health(index) == "ready"


def test_parse_check_delete(spark, store):
    rules = spark.createDataFrame(RULES, RULES_SCHEMA)
    parsed = {r.key: r for r in store.parse(pages(spark)).collect()}
    assert parsed["s1"].programme == "Data Science" and [c.course_code for c in parsed["s1"].courses][:2] == ["MAT1001", "CSC1001"]
    assert parsed["s2"].courses == []
    asked = requests(spark, ("s1", None, None), ("s2", None, None), ("s2", "Unknown", 2023), ("gone", "Data Science", 2023))
    report, groups, refused = store.check(asked, rules)
    assert [r.key for r in report.collect()] == ["s1"] and {g.key for g in groups.collect()} == {"s1"}
    assert sorted(map(tuple, refused.collect())) == sorted([("s2", *service.INCOMPLETE), ("s2", *service.NO_RULES), ("gone", *service.GONE)])
    # A year of one's own counts before the transcript's.
    assert store.check(requests(spark, ("s1", "ds", 1990)), rules)[2].first().status == 422
    store.delete(spark.createDataFrame([("s1",)], "key string"))
    assert store.check(requests(spark, ("s1", None, None)), rules)[2].first().status == 404


def test_nothing_was_ever_parsed(spark, store):
    report, _, refused = store.check(requests(spark, ("s1", "Data Science", 2023)), spark.createDataFrame(RULES, RULES_SCHEMA))
    assert report.count() == 0 and refused.first().status == 404
