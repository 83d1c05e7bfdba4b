import pytest
from pyspark.sql import functions as F

from quillmine.operators import records, rules

HEAD = "Course Code   Course Title      Units  Grade  Percentage"
PAGES = [
    (
        "s", 1,
        f"Major / Programme: Data Science\nAdmitted in: September 2023\n2022–23 Term 1\n{HEAD}\nMAT 1001  Calculus I   3  A-  88\nCSC1001 Intro-\n\nCSC1002 Programming-\n"
        f"CSC1002 Programming and Self- 3.0 b+ 81\n      study\n      more\n   near\nENG1001 Broken\n      lost\nUnits Passed = 6\nPHY1001 Outside 3 A 90",
    ),
    ("s", 2, f"MAT2002 No table 3 A 90\n2022-23 Term 2\n{HEAD}\n* note\n{HEAD}\nMAT 1001 Calculus I 3 IP N/A\nCumulative Units Passed = 6.5\n累计已获学分 = 4"),
    ("s", 3, " \n "),
    ("s", 4, "tail"),
    ("s", 5, ""),
    ("blank", 1, ""),
    ("blank", 2, None),
]


def parsed(spark):
    return records.parse_transcripts(spark.createDataFrame(PAGES, "key string, page int, text string"))


def test_courses(spark):
    got = [(r.course_code, r.course_name, r.credits, r.grade, r.term, r.status, r.source_page) for r in parsed(spark)[0].orderBy("ordinal").collect()]
    assert got == [
        ("MAT1001", "Calculus I", 3.0, "A-", "2022-23 Term 1", "passed", 1),
        ("CSC1002", "Programming and Self-study more", 3.0, "B+", "2022-23 Term 1", "passed", 1),
        ("MAT1001", "Calculus I", 3.0, "IP", "2022-23 Term 2", "in_progress", 2),
    ]


def test_records(spark):
    got = {r.key: r for r in parsed(spark)[1].collect()}
    assert (got["s"].programme, got["s"].admission_year, got["s"].total_credits_reported) == ("Data Science", 2023, 6.5)
    assert [w.split(" 字段")[0] for w in got["s"].warnings] == ["第 1 页课程 CSC1001", "第 1 页课程 CSC1002", "第 1 页课程 ENG1001", "第 3 页没有文本，可能需要 OCR"]
    assert got["blank"].warnings == ["第 1 页没有文本，可能需要 OCR", "第 2 页没有文本，可能需要 OCR", records.NO_COURSES]


def test_many_rows(spark):
    grades = ["A"] * 32 + ["IP"] * 5
    text = "2023-24 Term 1\n" + HEAD + "\n" + "\n".join(f"CSC{1000 + k} Course {k} 3 {g} N/A" for k, g in enumerate(grades))
    courses, found = records.parse_transcripts(spark.createDataFrame([("t", 1, text)], "key string, page int, text string"))
    row = records.transcript_summary(courses).first()
    assert (row.passed, row.in_progress, row.passed_credits) == (32, 5, 96.0) and found.first().warnings == []


@pytest.mark.parametrize("grade, wanted", [("wd", "withdrawn"), ("IP", "in_progress"), ("U", "failed"), ("pa", "passed"), ("Z", "unknown"), (None, "unknown"), ("及格", "passed")])
def test_status(spark, grade, wanted):
    assert spark.createDataFrame([(grade,)], "g string").select(records.grade_status(F.col("g"))).first()[0] == wanted


def test_catalogue(spark):
    rows = [
        ("s.pdf", "/d/study_schemes/s.pdf", 1, "Course Code list\nCSC3160 Operating\n Systems 3,\nMAT1001 Calculus 3"),
        ("s.pdf", "/d/study_schemes/s.pdf", 2, "Course code CSC3160 Operating Systems 3,"),
        ("s.pdf", "/d/study_schemes/s.pdf", 3, "II. Core PHY1001 Physics 4; none" + " x" * 60 + " CHM1001 far"),
        ("o.pdf", "/d/other/o.pdf", 1, "Course Code CSC9999 X 3"),
    ]
    got = {tuple(r) for r in records.course_catalogue(spark.createDataFrame(rows, "document string, source_path string, page int, text string")).collect()}
    assert ("CSC3160", "s.pdf", "2", "CSC3160 Operating Systems 3") in got and ("MAT1001", "s.pdf", "1", "MAT1001 Calculus 3") in got
    assert {g[0] for g in got} == {"CSC3160", "MAT1001", "PHY1001"}


def test_requirements(spark):
    taken = [("k", 1, "mat 1001", 3.0, "failed"), ("k", 2, "MAT1001", 3.0, "passed"), ("k", 3, "MAT1001", 4.0, "passed"), ("k", 4, "STA2001", 3.0, "in_progress"), ("k", 5, "CSC1001", None, "transferred")]
    courses = spark.createDataFrame(taken, "key string, ordinal int, course_code string, credits double, status string")
    groups = [
        ("all", "All", "all_of", 6.0, None, ["MAT1001", "STA2001", "ENG1001"]), ("one", None, "one_of", 3.0, None, ["STA2001", "PHY1001"]),
        ("met", "Met", "one_of", 3.0, None, ["CSC1001", "CSC1002"]), ("n", "N", "choose_n", 9.0, 2, ["CSC1001", "CSC1003", "CSC1004"]), ("none", "E", "all_of", None, None, []),
    ]
    book = spark.createDataFrame([("Data  Science", ["DS"], 2020, None, 10.0, groups, ["look"]), ("Other", None, None, None, 0.0, [], None)], rules.RULES_SCHEMA)
    who = spark.createDataFrame([("k", " data science ", 2023), ("early", "DS", 2019), ("o", "other", 1990)], "key string, programme string, admission_year int")
    report, shown = rules.check_requirements(courses, rules.rules_for(who, book))
    got = {r.key: r for r in report.collect()}
    assert set(got) == {"k", "o"} and got["o"].overall_status == "satisfied_for_computable_rules"
    k = got["k"]
    assert (k.earned, k.required, k.remaining, k.missing_required_courses, k.manual_review_items) == (4.0, 10.0, 6.0, ["CSC1003", "ENG1001", "PHY1001"], ["look"])
    by = {r.id: r for r in shown.where("key = 'k'").collect()}
    assert by["all"].in_progress_courses == ["STA2001"] and by["one"].name == "one" and by["none"].required_count == 0 and by["n"].completed_count == 1
