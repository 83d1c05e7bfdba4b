import pytest
from pyspark.sql import functions as F

from quillmine.functions import config, text


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("MA T1001 and CSC 1001", "MAT1001 and CSC1001"),
        ("a\r\nb\rc\x00d", "a\nb\nc d"),
        ("a \t b\n\n\n\nc  \n", "a b\n\nc"),
        (" x　", "x"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_text(spark, given, wanted):
    assert one(spark, given, text.normalize_text) == wanted
    if given is not None:
        assert text.normalized(given) == wanted


@pytest.mark.parametrize("given, wanted", [("ＭＡ T1001", "mat1001"), ("圖書館  Library", "图书馆 library"), ("CSC 3160 x", "csc3160 x"), ("Éa  B", "éa b")])
def test_search_text(spark, given, wanted):
    assert one(spark, given, text.search_text) == wanted == text.search_form(given)


def test_tokens(spark):
    assert one(spark, "ab c 图书馆 d9", text.tokens) == ["ab", "d9", "图", "书", "馆", "图书", "书馆"]
    assert one(spark, "", text.tokens) == []
    assert one(spark, "图", text.tokens) == ["图"]


@pytest.mark.parametrize("given, wanted", [("", "zh"), ("library", "en"), ("图书馆 ab", "zh"), ("图 abc", "en")])
def test_language(spark, given, wanted):
    assert one(spark, given, text.detect_language) == wanted


@pytest.mark.parametrize("given, wanted", [("registry ", ("教务处", "Registry")), ("图书馆", ("图书馆", "Library")), ("x", ("x", None)), ("", None), (None, None)])
def test_department(spark, given, wanted):
    got = one(spark, given, text.bilingual_department)
    assert (tuple(got) if got else None) == wanted


@pytest.mark.parametrize("given, wanted", [("a%20b+c.pdf", "a b+c.pdf"), ("x/y\\z:?.", "x_y_z__"), ("50%", "50%"), (" .a. ", "a")])
def test_safe_filename(spark, given, wanted):
    assert one(spark, given, text.safe_filename) == wanted


@pytest.mark.parametrize("given, wanted", [("有哪些专业", True), ("申请奖学金需要满足哪些条件", False), ("List all undergraduate majors", True), ("What courses are offered", True), ("credits", False)])
def test_aggregate(spark, given, wanted):
    assert one(spark, given, text.is_aggregate_query) is wanted


@pytest.mark.parametrize("given, wanted", [("怎么学 CSC3160", "learning_plan"), ("What is CSC3160", "course_explanation"), ("学分", "official_fact"), ("STUDY PLAN overview", "learning_plan")])
def test_mode(spark, given, wanted):
    assert one(spark, given, text.classify_query) == wanted


def test_contact_fields(spark):
    sample = "Write a.b@c.edu.cn, a.b@c.edu.cn or 0755-8427 3000; 办公时间：周一至周五 9:00\n办公地点：A 楼"
    got = one(spark, sample, text.contact_fields)
    python = text.found_fields(sample)
    assert list(got.emails) == python["emails"] == ["a.b@c.edu.cn"]
    assert list(got.office_hours) == python["office_hours"] and list(got.locations) == python["locations"]
    assert list(got.phones) == python.get("phones", [])


def test_settings():
    assert config.Settings.from_env({"TOP_K": "3", "HYBRID_SEARCH": "no", "LLM_MODEL": "a", "LLM_MODEL_ID": "b", "GROQ_API_KEY": "k"}) == config.Settings(top_k=3, hybrid_search=False, llm_model="b", llm_api_key="k", groq_api_key="k")
    for bad in ({"chunk_overlap": 1000}, {"fetch_k": 1}, {"similarity_threshold": 2}, {"distance_metric": "x"}, {"llm_timeout": 0}, {"rrf_k": 0}):
        with pytest.raises(config.InvalidSettings):
            config.Settings(**bad)


def test_a_form_is_made_once_for_its_tokens(spark):
    df = spark.createDataFrame([("MAT 1001  a\tbb\n中 文x1\x1f y t 2002",), ("",), (None,)], "text string")
    made = df.select(text.tokens(F.col("text"), False).alias("a"), text.tokens_of(text.search_text(F.col("text"), False)).alias("b"))
    assert all(r.a == r.b for r in made.collect()) and made.first().a[0] == "mat1001"
    assert made.select("a")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
