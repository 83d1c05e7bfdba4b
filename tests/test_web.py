import duckdb
import pytest
from pyspark.sql import functions as F

from quillmine.operators import crawling, html
from quillmine.plans import web_queries
from quillmine.sources import files
from quillmine.sources.tables import Snapshots

PAGE = """<html><head><title> Student  Services </title><style>p{}</style></head><body><nav><p>menu</p></nav><main>
<h1>Office</h1><p>Mail us: help@site.edu.cn</p><h2>Hours</h2><ul><li>办公时间：9:00-17:00</li><li>Closed <p>on Sunday</p></li></ul>
<table><tr><th>Name</th><th>Room</th></tr><tr><td>A</td><td>101</td></tr><tr><td>alone</td></tr></table>
<h3></h3><p>deep</p><h2>Next</h2><p>Last Updated: 2024-05-06</p></main><footer>f</footer></body></html>"""


def test_sections():
    url, title, department, sections, fields, updated, digest = html.page_of(PAGE, "u", "site", "")
    assert (title, department, updated) == ("Student Services", "site", "2024-05-06")
    assert sections == [
        ("Office", "Mail us: help@site.edu.cn"),
        ("Office > Hours", "- 办公时间：9:00-17:00\n- Closed on Sunday\nName | Room\nName：A；Room：101\nalone"),
        ("Office > Hours", "deep"),
        ("Office > Next", "Last Updated: 2024-05-06"),
    ]
    assert fields["emails"] == ["help@site.edu.cn"] and digest == html.page_of(PAGE, "other", "site", "")[-1]


def test_unclosed_paragraphs_nest():
    assert html.page_of("<body><p>a<p>b</body>", "u", "s", "")[3] == [("s", "a b\nb")]
    assert html.page_of("<body>only text</body>", "u", "s", "")[3] == [("s", "only text")]
    assert html.page_of("", "u", "s", "")[3] == []


@pytest.mark.parametrize("query", [web_queries.html_sections, web_queries.html_chunks])
def test_cut_references(spark, tmp_path, query):
    """Titles that end within a reference, against the query's SQL."""
    body = "<body><article><h1>{0}</h1><p>Terms &amp; conditions apply to every order &quot;here&quot;.</p></article></body></html>"
    heads = ["a &amp; b", "cut &amp", "cut &quot", "cut &am", "cut &", "a&&amp", "R&D &amp;amp; x"]
    rows = [(i, f"u{i}", f"<html><head><title>{h}</title></head>{body.format(h)}") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(web_queries.SQL[query.__name__]).fetchall()
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(wanted)


def test_references_of_other_pages():
    cut = "<title>a &amp</title><body><p>R&D &lt; b</p></body>"
    assert html.page_of(cut, "u", "s", "")[1] == "a &" and html.page_of(cut, "u", "s", "", True)[1] == "a &amp"
    assert html.page_of(cut, "u", "s", "")[3] == [("a &", "R&D < b")]


def test_chunks(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string")
    kept, short = html.long_enough(html.extract_pages(pages, "site"))
    assert [r.url for r in short.collect()] == ["v"]
    rows = html.split_web_pages(kept, 200, 20).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(1, len(rows) + 1)) and all(len(r.text) <= 200 for r in rows)
    assert "已识别信息" in rows[0].text and rows[0].page == 1 and rows[0].source_type == "web" and rows[-1].section == "Office > Next"


@pytest.mark.parametrize(
    "url, wanted",
    [
        ("https://www.Site.edu/a/x", True), ("https://site.edu/b", False), ("https://evilsite.edu/a", False), ("ftp://site.edu/a", False),
        ("https://site.edu/a/f.PDF", False), ("http://user@site.edu:80/a?q#f", True), ("nonsense", False), (None, False),
    ],
)
def test_allowed(spark, url, wanted):
    source = crawling.WebSource("s", ("https://site.edu/a",), ("site.edu",), ("/a",))
    assert spark.createDataFrame([(url,)], "u string").select(crawling.is_allowed(F.col("u"), source)).first()[0] is wanted


def test_links(spark):
    pages = spark.createDataFrame([("https://s.edu/a/b", '<a href="c#x">1</a><a>no</a><a href="/d">2</a>')], "url string, html string")
    assert [(r.pos, r.dst) for r in html.page_links(pages).orderBy("pos").collect()] == [(0, "https://s.edu/a/c"), (1, "https://s.edu/d")]


def test_crawl(spark):
    at = "https://s.edu/"
    pages = spark.createDataFrame([(at + p, a, n) for p, a, n in (("", True, 100), ("a", True, 100), ("b", False, 100), ("c", True, 10), ("d", True, 100), ("e", True, 100), ("f", True, None))], "url string, allowed boolean, body_chars int")
    links = spark.createDataFrame([(at, 0, at + "a"), (at, 1, at + "b"), (at, 2, at + "c"), (at + "a", 0, at), (at + "a", 1, at + "f"), (at + "c", 0, at + "d"), (at + "a", 2, "https://other.edu/")], "src string, pos int, dst string")
    source = crawling.WebSource("s", (at + "#top",), ("s.edu",))
    got = [(r.url[len(at):], r.depth, r.outcome) for r in crawling.crawl(source, pages, links).orderBy("place").collect()]
    assert got == [("", 0, "kept"), ("a", 1, "kept"), ("b", 1, "denied"), ("c", 1, "short"), ("f", 2, "not_html")]
    small = crawling.WebSource("s", (at,), ("s.edu",), max_pages=2)
    assert crawling.crawl(small, pages, links).count() == 2


def test_robots(spark):
    rows = spark.createDataFrame([("https://s/a/x", 200, "User-agent: *\nDisallow: /a"), ("https://s/b", 200, "User-agent: *\nDisallow: /a"), ("https://s/a", 404, None), ("https://s/a", 503, None), ("https://s/a", None, None)], "u string, s int, r string")
    assert [r[0] for r in rows.select(crawling.robots_allow(F.col("u"), F.col("s"), F.col("r"))).collect()] == [False, True, True, False, False]


LISTING = """<div id="print-content"><h2 class="page-title">Fin<b>ance</b></h2><h3>主修课程规定</h3><a href="/page/12">A</a><a href="https://registry.example.edu/page/12">B</a><a href="/x">no</a>
<h3>副修课程规定</h3><a href="/page/13">C</a><div class="list-content"><a href="/f/1.pdf"><div class="list-title">2023至24 Finance.pdf</div></a><div>small</div></div>
<div class="list-content"><a href="/f/2"><span>not a file</span></a></div></div><a href="/page/99">out</a>"""


def test_listing(spark):
    base = "https://registry.example.edu/page/22"
    assert html.major_links(LISTING, base) == [("A", "https://registry.example.edu/page/12")]
    assert html.listed_documents(LISTING, base) == ("Finance", [("https://registry.example.edu/f/1.pdf", "2023至24 Finance.pdf")])
    row = html.listings(spark.createDataFrame([(base, LISTING)], "url string, html string")).first()
    assert row.title == "Finance" and len(row.documents) == 1


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.PDF").write_bytes(b"%PDF one")
    (tmp_path / "in/sub/b.pdf").write_bytes(b"%PDF bad")
    (tmp_path / "in/c.txt").write_bytes(b"x")

    def extractor(content):
        if content.endswith(b"bad"):
            raise ValueError("broken")
        yield from ((1, "CSC 1001"), (2, "CSC 1001"), (3, " "), (4, "more"))

    scanned = files.scan_documents(spark, str(tmp_path / "in"))
    assert scanned.count() == 2
    pages, warnings = files.parse_pages(files.extract_pages(scanned, extractor))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "CSC1001"), (4, "more")]
    assert warnings.count() == 3 and warnings.where("warning like '%broken%'").count() == 1


def test_configuration(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"sources": [{"name": "n", "start_urls": [" https://s/ "], "allowed_domains": ["S.edu "], "max_pages": 0, "max_depth": -1}]}')
    (source,) = files.read_web_sources(spark, str(good))
    assert source == crawling.WebSource("n", ("https://s/",), ("s.edu",), ("/",), "", 1, 0, 0.5)
    bad = tmp_path / "bad.json"
    bad.write_text('{"sources": [{"name": "n", "start_urls": []}]}')
    with pytest.raises(ValueError):
        files.read_web_sources(spark, str(bad))
    assert files.read_or_empty(spark, str(tmp_path / "none.json"), files.CATALOGUE_SCHEMA).count() == 0


def test_snapshots(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    assert [table.write(spark.range(3)), table.write(spark.range(5))] == [1, 2] and table.read().count() == 5
