import pytest
from pyspark.sql import functions as F

from quillmine import __main__ as job
from quillmine.operators import crawling
from quillmine.operators.crawling import CrawlLog, WebSource, crawl

AT = "https://s.edu/"
PAGES = [("", True, 100), ("a", True, 100), ("b", False, 100), ("c", True, 10), ("d", True, 100), ("e", True, 100), ("f", True, None), ("g", True, 40), ("h", True, 100)]
LINKS = [("", 0, "a"), ("", 1, "b"), ("", 2, "c#top"), ("", 3, "x.pdf"), ("a", 0, ""), ("a", 1, "f"), ("a", 2, "g"), ("b", 0, "e"), ("c", 0, "d"), ("g", 0, "h"), ("a", 3, "missing"), ("a", 4, "g"), ("h", 0, "deep")]


@pytest.fixture
def site(spark):
    pages = spark.createDataFrame([(AT + p, a, n) for p, a, n in PAGES], "url string, allowed boolean, body_chars int")
    links = spark.createDataFrame([(AT + a, k, AT + b) for a, k, b in LINKS] + [(AT, 4, "https://other.edu/")], "src string, pos int, dst string")
    return spark.createDataFrame([(AT + "#top", 0)], "url string, pos int"), pages, links


def rows(df):
    return sorted((r.place, r.url, r.depth, r.outcome) for r in df.collect())


@pytest.mark.parametrize("depth, most", [(2, None), (3, None), (0, None), (3, 5), (2, 1)])
def test_equals_the_bounded_crawl(spark, tmp_path, site, depth, most):
    source = WebSource("s", (AT + "#top",), ("s.edu",), max_pages=most or 50, max_depth=depth)
    start, pages, links = site
    assert rows(CrawlLog(spark, f"file://{tmp_path}/c", source, 4).run(start, pages, links, most)) == rows(crawl(source, pages, links))


def test_a_crawl_that_is_cut_short_goes_on(spark, tmp_path, site, monkeypatch):
    source = WebSource("s", (), ("s.edu",), max_depth=3)
    start, pages, links = site
    want = rows(CrawlLog(spark, f"file://{tmp_path}/whole", source, 4).run(start, pages, links))
    log = CrawlLog(spark, f"file://{tmp_path}/c", source, 4)
    assert log.step(start, pages, links)
    with monkeypatch.context() as m:
        m.setattr(crawling.CommitLog, "_point", lambda *_: 1 / 0)  # killed when the second level is written
        with pytest.raises(ZeroDivisionError):
            log.step(start, pages, links)
    assert len(rows(log.visited())) == 1
    again = CrawlLog(spark, f"file://{tmp_path}/c", source, 4)
    assert rows(again.run(start, pages, links)) == want
    assert rows(again.run(start, pages, links)) == want  # it is done


def test_content_types(spark):
    df = spark.createDataFrame([("text/html; charset=utf-8", 50), ("Text/HTML", 50), ("application/pdf", 50), (None, 50)], "kind string, n int")
    assert [r[0] for r in df.select(crawling.html_chars(F.col("kind"), F.col("n"))).collect()] == [50, 50, None, None]


def test_nothing_to_visit(spark, tmp_path, site):
    start, pages, links = site
    log = CrawlLog(spark, f"file://{tmp_path}/c", WebSource("s", (), ("elsewhere.edu",)), 4)
    assert log.run(start, pages, links).count() == 0


def test_the_job_crawls_every_source_of_a_file(spark, tmp_path, capsys):
    body = "<html><body><article><h1>T</h1><p>" + "word " * 30 + "</p>{}</article></body></html>"
    pages = [(AT, body.format('<a href="/a">a</a>'), True, "text/html"), (AT + "a", body.format('<a href="b">b</a>'), True, "text/html; charset=utf-8"), (AT + "b", "%PDF", True, "application/pdf")]
    spark.createDataFrame(pages, "url string, html string, allowed boolean, content_type string").write.parquet(f"{tmp_path}/pages")
    (tmp_path / "sources.json").write_text('{"sources": [{"name": "s", "start_urls": ["%s"], "allowed_domains": ["s.edu"]}]}' % AT)
    for _ in range(2):  # the second finds it done
        assert job.crawl(spark, f"{tmp_path}/sources.json", f"{tmp_path}/pages", f"file://{tmp_path}/log") == 0
        assert '"kept": 2' in (said := capsys.readouterr().out) and '"not_html": 1' in said
