import json
from pathlib import Path

import pytest

from quillmine.operators import schemes

SITE = "https://registry.example.edu"
INDEX = f"""<div id="print-content"><h3>主修课程规定</h3><a href="/page/1">A</a><a href="/page/2">B</a><a href="/page/3">C</a><a href="/page/4">D</a><a href="/page/5">E</a><a href="/page/6">F</a></div>"""


def listing(title, *files):
    blocks = "".join(f'<div class="list-content"><a href="{at}"><div class="list-title">{name}</div></a></div>' for at, name in files)
    return f'<div id="print-content"><h2 class="page-title">{title}</h2>{blocks}</div>'


@pytest.fixture
def tables(spark):
    index = spark.createDataFrame([(f"{SITE}/handbook", INDEX)], "url string, html string")
    pages = [
        (1, listing("Finance", ("/f/old.pdf", "2020至21及以后 Finance.pdf"), ("/f/1.pdf", "2023至24 Finance.pdf"))), (2, listing("", ("/f/2.pdf", "2022-23 Law.pdf"))), (3, listing("Music", ("/f/3.pdf", "2023至24 Music: A.pdf"))),
        (4, listing("Art", ("/f/4.pdf", "2023-24 Art.pdf"))), (6, listing("Far", ("https://other.edu/f.pdf", "2023-24 Far.pdf"))),
    ]
    html = spark.createDataFrame([(f"{SITE}/page/{k}", h) for k, h in pages], "url string, html string")
    contents = spark.createDataFrame([(f"{SITE}/f/1.pdf", b"%PDF-1"), (f"{SITE}/f/3.pdf", b"<html>"), ("https://other.edu/f.pdf", b"%PDF")], "url string, content binary")
    return index, html, contents


def shown(manifest):
    return [(r.major, r.status, r.title, r.error) for r in manifest.collect()]


def test_manifest(spark, tmp_path, tables):
    folder = f"file://{tmp_path}/out"
    manifest, failed = schemes.crawl_schemes(spark, *tables, 2023, folder)
    assert shown(manifest) == [
        ("Finance", "downloaded", "2023至24 Finance.pdf", None), ("B", "not_found", None, None), ("C", "failed", None, schemes.NO_PDF), ("D", "failed", None, schemes.NOT_FETCHED),
        ("E", "failed", None, schemes.NOT_FETCHED), ("F", "failed", None, schemes.FOREIGN),
    ]
    assert failed == 4 and manifest.first().path == f"{folder}/2023至24 Finance.pdf"
    written = [json.loads(x) for p in Path(tmp_path, "out", "manifest").glob("part-*") for x in p.read_text().splitlines()]
    assert len(written) == 6
    again, _ = schemes.crawl_schemes(spark, *tables, 2023, folder)
    assert again.first().status == "skipped"
    assert bytes(spark.read.parquet(f"{folder}/files").first().content) == b"%PDF-1"


def test_dry_run_and_another_year(spark, tmp_path, tables):
    manifest, failed = schemes.crawl_schemes(spark, *tables, 2022, f"file://{tmp_path}/out", dry_run=True)
    assert shown(manifest)[:2] == [("Finance", "selected", "2020至21及以后 Finance.pdf", None), ("B", "selected", "2022-23 Law.pdf", None)] and failed == 1
    assert not Path(tmp_path, "out", "files").exists()


def test_an_index_without_links(spark, tables):
    with pytest.raises(ValueError):
        schemes.scheme_manifest(tables[1], tables[1], tables[2], 2023, "x")
