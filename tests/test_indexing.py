import pytest

from quillmine.functions.config import Settings
from quillmine.operators import html, indexing
from quillmine.streaming import ingest


def pages(spark, rows):
    return spark.createDataFrame([(t, f"{k}.pdf", f"/{k}.pdf", 1, "m", h) for k, t, h in rows], "text string, document string, source_path string, page int, modified_at string, sha256 string")


def test_documents(spark, tmp_path):
    index = indexing.ChunkIndex(spark, f"file://{tmp_path}/i")
    with pytest.raises(indexing.NotReady):
        index.corpus()
    first = pages(spark, [("a", "one", "1"), ("b", "two", "1"), ("c", " ", "1")])
    assert index.update_documents(first) == indexing.IndexReport(2, 0, 1, 2)
    assert index.update_documents(first) == indexing.IndexReport(0, 2, 1, 0)
    second = pages(spark, [("a", "changed", "2"), ("b", "two", "1")])
    assert index.update_documents(second) == indexing.IndexReport(1, 1, 0, 1)
    assert sorted(r.text for r in index.corpus().collect()) == ["changed", "two"]
    other = indexing.ChunkIndex(spark, f"file://{tmp_path}/i", Settings(chunk_size=500))
    assert other.update_documents(second).indexed == 2
    assert other.update_documents(second.limit(0), prune_deleted=True).indexed == 0
    with pytest.raises(indexing.NotReady):
        other.corpus()


def test_pages_and_stream(spark, tmp_path):
    body = "<body><h1>T</h1><p>" + "word " * 30 + "</p></body>"
    rows = spark.createDataFrame([(1, "https://s/1", body), (2, "https://s/2", body + "x"), (3, "https://s/3", "short")], ingest.PAGES_SCHEMA)
    index = indexing.ChunkIndex(spark, f"file://{tmp_path}/i")
    kept, _ = html.long_enough(html.extract_pages(rows))
    assert index.update_pages(kept).indexed == 2 and index.update_pages(kept) == indexing.IndexReport(0, 2, 0, 0)
    with pytest.raises(indexing.NotReady):  # web pages alone don't make it ready
        index.corpus()
    source = f"{tmp_path}/pages"
    rows.write.parquet(source)
    fresh = indexing.ChunkIndex(spark, f"file://{tmp_path}/j")
    assert ingest.ingest(ingest.read_pages(spark, source), fresh, f"{tmp_path}/cp") == 1
    assert ingest.ingest(ingest.read_pages(spark, source), fresh, f"{tmp_path}/cp") == 0
    assert fresh.chunks.read().select("key").distinct().count() == 2
