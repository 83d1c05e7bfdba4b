import json
import logging
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillmine import __main__ as jobs
from quillmine.functions import errors, logs
from quillmine.functions.config import Settings
from quillmine.operators import retrieval
from quillmine.sources import files, models


class Chat(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Chat.asked.append((self.path, self.headers["Authorization"], body))
        text = body["messages"][0]["content"]
        self.send_response(500 if text == "fail" else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": f"re: {text}"}}]} if text != "odd" else {}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def settings():
    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Settings(llm_provider="openai", llm_api_key="k", llm_base_url=f"http://127.0.0.1:{server.server_port}/v1/")
    server.shutdown()


def test_chat(spark, settings):
    rows = spark.createDataFrame([("hi",)], "p string").select(models.chat_model(settings)(F.col("p"))).collect()
    path, key, body = Chat.asked[-1]
    assert rows[0][0] == "re: hi" and path == "/v1/chat/completions" and key == "Bearer k" and body["temperature"] == 0 and body["stream"] is False
    for text, told in (("fail", "HTTP 500"), ("odd", "failed")):
        with pytest.raises(errors.GenerationUnavailable, match=told):
            models.complete(text, settings.llm_base_url, "k", "m", 5)


def test_configuration():
    for bad in (Settings(llm_provider="openai"), Settings(llm_provider="groq"), Settings(llm_provider="x", llm_api_key="k")):
        with pytest.raises(errors.GenerationUnavailable):
            models.chat_model(bad)
    assert [errors.status_of(e) for e in (errors.IndexUnavailable(), ValueError(), KeyError())] == [503, 422, 500]


def test_encoder_and_vector_search(spark):
    encode = models.encoder(lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts])
    rows = spark.createDataFrame([(0, "aaaa", "x.pdf", 1), (1, "bbbb", "y.pdf", 1)], "ordinal long, text string, document string, page int")
    corpus = rows.withColumn("vector", encode(F.col("text")))
    found = retrieval.retrieve(spark.createDataFrame([(1, "aa"), (2, "bb")], "qid long, text string"), corpus, replace(Settings(), similarity_threshold=0.9), models_backend(encode)).collect()
    assert {(r.qid, r.document) for r in found} == {(1, "x.pdf"), (2, "y.pdf")}


def models_backend(encode):
    return retrieval.vector_backend(encode)


def test_reranker(spark):
    rank = models.reranker(lambda pairs: [float(len(t)) for _, t in pairs])
    assert spark.createDataFrame([("q", "abc")], "q string, t string").select(rank(F.col("q"), F.col("t"))).first()[0] == 3.0


def test_logs():
    record = logging.makeLogRecord({"name": "n", "levelname": "INFO", "msg": "说 %s", "args": ("x",), "path": "/p"})
    line = json.loads(logs.JsonLines().format(record))
    assert line["message"] == "说 x" and line["path"] == "/p" and line["level"] == "INFO"


def test_uploads(spark):
    rows = spark.createDataFrame([("a.PDF", b"%PDF-1"), ("a.txt", b"%PDF"), ("b.pdf", b"x"), ("c.pdf", b"%PDF" + bytes(files.MOST_UPLOAD_BYTES)), (None, None)], "name string, content binary")
    assert [r.status for r in files.upload_status(rows).collect()] == [200, 415, 422, 413, 415]


def test_jobs(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "cases.jsonl").write_text('{"question": "library hours", "relevant_document": "g.pdf", "relevant_pages": [2], "should_refuse": false}\n\n{"question": "zz yy xx", "should_refuse": true}\n')
    (tmp_path / "corpus.json").write_text('[{"document": "g.pdf", "page": 2, "text": "library opening hours"}]')
    assert jobs.main(["evaluate", "--dataset", str(tmp_path / "cases.jsonl"), "--corpus", str(tmp_path / "corpus.json")]) == 0
    assert json.loads(capsys.readouterr().out)["recall_at_5"] == 1.0
    spark.createDataFrame([("https://s/1", "<body><p>" + "word " * 20 + "</p></body>"), ("https://s/2", "x")], "url string, html string").write.parquet(f"{tmp_path}/pages")
    assert jobs.main(["ingest-web", "--pages", f"{tmp_path}/pages", "--index", f"file://{tmp_path}/i", "--name", "s"]) == 0
    assert json.loads(capsys.readouterr().out)["indexed"] == 1
    (tmp_path / "study_schemes").mkdir()
    (tmp_path / "study_schemes/a.pdf").write_bytes(b"Course Code CSC1001 Intro 3")
    (tmp_path / "study_schemes/b.pdf").write_bytes(b"\xff")
    read = lambda files_, extractor=None: _pages(files_)
    _pages = lambda f, original=files.extract_pages: original(f, lambda content: iter([(1, content.decode())]))
    monkeypatch.setattr(files, "extract_pages", read)
    assert jobs.main(["ingest", "--source", f"{tmp_path}/study_schemes", "--index", f"file://{tmp_path}/j"]) == 1
    assert json.loads(capsys.readouterr().out)["indexed"] == 1
    assert spark.read.json(f"{tmp_path}/j/course_catalog").first().course_code == "CSC1001"
