from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmine.functions.config import Settings
from quillmine.operators import indexing, lexical
from quillmine.sources import commits
from quillmine.sources.commits import Change, CommitLog, Conflict


def rows(spark, *keys, mark="x"):
    return spark.createDataFrame([(k, f"{mark}{k}") for k in keys], "k long, v string")


def log(spark, tmp_path, buckets=8):
    return CommitLog(spark, f"file://{tmp_path}/log", {"a": ["k"], "b": ["k"]}, buckets)


def held(table):
    return {} if table is None else {r.k: r.v for r in table.collect()}


def files(tmp_path):
    return {p for p in Path(tmp_path, "log").rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    own = log(spark, tmp_path)
    first = own.commit({"a": Change(added=rows(spark, *range(200)))})
    before = files(tmp_path)
    second = own.commit({"a": Change(rows(spark, 7), rows(spark, 7, mark="new"))})
    assert sum(first.tables["a"][b] != second.tables["a"][b] for b in first.tables["a"]) == 1
    fresh = {p.parent for p in files(tmp_path) - before}
    assert len(fresh) == 1
    assert held(own.read("a")) == {k: f"x{k}" for k in range(200)} | {7: "new7"}
    assert held(own.read("a", first)) == {k: f"x{k}" for k in range(200)}  # readers of the old version still have it


def test_tables_change_together_and_a_killed_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    own = log(spark, tmp_path)
    own.commit({"a": Change(added=rows(spark, 1, 2)), "b": Change(added=rows(spark, 1))}, {"n": 2})
    with monkeypatch.context() as m:
        m.setattr(commits, "write_text", lambda *_: 1 / 0)  # killed when all tables are written
        with pytest.raises(ZeroDivisionError):
            own.commit({"a": Change(rows(spark, 1), None), "b": Change(added=rows(spark, 2))}, {"n": 3})
    assert held(own.read("a")) == {1: "x1", 2: "x2"} and held(own.read("b")) == {1: "x1"} and own.version().values == {"n": 2}
    assert own.expire() > 0 and held(own.read("a")) == {1: "x1", 2: "x2"}
    Path(tmp_path, "log", "versions", f"{2:012d}.json").write_text("{")  # killed while it wrote the pointer
    assert own.version().number == 1


def test_two_writers(spark, tmp_path):
    own = log(spark, tmp_path)
    base = own.commit({"a": Change(added=rows(spark, 1))})
    own.commit({"a": Change(added=rows(spark, 2))}, base=base)
    with pytest.raises(Conflict):
        own.commit({"a": Change(added=rows(spark, 3))}, base=base)
    seen = []

    def attempt(at):
        if not seen:  # another writer gets in between
            own.commit({"a": Change(added=rows(spark, 4))}, base=at)
        seen.append(at.number)
        return own.commit({"a": Change(added=rows(spark, 3))}, base=at)

    own.retried(attempt)
    assert sorted(held(own.read("a"))) == [1, 2, 3, 4] and seen == [2, 3]


def test_expired_versions_leave_no_files(spark, tmp_path):
    own = log(spark, tmp_path)
    for n in range(4):
        own.commit({"a": Change(rows(spark, 1), rows(spark, 1, mark=f"v{n}-"))})
    own.expire(keep=1)
    assert own.numbers() == [4] and held(own.read("a")) == {1: "v3-1"}
    assert len({p.parent for p in files(tmp_path)}) == 1


def test_emptied_and_widened_tables(spark, tmp_path):
    own = log(spark, tmp_path)
    assert own.read("a") is None
    own.commit({"a": Change(added=rows(spark, 1))})
    own.commit({"a": Change(rows(spark, 1), None)})
    assert held(own.read("a")) == {}
    own.commit({"a": Change(added=rows(spark, 2))})
    own.commit({"a": Change(added=rows(spark, 3).withColumn("w", F.lit(5)))})
    assert sorted((r.k, r.w) for r in own.read("a").collect()) == [(2, None), (3, 5)]


def test_pieces_are_merged_when_there_are_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_PIECES", 3)
    own, merge = log(spark, tmp_path), lambda d: d.groupBy("t").agg(F.sum("n").alias("n")).where("n <> 0")
    for n in range(5):
        own.commit({}, pieces={"s": (spark.createDataFrame([("x", 1), (f"y{n % 2}", 1 if n < 3 else -1)], "t string, n long"), merge)})
    assert len(own.version().pieces["s"]) == 2
    assert {r.t: r.n for r in merge(own.read_pieces("s")).collect()} == {"x": 5, "y0": 1}


def pages(spark, texts):
    return spark.createDataFrame([(t, f"{k}.pdf", f"/{k}.pdf", 1, "m", f"{hash(t)}") for k, t in texts.items()], "text string, document string, source_path string, page int, modified_at string, sha256 string")


def test_index_statistics_equal_a_rebuild(spark, tmp_path):
    index = indexing.ChunkIndex(spark, f"file://{tmp_path}/i", buckets=8)
    states = [{"a": "one two two", "b": "two three 图书馆", "c": "four"}, {"a": "one five", "b": "two three 图书馆", "d": "two"}, {"d": "two"}]
    for state in states:
        index.update_documents(pages(spark, state), prune_deleted=True)
        kept, fresh = index.lexical_index(), lexical.build_index(index.corpus())
        assert (kept.count, kept.mean_length) == (fresh.count, fresh.mean_length)
        assert {r.token: round(r.idf, 9) for r in kept.frequencies.collect()} == {r.token: round(r.idf, 9) for r in fresh.frequencies.collect()}
        asked = lexical.asked_tokens(spark.createDataFrame([(1, "two three")], "qid long, text string"), ["qid"])
        scores = [sorted((r.ordinal, round(r.score, 9)) for r in lexical.bm25(i, asked, 9).collect()) for i in (kept, fresh)]
        assert scores[0] == scores[1]


def test_order_of_insertion_over_commits(spark, tmp_path):
    index = indexing.ChunkIndex(spark, f"file://{tmp_path}/i", Settings(chunk_size=20, chunk_overlap=0), buckets=4)
    index.update_documents(pages(spark, {"b": "first part here\n\nsecond part here", "a": "only part", "c": "last"}))
    order = lambda: [(r.document, r.chunk_index, r.ordinal) for r in index.corpus().orderBy("ordinal").collect()]
    assert order() == [("a.pdf", 1, 0), ("b.pdf", 1, 1), ("b.pdf", 2, 2), ("c.pdf", 1, 3)]
    index.update_documents(pages(spark, {"a": "changed part", "b": "first part here\n\nsecond part here", "c": "last", "0": "new"}))
    assert order() == [("b.pdf", 1, 1), ("b.pdf", 2, 2), ("c.pdf", 1, 3), ("0.pdf", 1, 4), ("a.pdf", 1, 5)]


def test_one_changed_file_rewrites_one_bucket(spark, tmp_path):
    index = indexing.ChunkIndex(spark, f"file://{tmp_path}/i", buckets=8)
    texts = {f"f{n}": f"text number {n}" for n in range(40)}
    index.update_documents(pages(spark, texts))
    before = index.log.version()
    assert index.update_documents(pages(spark, texts | {"f7": "other text"})) == indexing.IndexReport(1, 39, 0, 1)
    after = index.log.version()
    for name in ("chunks", "manifest"):
        assert sum(before.tables[name][b] != after.tables[name][b] for b in before.tables[name]) == 1
