from pathlib import Path

import pytest

from quillmine.sources import commits, tables
from quillmine.sources.tables import shared_folder
from quillmine.operators.store import KeyedStore


def items(spark, *rows):
    return spark.createDataFrame(rows, "key string, body string")


def keys(spark, *found):
    return spark.createDataFrame([(k,) for k in found], "key string")


def held(df):
    return {r.key: r.body for r in df.collect()}


def test_put_get_delete(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s")
    assert store.read() is None and store.get(keys(spark, "a")) is None
    store.put(items(spark, ("a", "1"), ("b", "2"), ("c", None)))
    store.put(items(spark, ("a", "3")))
    store.delete(keys(spark, "b", "nope", None))
    assert held(store.read()) == {"a": "3", "c": None} == held(store.get(keys(spark, "a", "b", "c", "a")))
    store.put(items(spark, ("b", "4")))
    assert held(store.get(keys(spark, "b"))) == {"b": "4"}
    with pytest.raises(ValueError):
        store.put(items(spark, (None, "x")))


def test_compaction_leaves_no_deleted_key(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s")
    store.put(items(spark, ("secret-key", "secret-body"), ("kept", "body"), ("other", "old-body")))
    store.put(items(spark, ("other", "new-body")))
    store.delete(keys(spark, "secret-key"))
    store.compact()
    files = b"".join(p.read_bytes() for p in Path(tmp_path, "s").rglob("*") if p.is_file())
    assert b"kept" in files and b"secret-key" not in files and b"secret-body" not in files and b"old-body" not in files
    assert held(store.read()) == {"kept": "body", "other": "new-body"}
    store.put(items(spark, ("secret-key", "again")))
    assert held(store.read())["secret-key"] == "again"


def test_many_puts_are_merged_and_tombstones_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_PIECES", 2)
    store = KeyedStore(spark, f"file://{tmp_path}/s")
    for n in range(5):
        store.put(items(spark, (f"k{n}", str(n)), ("all", str(n))))
        store.delete(keys(spark, f"k{n - 1}"))
    assert held(store.read()) == {"k4": "4", "all": "4"}


def test_delete_before_put_and_new_columns(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s")
    store.put(items(spark, ("a", "1")))
    store.put(spark.createDataFrame([("b", 5)], "key string, size int"))
    assert {r.key: (r.body, r.size) for r in store.read().collect()} == {"a": ("1", None), "b": (None, 5)}


def test_tables_of_an_application_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: f"file://{tmp_path}")
    assert tables.persist(spark.range(5), "five").count() == 5
    assert list(tmp_path.rglob("five-*/*.parquet"))
    tables.remove_tables(spark)
    assert not list(tmp_path.rglob("*.parquet"))


class _Session:
    """A session with a master and settings of its own."""

    def __init__(self, spark, master, folder):
        self.spark, self.master, self.folder = spark, master, folder
        self.sparkContext, self.conf = self, self

    def get(self, key, default=None):
        return self.folder


def test_shared_folder(spark):
    assert shared_folder(_Session(spark, "spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    assert shared_folder(_Session(spark, "local[4]", None)).startswith("/tmp")
    for master in ("spark://x", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(_Session(spark, master, None))
