import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.operators import vector_index, vectors
from quillmine.operators.vector_index import VectorIndex, recall
from quillmine.plans.index_queries import vector_index_recall


def clustered(n, size, seed=1, clusters=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, size)) * 3
    return centres[r.integers(0, clusters, n)] + r.normal(size=(n, size))


def frame(spark, data, name="ordinal", kind="double"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{name} long, vector array<{kind}>")


def pairs(df):
    return sorted((r.qid, r["rank"], r.ordinal, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_recall_and_exact_switch(spark, tmp_path, metric):
    data = clustered(1200, 8)
    rows, asked = frame(spark, data), frame(spark, data[::40] + 0.1, "qid")
    index = VectorIndex.build(rows, f"file://{tmp_path}/i", metric, cells=25)
    true = vectors.nearest(rows, asked, 10, metric)
    assert index.rows().count() == 1200 and recall(index.search(asked, 10), true).first().recall >= 0.9
    assert index.probes < 25
    assert pairs(index.search(asked, 10, exact=True)) == pairs(true)
    again = VectorIndex(spark, f"file://{tmp_path}/i")  # opened, not built
    assert pairs(again.search(asked, 10)) == pairs(index.search(asked, 10))


def test_a_search_reads_few_files(spark, tmp_path):
    data = clustered(900, 6)
    index = VectorIndex.build(frame(spark, data, kind="float"), f"file://{tmp_path}/i", cells=20)
    files = lambda df: {r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect()}
    cells = index._probed(data[:1], 10, index.probes, np.full(20, 45))[0]
    assert 0 < len(files(index.rows(sorted(cells)))) < len(files(index.rows())) / 2
    assert "PartitionFilters: [cell" in index.rows(sorted(cells))._jdf.queryExecution().executedPlan().toString()


def test_equal_vectors_are_several_files_and_ties_go_by_ordinal(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 20)
    data = np.concatenate([np.tile([1.0, 2.0, 3.0], (300, 1)), clustered(100, 3)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together again
    try:
        index = VectorIndex.build(frame(spark, data), f"file://{tmp_path}/i", cells=6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = index.rows().groupBy("cell").count().orderBy(F.desc("count")).first().cell
    assert len({r[0] for r in index.rows([hot]).select(F.col("_metadata.file_path")).distinct().collect()}) > 1
    asked = frame(spark, [[1.0, 2.0, 3.0]], "qid")
    assert [r.ordinal for r in index.search(asked, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_small_cells_are_joined_until_there_are_k_rows(spark, tmp_path):
    data = clustered(60, 4)
    index = VectorIndex.build(frame(spark, data), f"file://{tmp_path}/i", cells=30)
    assert index.search(frame(spark, data[:3], "qid"), 20, probes=1).groupBy("qid").count().collect()[0]["count"] == 20
    assert index.search(frame(spark, data[:1], "qid"), 100, probes=1).count() == 60  # fewer rows than asked for


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "ordinal long, vector array<double>")
    index = VectorIndex.build(rows, f"file://{tmp_path}/i")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "qid string, vector array<double>")
    assert [(r.qid, r.ordinal) for r in index.search(asked, 3, exact=True).orderBy("rank").collect()] == [("a", 1), ("a", 4), ("a", 3)]
    assert index.search(asked.where("qid = 'b'"), 3).count() == 0
    index.add(spark.createDataFrame([(9, [0.9, 0.1])], "ordinal long, vector array<double>"))
    assert {r.ordinal for r in index.search(asked, 3, exact=True).collect()} == {1, 4, 9}
    with pytest.raises(ValueError):
        VectorIndex.build(rows.where("vector is null"), f"file://{tmp_path}/none")


def test_queries_in_batches(spark, tmp_path, monkeypatch):
    data = clustered(200, 4)
    index = VectorIndex.build(frame(spark, data), f"file://{tmp_path}/i", cells=8)
    asked = frame(spark, data[:40], "qid")
    want = pairs(index.search(asked, 3))
    monkeypatch.setattr(vectors, "MOST_QUERY_BYTES", 600)
    assert pairs(index.search(asked, 3)) == want


def test_query(spark):
    assert vector_index_recall(spark, "/root/testdata/sf0.01").first().recall >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_a_task_holds_one_tile_of_distances(monkeypatch, metric):
    """However many queries and rows meet; equal distances, also across tiles, are in the order of ordinals."""
    r, seen, whole = np.random.default_rng(3), [], vectors.distances
    rows, asked = r.integers(-2, 3, (700, 3)).astype(float), r.integers(-2, 3, (90, 3)).astype(float)
    rows[5], ordinal = np.nan, r.permutation(700)
    monkeypatch.setattr(vectors, "TILE", 400)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 20)
    monkeypatch.setattr(vectors, "distances", lambda *a: seen.append(whole(*a)) or seen[-1])
    for k in (1, 7, 900):
        held = None
        for at in range(0, 700, 250):  # batches
            held = vectors.best_rows(asked, rows[at : at + 250], ordinal[at : at + 250], k, metric, held)
        d = np.round(whole(asked, rows, metric), 12)
        o = np.broadcast_to(ordinal, d.shape)
        order = np.lexsort((o, d), axis=1)[:, :k]
        assert np.array_equal(held[1], np.take_along_axis(o, order, 1)) and np.array_equal(held[0], np.take_along_axis(d, order, 1), equal_nan=True)
    assert max(d.size for d in seen) <= 400
