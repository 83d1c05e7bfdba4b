"""Exact nearest neighbours, and distances as relevance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.operators.lexical import top
from quillmine.sources.tables import persist

#: Queries travel to every task, so a batch must be small; more are searched batch by batch, one pass over the rows each.
MOST_QUERY_BYTES = 64 << 20
#: Distances that a task has at once, and the queries among them; a task's memory follows these, not the number of queries.
TILE, QUERY_ROWS = 1 << 20, 512


def relevance(distance: Column, metric: str) -> Column:
    """A distance as relevance from 0 to 1."""
    d = F.greatest(F.lit(0.0), distance)
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric {metric}")
    score = 1 / (1 + d) if metric == "l2" else 1 - d
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances (queries, rows): one less cosine, squared Euclidean, or one less inner product."""
    dots = queries @ rows.T
    if metric == "ip":
        return 1 - dots
    lengths = np.einsum("ij,ij->i", rows, rows)
    own = np.einsum("ij,ij->i", queries, queries)
    if metric == "l2":
        return np.maximum(0, own[:, None] + lengths[None, :] - 2 * dots)
    scale = np.sqrt(own)[:, None] * np.sqrt(lengths)[None, :]
    return 1 - np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)


def best_rows(queries: np.ndarray, rows: np.ndarray, ordinal: np.ndarray, k: int, metric: str, held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ordinals (queries, up to k) of the nearest rows of each query, ties by ordinal, computed tile by tile. held: the best of earlier rows."""
    best_d, best_o = held or (np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64))
    step = max(1, TILE // min(QUERY_ROWS, len(queries)))
    for low in range(0, len(rows), step):
        data, own = rows[low : low + step], ordinal[low : low + step]
        size = min(k, best_d.shape[1] + len(data))
        new_d, new_o = np.empty((len(queries), size)), np.empty((len(queries), size), np.int64)
        for at in range(0, len(queries), QUERY_ROWS):
            old_d, old_o = best_d[at : at + QUERY_ROWS], best_o[at : at + QUERY_ROWS]
            d = np.round(distances(queries[at : at + QUERY_ROWS], data, metric), 12)
            keep = np.ones(d.shape, bool)
            if d.shape[1] > k:
                keep &= ~(d > np.partition(d, k - 1, axis=1)[:, k - 1 : k])
            if old_d.shape[1] == k:
                keep &= ~(d > old_d[:, -1:])
            q, place = np.nonzero(keep)
            q = np.concatenate([np.repeat(np.arange(len(d)), old_d.shape[1]), q])
            d = np.concatenate([old_d.reshape(-1), d[keep]])
            o = np.concatenate([old_o.reshape(-1), own[place]])
            order = np.lexsort((o, d, q))
            q = q[order]
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < size]
            new_d[at : at + QUERY_ROWS], new_o[at : at + QUERY_ROWS] = d[order].reshape(-1, size), o[order].reshape(-1, size)
        best_d, best_o = new_d, new_o
    return best_d, best_o


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", by: str = "qid") -> DataFrame:
    """qid, ordinal, distance and rank of the k nearest rows of each query, ties by ordinal. Both have a column `vector`.

    Each task keeps its own k for a query, so no more than k a task and query are shuffled. Queries without a vector have no rows.
    """
    relevance(F.lit(0.0), metric)
    asked = queries.where("vector is not null").select(by, "vector")
    total = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    kind = queries.schema[by].dataType.simpleString()
    if not total[0]:
        return queries.sparkSession.createDataFrame([], f"{by} {kind}, ordinal long, distance double, rank int")
    # Half of the bound on the mean, as hashes don't fill batches evenly.
    parts = max(1, -(-total[0] * total[1] * 8 * 2 // MOST_QUERY_BYTES)) if total[0] * total[1] * 8 > MOST_QUERY_BYTES else 1
    found = [_found(corpus, asked.where(F.pmod(F.xxhash64(by), F.lit(parts)) == part), k, metric, by, kind, True) for part in range(parts)] if parts > 1 else [_found(corpus, asked, k, metric, by, kind)]
    merged = reduce(DataFrame.unionByName, found)
    return top(merged.withColumn("score", -F.col("distance")), [by], k).drop("score")


def _found(corpus: DataFrame, asked: DataFrame, k: int, metric: str, by: str, kind: str, written: bool = False) -> DataFrame:
    """Every task's own k nearest rows of each query of one batch. written: as a table, so that the batch's queries needn't be kept."""
    rows = asked.collect()
    if not rows:
        return asked.sparkSession.createDataFrame([], f"{by} {kind}, ordinal long, distance double")
    ids, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        ids, matrix = shared.value
        best_d, best_o = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            vectors = batch.column("vector")
            ordinal = batch.column("ordinal").to_numpy(zero_copy_only=False).astype(np.int64)
            keep = vectors.is_valid().to_numpy(zero_copy_only=False)
            if not keep.any():
                continue
            data = np.array(vectors.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(int(keep.sum()), -1)
            best_d, best_o = best_rows(matrix, data, ordinal[keep], k, metric, (best_d, best_o))
        if best_d.shape[1]:
            n = best_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([i for i in ids for _ in range(n)]), pa.array(best_o.reshape(-1)), pa.array(best_d.reshape(-1))], [by, "ordinal", "distance"])

    found = corpus.select("ordinal", "vector").mapInArrow(run, f"{by} {kind}, ordinal long, distance double")
    if written:
        found = persist(found, "nearest")
        shared.destroy()
    return found
