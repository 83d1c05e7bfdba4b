"""Inverted-file index of vectors: each row is in the cell of its nearest centre, files lie in folders by cell, and a search reads the cells
around its query and computes exact distances there.

Centres are fitted by k-means on a sample of `SAMPLE_ROWS` rows, or `SAMPLE_PER_CELL` a cell if that is more; every row is indexed. How many cells a search reads
is measured when the index is built: as many as bring `TARGET` of the true neighbours of sampled rows. Cells that many rows share are several files, written by several tasks.

For the inner product vectors get one more coordinate that makes all equally long, so that near in angle is near in product.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.operators import vectors
from quillmine.operators.lexical import top
from quillmine.sources.tables import persist, read_text, write_text

SAMPLE_ROWS = 20_000
SAMPLE_PER_CELL = 40
#: Bound of the centres, which travel to every task.
MOST_CELLS, MOST_CENTRE_BYTES = 4096, 32 << 20
FILE_ROWS = 200_000
#: Recall that the number of probed cells must reach, on so many sampled rows and neighbours of each.
TARGET, TUNING_ROWS, TUNING_K = 0.97, 256, 10


def _matrix(column: pa.Array, keep: np.ndarray) -> np.ndarray:
    flat = column.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False)
    return np.array(flat, dtype=np.float64).reshape(int(keep.sum()), -1)


def points(data: np.ndarray, metric: str, longest: float = 0.0, asked: bool = False) -> np.ndarray:
    """Vectors as points whose Euclidean order around a query is the metric's. longest: the largest length of a row, for inner products."""
    if metric == "cosine":
        size = np.sqrt(np.einsum("ij,ij->i", data, data))
        return np.divide(data, size[:, None], out=np.zeros_like(data), where=size[:, None] > 0)
    if metric == "ip":
        rest = np.zeros(len(data)) if asked else np.sqrt(np.maximum(0, longest**2 - np.einsum("ij,ij->i", data, data)))
        return np.concatenate([data, rest[:, None]], axis=1)
    return data


def cell_order(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """All cells of each point, nearest first, ties by number."""
    return np.argsort(np.round(vectors.distances(data, centres, "l2"), 12), axis=1, kind="stable")


def fit_centres(rows: DataFrame, cells: int, metric: str, longest: float, seed: int) -> np.ndarray:
    """Centres of k-means on a sample of the rows: those with the smallest hashes of their ordinals."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data = points(_matrix(batch.column("vector"), np.ones(batch.num_rows, bool)), metric, longest)
                yield pa.RecordBatch.from_arrays([pa.array(list(data), pa.list_(pa.float64()))], ["point"])

    total = rows.count()
    wanted = max(SAMPLE_ROWS, SAMPLE_PER_CELL * cells)
    share = min(1.0, wanted / max(1, total))
    sample = rows if share == 1 else rows.where(F.pmod(F.xxhash64("ordinal", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    held = persist(sample.select("vector").mapInArrow(run, "point array<double>"), "centres-sample").select(array_to_vector("point").alias("features"))
    model = KMeans(k=cells, maxIter=12, seed=seed).fit(held)
    return np.array(sorted(map(tuple, model.clusterCenters())))


class VectorIndex:
    """An index under a path: rows (ordinal, vector) by cell, the centres, and what the build measured."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = json.loads(read_text(spark, f"{self.path}/index.json"))
        found = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
        self.cells = [r.cell for r in found]
        self.centres = np.array([r.centre for r in found], dtype=np.float64)
        self.metric, self.longest, self.probes = (self.settings[k] for k in ("metric", "longest", "probes"))

    @classmethod
    def build(cls, rows: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Index rows (ordinal, vector); those without a vector are left out. Raises if there are none."""
        spark = rows.sparkSession
        vectors.relevance(F.lit(0.0), metric)
        rows = rows.where("vector is not null").select("ordinal", "vector")
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        total, size, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(length)).first()
        if not total:
            raise ValueError("no row has a vector")
        bound = max(1, min(MOST_CELLS, MOST_CENTRE_BYTES // (8 * (size + 1))))
        centres = fit_centres(rows, min(cells or int(np.ceil(np.sqrt(total))), bound), metric, longest, seed)
        index = cls.__new__(cls)
        index.spark, index.path, index.metric, index.longest = spark, path.rstrip("/"), metric, longest
        index.cells, index.centres = list(range(len(centres))), centres
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{index.path}/centres")
        index.add(rows)
        index.probes = index._tuned(rows, seed)
        index.settings = {"metric": metric, "longest": longest, "probes": index.probes}
        write_text(spark, f"{index.path}/index.json", json.dumps(index.settings))
        return index

    def add(self, rows: DataFrame) -> None:
        """Put more rows into their cells; centres stay. A row whose inner product length is beyond the build's counts as that long."""
        rows = rows.where("vector is not null").select("ordinal", "vector")
        centres, metric, longest = self.centres, self.metric, self.longest
        shared = self.spark.sparkContext.broadcast(centres)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    data = points(_matrix(batch.column("vector"), np.ones(batch.num_rows, bool)), metric, longest)
                    step = max(1, vectors.TILE // len(shared.value))
                    cell = np.concatenate([np.argmin(np.round(vectors.distances(data[at : at + step], shared.value, "l2"), 12), axis=1) for at in range(0, len(data), step)])
                    yield pa.RecordBatch.from_arrays([batch.column("ordinal"), batch.column("vector"), pa.array(cell.astype(np.int32))], ["ordinal", "vector", "cell"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        placed = persist(rows.mapInArrow(run, f"ordinal {kinds['ordinal']}, vector {kinds['vector']}, cell int"), "cells")
        sizes = persist(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")  # at most a row a cell
        part = F.pmod(F.xxhash64("ordinal"), 1 + F.floor(F.col("n") / FILE_ROWS))
        laid = placed.join(F.broadcast(sizes), "cell").withColumn("part", part)
        laid.repartition("cell", "part").drop("n", "part").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def _tuned(self, rows: DataFrame, seed: int) -> int:
        """The fewest cells that hold TARGET of the true neighbours of sampled rows."""
        order = F.xxhash64("ordinal", F.lit(seed + 1))
        asked = persist(rows.orderBy(order).limit(TUNING_ROWS).withColumnRenamed("ordinal", "qid"), "tuning")
        true = vectors.nearest(rows, asked, TUNING_K, self.metric)
        found = true.join(self.rows().select("ordinal", "cell"), "ordinal").select("qid", "cell").collect()  # TUNING_ROWS * TUNING_K
        held = asked.collect()
        order_of = cell_order(points(np.array([r.vector for r in held], dtype=np.float64), self.metric, self.longest, True), self.centres)
        rank = {(r.qid, int(c)): i for r, cells in zip(held, order_of) for i, c in enumerate(cells)}
        places = np.sort([rank[r.qid, r.cell] for r in found])
        return int(places[int(np.ceil(TARGET * len(places))) - 1]) + 1 if len(places) else 1

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """All rows, or those of some cells; other cells' files aren't read."""
        found = self.spark.read.parquet(f"{self.path}/rows")
        return found if cells is None else found.where(F.col("cell").isin([int(c) for c in cells]))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, by: str = "qid") -> DataFrame:
        """by, ordinal, distance and rank of about the k nearest rows of each query (vector), ties by ordinal; all of them with exact.

        Queries are taken in batches of `vectors.MOST_QUERY_BYTES`; each batch's best rows are written before the next goes out.
        """
        asked = queries.where("vector is not null").select(by, "vector")
        kind = queries.schema[by].dataType.simpleString()
        schema = f"{by} {kind}, ordinal long, distance double"
        count, size = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        if not count:
            return self.spark.createDataFrame([], schema + ", rank int")
        parts = max(1, -(-count * size * 16 // vectors.MOST_QUERY_BYTES))
        asked = persist(asked.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts))), "queries") if parts > 1 else asked.withColumn("__part", F.lit(0))
        filled = {r.cell: r.n for r in self.rows().groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row a cell
        sizes = np.array([filled.get(c, 0) for c in self.cells], np.int64)
        out = None
        for part in range(parts):
            held = asked.where(F.col("__part") == part).select(by, "vector").collect()
            if not held:
                continue
            matrix = np.array([r[1] for r in held], dtype=np.float64)
            chosen = self._probed(matrix, k, len(self.cells) if exact else probes or self.probes, sizes)
            cells = sorted({c for own in chosen for c in own})
            shared = self.spark.sparkContext.broadcast(([r[0] for r in held], matrix, {c: np.array([i for i, own in enumerate(chosen) if c in own]) for c in cells}))
            found = self.rows(cells).select(F.col("ordinal").cast("long").alias("ordinal"), "vector", "cell").mapInArrow(_best_in_cells(shared, k, self.metric, by), schema)
            found = persist(found, "cell-hits") if parts > 1 else found
            if parts > 1:
                shared.destroy()
            out = found if out is None else out.unionByName(found)
        return top(out.withColumn("score", -F.col("distance")), [by], k).drop("score")

    def _probed(self, matrix: np.ndarray, k: int, probes: int, sizes: np.ndarray) -> list[set[int]]:
        """Cells of each query: the nearest `probes`, and more until they have k rows."""
        out = []
        for at in range(0, len(matrix), 1024):
            order = cell_order(points(matrix[at : at + 1024], self.metric, self.longest, True), self.centres)
            enough = np.argmax(np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum()), axis=1) + 1
            out += [set(o[: max(probes, n)].tolist()) for o, n in zip(order, enough)]
        return out


def _best_in_cells(shared, k: int, metric: str, by: str):
    """Each task's k nearest rows of each query that probes the cells it reads."""

    def run(batches):
        ids, matrix, asking = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            for c in np.unique(cell):
                keep = cell == c
                data = _matrix(batch.column("vector"), keep)
                ordinal = batch.column("ordinal").to_numpy(zero_copy_only=False)[keep]
                asked = asking.get(int(c), np.zeros(0, np.int64))
                for at in range(0, len(asked), vectors.QUERY_ROWS):
                    own = asked[at : at + vectors.QUERY_ROWS]
                    for q, d, o in zip(own.tolist(), *vectors.best_rows(matrix[own], data, ordinal, k, metric)):
                        if q in best:
                            d, o = np.concatenate([best[q][0], d]), np.concatenate([best[q][1], o])
                            order = np.lexsort((o, d))[:k]
                            d, o = d[order], o[order]
                        best[q] = d, o
        if best:
            n = [len(d) for d, _ in best.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[q] for q, m in zip(best, n) for _ in range(m)]), pa.array(np.concatenate([o for _, o in best.values()])), pa.array(np.concatenate([d for d, _ in best.values()]))], [by, "ordinal", "distance"]
            )

    return run


def recall(found: DataFrame, true: DataFrame, by: str = "qid") -> DataFrame:
    """One row: the share of the true neighbours (by, ordinal) that were found."""
    hit = true.select(by, "ordinal").join(found.select(by, "ordinal").withColumn("hit", F.lit(1)), [by, "ordinal"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"), F.count(F.lit(1)).alias("neighbours"))
