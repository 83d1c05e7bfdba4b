"""Compaction of small Parquet files, planned by first-fit and executed.

A dataset is a folder of Parquet files in partition folders `group=../rank=..` (any names and number). Within a group small
files are put together by first-fit, largest first, and one file replaces each set of several. The plan is made set by set
(`first_fit`), which gives what first-fit gives file by file.

`compact` works in steps that can each be repeated, in a folder beside the data: the plan is written, the new files are
written (their `_SUCCESS` is the point of no return), then tasks move each new file into place and delete the files it
replaces. A run that was cut short is taken up by the next: before the point of no return it starts anew, after it it
goes on. Readers meanwhile may see a row twice; they should wait until `files` in that folder has gone.

Rows are never in one task but those of one file; the driver has neither paths nor counts of files.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PATH = "_metadata.file_path"


def first_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Sets of items of at most `most` together, as first-fit in the given, descending order makes them.

    Set by set: the next set is the one opened by the largest item left. Whatever fits its rest first in order is found by bisection of
    the descending sizes, and taken items are skipped by a union-find whose roots are free items. An item joins the earliest set
    that has room when its turn comes, and sets don't influence earlier ones, so this gives the same sets.
    """
    falling = -np.asarray(sizes, np.int64)
    if (np.diff(falling) < 0).any():
        raise ValueError("sizes must descend")
    free = list(range(len(sizes) + 1))

    def find(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    sets, first = [], find(0)
    while first < len(sizes):
        held, rest, at = [], most, first
        while at < len(sizes):
            # The opening item is taken even if it alone is over the bound.
            held.append(at)
            free[at] = at + 1
            rest -= sizes[at]
            at = find(max(at + 1, int(np.searchsorted(falling, -rest, side="left")))) if rest >= 0 else len(sizes)
        sets.append(held)
        first = find(first)
    return sets


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_names(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted names for partition columns, longer where the table has such a column."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def write_grouped(df: DataFrame, folder: str, partition: list[str], order: list[Column]) -> None:
    """One file for each value of the partition columns, its rows in the given order. Partition columns aren't in the files."""
    laid = df.repartition(*partition).sortWithinPartitions(*partition, *order)
    laid.write.option("maxRecordsPerFile", 0).partitionBy(*partition).parquet(folder)


def read_files(spark: SparkSession, folder: str, partition: list[str]) -> DataFrame:
    """The rows of a dataset with __path, __row (their place in the file) and their partition columns as longs."""
    found = spark.read.parquet(folder)
    rest = [F.col(c) for c in found.columns if c not in partition]
    return found.select(*rest, *(F.col(p).cast("long").alias(p) for p in partition), F.col(_PATH).alias("__path"), F.col("_metadata.row_index").alias("__row"))


def _sets(group: str, rank: list[str], most: int):
    """Small files of one group, with the set each is in, its place there, and the file that the set begins with."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("rows", "descending"), *((r, "ascending") for r in rank), ("path", "ascending")])
        found = first_fit(part.column("rows").to_pylist(), most)
        flat = [i for held in found for i in held]
        sets = [k for k, held in enumerate(found) for _ in held]
        head = part.take(pa.array([held[0] for held in found for _ in held], pa.int64()))
        out = part.take(pa.array(flat, pa.int64()))
        return pa.table(
            [*(out.column(c) for c in (group, *rank, "path", "rows")), pa.array(sets, pa.int64()), pa.array([i for held in found for i in range(len(held))], pa.int64()), pa.array([len(held) for held in found for _ in held], pa.int64()),
             *(head.column(r) for r in rank)],
            names=[group, *rank, "path", "rows", "set", "place", "members", *(f"to_{r}" for r in rank)],
        )

    return run


def plan(files: DataFrame, group: str, rank: list[str], small: int, most: int) -> DataFrame:
    """files (group, rank columns, path, rows) with less than `small` rows: set, place in it, members of the set, and the rank columns of its first file (to_..)."""
    kinds = ", ".join(f"{c} long" for c in (group, *rank))
    schema = f"{kinds}, path string, rows long, set long, place long, members long, {', '.join(f'to_{r} long' for r in rank)}"
    few = files.where(F.col("rows") < small).select(group, *rank, "path", "rows")
    # A null group is a group too, which grouping by the column keeps.
    return few.groupBy(group).applyInArrow(_sets(group, rank, most), schema)


def _filesystem(uri: str):
    """The file system of a file of Spark's, for use in a task, and the path in it."""
    from pyarrow import fs

    parts = urlparse(uri)
    if not parts.scheme or parts.scheme == "file":
        return fs.LocalFileSystem(), unquote(parts.path)
    if parts.scheme == "s3a":
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri)


def _settle(batches):
    """Moves a new file into the folder of its set's first file, then deletes the set's files. Done again, it changes nothing more. No new file: an earlier run has moved it."""
    for batch in batches:
        for new, sources in zip(batch.column("new").to_pylist(), batch.column("sources").to_pylist()):
            files, head = _filesystem(sources[0])
            if new is not None:
                at = _filesystem(new)[1]
                if files.get_file_info(at).is_file:
                    files.move(at, f"{head.rpartition('/')[0]}/{at.rpartition('/')[2]}")
            for source in sources:
                place = _filesystem(source)[1]
                if files.get_file_info(place).is_file:
                    files.delete_file(place)
                side, _, own = place.rpartition("/")
                crc = f"{side}/.{own}.crc"
                if files.get_file_info(crc).is_file:
                    files.delete_file(crc)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["done"])


def compact(spark: SparkSession, folder: str, group: str, rank: list[str], small: int, most: int) -> DataFrame:
    """Executes the plan for the dataset and returns it (see `plan`), as a table that stays beside the data until the next compaction.

    small: files below so many rows are put together, up to `most` rows. Null partition values are kept. Files not in a set of several stay untouched, byte for byte.
    """
    partition = [group, *rank]
    new, kept = f"{folder}-compaction/files", f"{folder}-compaction/plan"
    if not exists(spark, f"{new}/_SUCCESS"):
        _remove(spark, f"{folder}-compaction")
        files = read_files(spark, folder, partition).groupBy(*partition, F.col("__path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        plan(files, group, rank, small, most).write.parquet(kept)
        several = spark.read.parquet(kept).where("members > 1")
        rows = read_files(spark, folder, partition).drop(*rank)
        # The plan is a written table, so Spark knows its size and broadcasts it or not.
        joined = rows.join(several.select(F.col("path").alias("__path"), "place", *(F.col(f"to_{r}").alias(r) for r in rank)), "__path")
        laid = joined.repartition(*partition).sortWithinPartitions(*partition, "place", "__row").drop("__path", "place", "__row")
        laid.write.option("maxRecordsPerFile", 0).partitionBy(*partition).parquet(new)
    done = spark.read.parquet(kept)
    several = done.where("members > 1").groupBy(group, *(F.col(f"to_{r}").alias(r) for r in rank)).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("sources"))
    if _any(spark, new):
        made = spark.read.schema(", ".join(f"{p} long" for p in partition)).parquet(new).groupBy(*partition).agg(F.first(_PATH).alias("new"))
        same = [made[p].eqNullSafe(several[p]) for p in partition]
        several.join(made, same, "left").select("new", "sources").mapInArrow(_settle, "done long").agg(F.sum("done")).collect()
    _remove(spark, new)
    return done


def _any(spark: SparkSession, folder: str) -> bool:
    """Whether there is a partition folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return any(f.isDirectory() for f in files)


def _digests(partition: list[str], ident: str, amount: str):
    """One row a file from rows that come file by file in order: the hash is fed as they come, so a file of any size takes no memory."""
    names = [*partition, "n_rows", "least", "most", "amount", "ids_sha256"]

    def run(batches):
        import pyarrow.compute as pc
        from hashlib import sha256

        now, held = None, None

        def give():
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (*now, held["n"], held["least"], held["most"], held["amount"])), pa.array([held["sha"].hexdigest()])], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [pc.fill_null(batch.column(p), -(1 << 62)).to_numpy(zero_copy_only=False) for p in partition]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(batch.column(p)[lo].as_py() for p in partition)
                if key != now:
                    if now is not None:
                        yield give()
                    now, held = key, {"n": 0, "least": None, "most": None, "amount": 0, "sha": sha256()}
                ids = batch.column(ident).slice(lo, hi - lo)
                held["sha"].update(("," if held["n"] else "").encode() + ",".join(x or "" for x in ids.cast(pa.string()).to_pylist()).encode())
                held["n"] += hi - lo
                held["amount"] += pc.sum(batch.column(amount).slice(lo, hi - lo)).as_py() or 0
                span = pc.min_max(ids).as_py()
                held["least"] = min((x for x in (held["least"], span["min"]) if x is not None), default=None)
                held["most"] = max((x for x in (held["most"], span["max"]) if x is not None), default=None)
        if now is not None:
            yield give()

    return run


def file_report(spark: SparkSession, folder: str, done: DataFrame, group: str, rank: list[str], ident: str, amount: Column) -> DataFrame:
    """One row for each file of a dataset of `write_grouped` after `compact`, read back from it: the partition columns, n_rows, the least and most of
    ident (a long), the sum of amount (a long), ids_sha256 (of the comma-joined idents in file order; a null one is empty), sources (the rank columns of the files in it, in order), path and rewritten."""
    partition = [group, *rank]
    rows = read_files(spark, folder, partition)
    paths = rows.groupBy(*partition).agg(F.first("__path").alias("path"))
    laid = rows.select(*partition, "__row", F.col(ident).cast("long").alias("ident"), amount.alias("amount")).repartition(*partition).sortWithinPartitions(*partition, "__row").drop("__row")
    kinds = ", ".join(f"{p} long" for p in partition)
    found = laid.mapInArrow(_digests(partition, "ident", "amount"), f"{kinds}, n_rows long, least long, most long, amount long, ids_sha256 string")
    named = F.array_join(F.array(*(F.col(r).cast("string") for r in rank)), "-").alias("name")
    sets = done.where("members > 1").groupBy(F.col(group).alias("__g"), *(F.col(f"to_{r}").alias(f"__{r}") for r in rank)).agg(F.array_sort(F.collect_list(F.struct("place", named))).alias("__all"))
    sources = F.array_join(F.transform("__all", lambda x: x["name"]), ",")
    listed = sets.select("__g", *(f"__{r}" for r in rank), sources.alias("__sources"))
    match = [F.col(group).eqNullSafe(F.col("__g")), *(F.col(r) == F.col(f"__{r}") for r in rank)]
    out = found.join(listed, match, "left").select(*(F.col(c) for c in found.columns), "__sources")
    here = paths.select(*(F.col(p).alias(f"__{p}_") for p in partition), "path")
    out = out.join(here, [F.col(p).eqNullSafe(F.col(f"__{p}_")) for p in partition])
    return out.select(*found.columns, F.coalesce("__sources", named).alias("sources"), "path", F.col("__sources").isNotNull().alias("rewritten"))
