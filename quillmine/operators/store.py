"""A store of items by key: an append-only log with tombstones, and compaction that deletes for good.

Each put or delete is one commit that adds rows with a number; the latest row of a key counts. Nothing is rewritten until
`compact`, which writes what counts, drops deleted keys and what was put over, and removes the files that had them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.sources.commits import CommitLog, Version


class KeyedStore:
    """Items (key, and any columns that all puts share) under a path. Of rows with one key in a put, any one counts; a null key is refused."""

    NAME = "items"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path, {})

    def put(self, items: DataFrame) -> Version:
        if not items.where("key is null").isEmpty():
            raise ValueError("an item needs a key")
        return self._add(lambda n: items.withColumns({"__seq": F.lit(n).cast("long"), "__gone": F.lit(False)}))

    def delete(self, keys: DataFrame) -> Version:
        """Items with these keys (key) are gone; those that aren't there don't matter."""
        return self._add(lambda n: keys.select("key").where("key is not null").distinct().withColumns({"__seq": F.lit(n).cast("long"), "__gone": F.lit(True)}))

    def _add(self, rows) -> Version:
        def attempt(base: Version) -> Version:
            piece, held = rows(base.number + 1), base.schemas.get(self.NAME)
            if held:  # tombstones get the items' columns, and items those of earlier ones
                have = {f["name"] for f in held["fields"]}
                for f in self.log.read_pieces(self.NAME, base).schema:
                    if f.name not in piece.columns:
                        piece = piece.withColumn(f.name, F.lit(None).cast(f.dataType))
                piece = piece.select(*(f["name"] for f in held["fields"]), *(c for c in piece.columns if c not in have))
            return self.log.commit({}, base=base, pieces={self.NAME: (piece, _latest)})

        return self.log.retried(attempt)

    def read(self, version: Version | None = None) -> DataFrame | None:
        """All items, or None if nothing was ever put."""
        held = self.log.read_pieces(self.NAME, version)
        return None if held is None else _latest(held).where("not __gone").drop("__seq", "__gone")

    def get(self, keys: DataFrame) -> DataFrame | None:
        """The items with these keys (key)."""
        held = self.log.read_pieces(self.NAME)
        if held is None:
            return None
        return _latest(held.join(keys.select("key").distinct(), "key", "left_semi")).where("not __gone").drop("__seq", "__gone")

    def compact(self) -> Version:
        """Write what counts as one piece, and remove every other file and version."""
        def attempt(base: Version) -> Version:
            held = self.log.read_pieces(self.NAME, base)
            return base if held is None else self.log.replace_pieces(self.NAME, _latest(held).where("not __gone"), base)

        made = self.log.retried(attempt)
        self.log.expire(keep=1)
        return made


def _latest(rows: DataFrame) -> DataFrame:
    """The row of the largest number of each key; tombstones stay, as older pieces may have the key."""
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "__seq").alias("__row")).select("key", *(F.col(f"__row.`{c}`").alias(c) for c in rest)).select(*rows.columns)
