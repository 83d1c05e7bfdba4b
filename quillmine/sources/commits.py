"""Several tables that change together, in hash buckets, behind one pointer.

A table's rows lie in buckets by a hash of their key. A change rewrites only the buckets that have a changed key, and
a version is one small file, `versions/<number>.json`, that names the folder of every bucket of every table. It is written last and
only if there is none of that number, so all tables change at once: a run that is killed before leaves the old version, and of two
writers that started from one version the second fails (`Conflict`) and may start again from the new one. Folders that no
version left names are removed by `expire`.

Beside tables a version may have pieces: tables to which a commit only adds, such as signed counts that merge by a sum. When there
are more than `MOST_PIECES` of a kind, the commit writes their merged form in their place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmine.sources.tables import read_text, write_text

BUCKETS = 64
#: Files of a bucket.
FILES = 4
MOST_PIECES = 8


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Version:
    """A number, the folder of each bucket of each table, the folders of pieces, schemas, and small values that belong to it."""

    number: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    pieces: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    values: dict = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {p for held in self.tables.values() for p in held.values()} | {p for held in self.pieces.values() for p in held}


@dataclass(frozen=True)
class Change:
    """What a commit does to a table: rows whose key is in `removed` (the key columns) go, then `added` rows come."""

    removed: DataFrame | None = None
    added: DataFrame | None = None


class CommitLog:
    """Tables under a path. keys: for each table the columns that decide the bucket of a row."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = self._files()
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self, number: int | None = None) -> Version:
        """The last version, or one of a number; version 0 is empty. A pointer that its writer hasn't finished doesn't count."""
        for n in [number] if number is not None else reversed(self.numbers()):
            if n == 0:
                break
            try:
                return Version(**json.loads(read_text(self.spark, f"{self.path}/versions/{n:012d}.json")))
            except json.JSONDecodeError:
                if number is not None:
                    raise
        return Version()

    def _read(self, name: str, folders: list[str], version: Version) -> DataFrame | None:
        schema = version.schemas.get(name)
        return self.spark.read.schema(StructType.fromJson(schema)).parquet(*(f"{self.path}/{p}" for p in folders)) if folders else None

    def read(self, table: str, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table of a version (the last), or some of its buckets; None if it has no rows."""
        version = version or self.version()
        held = version.tables.get(table, {})
        return self._read(table, sorted({p for b, p in held.items() if buckets is None or int(b) in buckets}), version)

    def read_pieces(self, name: str, version: Version | None = None) -> DataFrame | None:
        version = version or self.version()
        return self._read(name, version.pieces.get(name, []), version)

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.buckets)).cast("int")

    def touched(self, table: str, change: Change) -> list[int]:
        """Numbers of buckets with a changed key: at most as many as there are buckets."""
        found = [d.select(self.bucket(table).alias("b")).distinct() for d in (change.removed, change.added) if d is not None]
        rows = found[0].collect() if len(found) == 1 else found[0].unionByName(found[1]).distinct().collect()
        return sorted(r.b for r in rows)

    def _rewritten(self, table: str, change: Change, base: Version) -> tuple[dict[str, str], dict | None]:
        """The folders of the table's buckets after a change, and its schema if rows were written."""
        touched = self.touched(table, change)
        old = self.read(table, base, touched)
        if old is not None and change.removed is not None:
            old = old.join(change.removed.select(*self.keys[table]).distinct(), self.keys[table], "left_anti")
        parts = [d for d in (old, change.added) if d is not None]
        held = {b: p for b, p in base.tables.get(table, {}).items() if int(b) not in touched}
        if not parts or not touched:
            return held, None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        folder = f"data/{table}-{uuid.uuid4().hex}"
        # A bucket is several files, so that no task writes a large one whole.
        spread = F.pmod(F.xxhash64(*(c for c, kind in rows.dtypes if not kind.startswith("map"))), F.lit(FILES))
        rows.withColumn("__bucket", self.bucket(table)).repartition("__bucket", spread).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        left = {int(n.split("=")[1]) for n in self._names(folder) if n.startswith("__bucket=")}
        return held | {str(b): f"{folder}/__bucket={b}" for b in touched if b in left}, rows.schema.jsonValue()

    def _with_piece(self, name: str, piece: DataFrame, merge: Callable[[DataFrame], DataFrame], base: Version) -> tuple[list[str], dict]:
        held, folder = base.pieces.get(name, []), f"data/{name}-{uuid.uuid4().hex}"
        if len(held) < MOST_PIECES:
            piece.write.parquet(f"{self.path}/{folder}")
            return [*held, folder], piece.schema.jsonValue()
        merged = merge(self.read_pieces(name, base).unionByName(piece))
        merged.write.parquet(f"{self.path}/{folder}")
        return [folder], merged.schema.jsonValue()

    def replace_pieces(self, name: str, rows: DataFrame, base: Version) -> Version:
        """A version whose only piece of that name has these rows."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return self._point(Version(base.number + 1, base.tables, base.pieces | {name: [folder]}, base.schemas | {name: rows.schema.jsonValue()}, base.values))

    def _point(self, made: Version) -> Version:
        if not write_text(self.spark, f"{self.path}/versions/{made.number:012d}.json", json.dumps(asdict(made), sort_keys=True)):
            raise Conflict(f"version {made.number} exists")
        return made

    def commit(self, changes: dict[str, Change], values: dict | None = None, base: Version | None = None, pieces: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]] | None = None) -> Version:
        """Apply changes to tables on top of a version (the last), all at once. pieces: by name what is added, and how pieces of that name are merged."""
        base = base or self.version()
        tables, added, schemas = dict(base.tables), dict(base.pieces), dict(base.schemas)
        for name, change in changes.items():
            if change.removed is not None or change.added is not None:
                tables[name], schema = self._rewritten(name, change, base)
                schemas |= {name: schema} if schema else {}
        for name, (piece, merge) in (pieces or {}).items():
            added[name], schemas[name] = self._with_piece(name, piece, merge, base)
        return self._point(Version(base.number + 1, tables, added, schemas, base.values | (values or {})))

    def retried(self, attempt: Callable[[Version], Version], times: int = 5) -> Version:
        """attempt(base), again from the new version where another writer came first."""
        for left in reversed(range(times)):
            try:
                return attempt(self.version())
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def expire(self, keep: int = 2) -> int:
        """Remove all versions but the last `keep`, and folders that none of those names; how many folders went. Only when nobody writes: an unfinished commit's folders go too."""
        numbers = self.numbers()
        files, path = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        for n in numbers[:-keep]:
            files.delete(path(f"{self.path}/versions/{n:012d}.json"), False)
        named = set().union(*(self.version(n).folders() for n in numbers[-keep:]))
        gone = 0
        for folder in self._names("data"):
            place = f"data/{folder}"
            inside = [f"{place}/{n}" for n in self._names(place) if n.startswith("__bucket=")]
            for p in inside or [place]:
                if p not in named:
                    files.delete(path(f"{self.path}/{p}"), True)
                    gone += 1
            if inside and not named.intersection(inside):
                files.delete(path(f"{self.path}/{place}"), True)
        return gone
