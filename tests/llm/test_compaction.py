import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from hashlib import sha256
from pathlib import Path
from urllib.parse import unquote, urlparse
from zlib import crc32

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmine.llm import compaction
from quillmine.llm.queries_compaction import op12_bin_packed_compaction

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def plain_first_fit(sizes, most):
    sets = []
    for i, n in enumerate(sizes):
        for held in sets:
            if held[1] + n <= most:
                held[0].append(i)
                held[1] += n
                break
        else:
            sets.append([[i], n])
    return [h[0] for h in sets]


@pytest.mark.parametrize("seed", range(30))
def test_first_fit_set_by_set(seed):
    r = random.Random(seed)
    sizes = sorted((r.randrange(1, 40) for _ in range(r.randrange(0, 120))), reverse=True)
    most = r.randrange(5, 90)
    assert compaction.first_fit(sizes, most) == plain_first_fit(sizes, most)


def test_sizes_must_descend():
    with pytest.raises(ValueError):
        compaction.first_fit([1, 2], 5)


def brute(rows, names):
    """Final files by (day, lot, piece) of their first source."""
    total, days = len(rows), defaultdict(list)
    at = {n: i for i, n in enumerate(names)}
    size = lambda x: 1 + total // x
    for r in rows:
        when = r[at["arrived_at"]]
        days[None if when is None else (when - datetime(1970, 1, 1)).days].append(r)
    out = {}
    for day, held in days.items():
        files = defaultdict(list)
        for r in held:
            i = r[at["click_id"]]
            h = crc32(str(i).encode()) if i is not None else 0
            files[h // 16 % (1 + len(held) // size(150)), min(h % 4, h // 4 % 4)].append(r)
        low = lambda v: (v is not None, v if v is not None else 0)
        for f in files.values():
            f.sort(key=lambda r: (low(r[at["arrived_at"]] and (r[at["arrived_at"]] - datetime(1970, 1, 1)).total_seconds()), low(r[at["click_id"]])))
        small = sorted((k for k in files if len(files[k]) < size(600)), key=lambda k: (-len(files[k]), k))
        sets = [[small[i] for i in s] for s in plain_first_fit([len(files[k]) for k in small], size(500))]
        for s in [*sets, *([k] for k in files if k not in small)]:
            ids = [r[at["click_id"]] for k in s for r in files[k]]
            known = [i for i in ids if i is not None]
            cents = sum(math.floor(100 * r[at["value"]] + 0.5) for k in s for r in files[k] if r[at["value"]] is not None)
            digest = sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
            out[day, *s[0]] = (len(ids), min(known, default=None), max(known, default=None), cents, ",".join(f"{a}-{b}" for a, b in s), digest, ",".join(names), len(s) > 1)
    return out


def got(found):
    return {(r.day, r.lot, r.piece): (r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r["columns"], r.rewritten) for r in found}


def local(uri):
    return Path(unquote(urlparse(uri).path))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    clicks = spark.read.parquet(f"{sf}/clicks.parquet")
    found = op12_bin_packed_compaction(spark, sf).collect()
    assert got(found) == brute([tuple(r) for r in clicks.collect()], clicks.columns)
    assert len({r.rewritten for r in found}) == 2
    folder = local(found[0].path).parents[3]
    assert sorted(local(r.path) for r in found) == sorted(folder.rglob("*.parquet"))
    for r in found[::40]:
        held = pq.read_table(local(r.path), partitioning=None)
        assert ",".join(held.column_names) == r["columns"]
        assert sha256(",".join(map(str, held["click_id"].to_pylist())).encode()).hexdigest() == r.ids_sha256
    again = op12_bin_packed_compaction(spark, sf).first()
    assert local(again.path).parents[3] != folder  # a new folder at every call


def odd_clicks():
    r, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(i, start, start + timedelta(hours=r.randrange(0, 24 * 9)), 1, None, r.choice([None, 1.005, -3.2, 10.0]), "{}") for i in range(700)]
    rows += rows[:30] + [(None, None, start, None, None, None, None), (None, None, None, None, None, 2.5, None), (9000, None, None, 1, "x", 1.0, "y" * 100_000), (-5, start, datetime(1969, 12, 31, 23, 59), 1, None, 1.0, "")]
    return rows


def test_odd_rows(spark, tmp_path):
    """Null days and ids, repeated rows, ties, days before 1970, long values, and columns that clash with the partitions'."""
    df = spark.createDataFrame(odd_clicks(), CLICKS).withColumns({"day": F.lit(7), "Lot": F.lit("z"), "sources": F.lit(None).cast("string")})
    df.repartition(3).write.parquet(f"{tmp_path}/clicks.parquet")
    found = op12_bin_packed_compaction(spark, str(tmp_path)).collect()
    assert got(found) == brute([tuple(r) for r in df.collect()], df.columns)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], CLICKS).write.parquet(f"{tmp_path}/clicks.parquet")
    assert op12_bin_packed_compaction(spark, str(tmp_path)).collect() == []


def grouped(spark, folder, counts):
    rows = [(g, k, i) for g, sizes in counts.items() for k, n in enumerate(sizes) for i in range(n)]
    compaction.write_grouped(spark.createDataFrame(rows, "g long, k long, i int"), folder, ["g", "k"], [F.col("i")])
    return {p: p.read_bytes() for p in Path(folder).rglob("*.parquet")}


COUNTS = {1: [9, 8, 3, 2, 50], 2: [4, 4, 4], 3: [30]}


def check_compacted(folder, before):
    after = {p: p.read_bytes() for p in Path(folder).rglob("*.parquet")}
    sizes = {tuple(int(x.split("=")[1]) for x in p.parts[-3:-1]): pq.read_table(p, partitioning=None).num_rows for p in after}
    assert sizes == {(1, 0): 12, (1, 1): 10, (1, 4): 50, (2, 0): 12, (3, 0): 30}
    stay = [p for p in before if p in after]
    assert len(stay) == 2 and all(before[p] == after[p] for p in stay)
    assert not Path(f"{folder}-compaction/files").exists()


def test_untouched_files_stay_byte_for_byte(spark, tmp_path):
    folder = str(tmp_path / "data")
    before = grouped(spark, folder, COUNTS)
    compaction.compact(spark, folder, "g", ["k"], 20, 12)
    check_compacted(folder, before)
    compaction.compact(spark, folder, "g", ["k"], 20, 12)
    check_compacted(folder, before)  # nothing is left to put together


def test_cut_short_before_and_after_the_point_of_no_return(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "data")
    before = grouped(spark, folder, COUNTS)
    Path(f"{folder}-compaction/files/g=1").mkdir(parents=True)  # left by a run that was killed while it wrote
    Path(f"{folder}-compaction/files/g=1/part-0.parquet").write_bytes(b"half")
    with monkeypatch.context() as m:
        m.setattr(compaction, "_any", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            compaction.compact(spark, folder, "g", ["k"], 20, 12)
    assert before == {p: p.read_bytes() for p in Path(folder).rglob("*.parquet")}
    # Another is killed halfway through its moves.
    moved = sorted(Path(f"{folder}-compaction/files").rglob("g=2/*/*.parquet"))[0]
    moved.rename(Path(folder, "g=2", "k=0", moved.name))
    compaction.compact(spark, folder, "g", ["k"], 20, 12)
    check_compacted(folder, before)
