import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.llm import mixing, queries_mixing
from tests.llm.helpers import frame, odd_docs


def order_of(counts, size):
    """Source of each slot, frame by frame, each made on its own."""
    counts = np.array(counts)
    total, out = int(counts.sum()), []
    for k in range(-(-total // size)):
        start, source, block = mixing.frame_schedule(counts, k, size)
        assert start == len(out)
        slot = np.arange(start, start + len(source))
        assert (block * total // counts[source] <= slot).all() and (slot < -(-(block + 1) * total // counts[source])).all()
        out += source.tolist()
    return counts, np.array(out)


def worst_deviation(counts, order):
    """The largest distance of any source's blocks from its weight, over all prefixes."""
    total, t = int(counts.sum()), np.arange(1, len(order) + 1)
    assert np.array_equal(np.bincount(order, minlength=len(counts)), counts)
    return max(np.abs(np.cumsum(order == s) - t * n / total).max() for s, n in enumerate(counts))


@pytest.mark.parametrize("size", [7, 50, 10**6])
@pytest.mark.parametrize("counts", [[1], [3, 2, 1], [97, 2, 1], [50, 25, 13, 12], list(range(1, 21)), [300, 300, 300, 99, 1], [1] * 40, [333, 333, 334], [500, 1, 1, 1], [211, 211, 211, 211, 156]])
def test_deviation_is_below_one_block(counts, size):
    assert worst_deviation(*order_of(counts, size)) < 1


@pytest.mark.parametrize("total", [40_000, 200_000, 1_000_000])
def test_deviation_is_below_one_block_at_any_size(total):
    r = random.Random(total)
    weights = [r.random() ** 3 + 1e-5 for _ in range(23)]
    counts = [max(1, int(total * w / sum(weights))) for w in weights]
    assert worst_deviation(*order_of(counts, 50_000)) < 1


@pytest.mark.parametrize("seed", range(40))
def test_frames_of_any_mix_fit_together(seed):
    r = random.Random(seed)
    counts = [r.randrange(1, 10 ** r.randrange(1, 4)) for _ in range(r.randrange(1, 30))]
    assert worst_deviation(*order_of(counts, r.randrange(5, 400))) < 1


def test_capped():
    blocks = {"hot": 500, "a": 100, "b": 100, "c": 100, "d": 200}
    mix = mixing.target_mix(blocks, mixing.capped_weights(blocks, 0.3))
    assert mix.kept == {"hot": 214, "a": 100, "b": 100, "c": 100, "d": 200} and mix.rest == {"hot": 286}
    for even in ({"a": 5, "b": 5}, {"a": 10, "b": 10, "c": 10, "d": 10}):
        assert mixing.target_mix(even, mixing.capped_weights(even, 0.3)).kept == even
    assert mixing.target_mix({}, mixing.capped_weights({})) == mixing.Mix({}, {})


@pytest.mark.parametrize("small", [19, 300, 3000])
def test_the_cap_holds_among_many_sources(small):
    blocks = {"hot": 40_000} | {f"s{k}": 1 + k % 37 for k in range(small)}
    mix = mixing.target_mix(blocks, mixing.capped_weights(blocks, 0.3))
    assert all(mix.kept[s] == n for s, n in blocks.items() if s != "hot")
    share = mix.kept["hot"] / sum(mix.kept.values())
    assert 0.3 - 1 / sum(mix.kept.values()) - 1e-3 <= share <= 0.3


def test_given_weights():
    mix = mixing.target_mix({"a": 100, "b": 50, "c": 9, None: 4}, {"a": 1, "b": 1, None: 0.1})
    assert mix.kept == {"a": 40, "b": 40, None: 4} and mix.rest == {"a": 60, "b": 10, "c": 9}


def docs(spark, sizes):
    names = [s for s, n in sizes.items() for _ in range(n)]
    return frame(spark, ["t"] * len(names), lambda i: names[i])


def test_interleave(spark):
    sizes = {"hot": 900, "a": 100, "b": 90, "c": 110, None: 1}
    rows = docs(spark, sizes)
    out = mixing.places(rows, block_rows=4).collect()
    assert len(out) == sum(sizes.values()) == len({r.position for r in out})
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert all(r.in_mix for r in out if r.source != "hot") and not all(r.in_mix for r in out)
    slot_of = {}
    for r in out:
        assert slot_of.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    inside = [r for r in out if r.in_mix]
    assert sum(r.source == "hot" for r in inside) / len(inside) == pytest.approx(0.3, abs=0.02)
    kept = mixing.mixed_documents(rows, block_rows=4)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in inside}
    order = [r.doc_id for r in mixing.ordered_documents(rows, block_rows=4).collect()]
    assert sorted(order) == list(range(len(out))) and set(order[: len(inside)]) == {r.doc_id for r in inside}


def test_the_query_by_hand(spark, tmp_path):
    """Every document once; blocks of 16 in the order of a schedule whose every prefix is within one block of the weights."""
    sizes = {"hot": 700, "a": 200, "b": 120, "c": 133, None: 47}
    rows = docs(spark, sizes)
    rows.union(rows.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries_mixing.op4_pfair_mixing(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(sum(sizes.values())))
    blocks = {}
    for r in out:
        blocks.setdefault((r.source, r.block), []).append(r)
    for (source, block), own in blocks.items():
        assert len({r.slot for r in own}) == 1 and len(own) == min(16, sizes[source] - 16 * block)
    mix = {s: len({r.block for r in out if r.source == s and r.in_mix}) for s in sizes}
    assert all(mix[s] == -(-n // 16) for s, n in sizes.items() if s != "hot")
    rest = sum(n for s, n in mix.items() if s != "hot")
    assert mix["hot"] == int(rest * 0.3 / 0.7)
    order = [s for _, s in sorted((own[0].slot, s) for (s, _), own in blocks.items() if own[0].in_mix)]
    total = len(order)
    for k in range(1, total + 1):
        for s, n in mix.items():
            assert abs(order[:k].count(s) - k * n / total) < 1


def test_many_frames_are_one_schedule(spark):
    rows = docs(spark, {"hot": 900, "a": 100, "b": 90, "c": 110, None: 7}).select("source", "doc_id")
    blocks = mixing.block_counts(rows, 2)
    mix = mixing.target_mix(blocks, mixing.capped_weights(blocks, 0.3))
    out = mixing.interleave(rows, mix, 2, frame=20).collect()
    assert len(out) == 1207 == len({r.position for r in out}) and all(r.release <= r.slot < r.deadline for r in out)
    assert {r.slot for r in out} == set(range(sum(blocks.values())))
    assert max(r.slot for r in out if r.in_mix) < min(r.slot for r in out if not r.in_mix)


def test_the_same_at_any_partitioning(spark):
    rows = docs(spark, {"hot": 300, "a": 50, "b": 40, "c": 10})
    one = sorted(map(tuple, mixing.places(rows).collect()))
    assert sorted(map(tuple, mixing.places(rows.repartition(7)).collect())) == one


def test_odd_rows(spark):
    rows = odd_docs(spark)
    assert mixing.places(rows).count() == rows.select("source", "doc_id").distinct().count()
    none = rows.limit(0)
    assert mixing.places(none).count() == 0 == mixing.ordered_documents(none).count()
    assert mixing.ordered_documents(rows).count() == rows.count()
    twice = docs(spark, {"hot": 90, "a": 9, "b": 9, "c": 9})
    assert mixing.mixed_documents(twice.union(twice), block_rows=1).count() == 2 * mixing.mixed_documents(twice, block_rows=1).count()


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.block_counts(docs(spark, {"a": 1, "b": 1, "c": 1}).withColumn("source", F.col("source")))
