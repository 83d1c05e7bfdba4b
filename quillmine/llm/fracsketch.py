"""Threshold-scaled sketches of documents, with DataFrame functions only.

The sketch of a text is the set of its shingles' hashes below a fixed part of the hash range: 1 / SCALE of it or, where that
keeps fewer than `LEAST`, twice as much, and so on up to all hashes. The part follows from the sketch itself (`limit`): it is the first that
holds LEAST of its hashes. Two sketches are compared below the smaller of their limits, where both are complete, and the
sketch of a union is made of the union of sketches, so sketches of any sizes can be compared and merged by plain set operations. The share of
the smaller set that is in the other estimates containment, also between very unequal documents.

Shingles are five words; a shorter text is one shingle, a text without words has none and an empty
sketch. Containment of two empty sketches is 1, of an empty and another one 0. A text of fewer than LEAST shingles keeps all of them, so
two short texts are compared exactly; a short one beside a long one is compared by what it has below the long one's limit, and is 0 if it has nothing there.

Defined results for neighbours: a null text is empty. The order is doc_id descending, null ids last, ties by text
hash; each row has one next row, and the last one's next is the first. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.llm.common import WORD_SPLIT

SHINGLE = 5
#: One hash in SCALE is kept.
SCALE = 4
#: Hashes that a sketch has at least, unless its text has fewer.
LEAST = 16
BUCKET_ROWS = 2_000
MOST_BUCKETS = 4_000


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct kept hashes of a text."""
    words = F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        return F.when(
            F.size(h) >= shingle,
            F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(shingle)))),
        ).otherwise(F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))

    # An array of one element lets a lambda name the hashes once.
    return F.transform(F.transform(F.array(hashes), lambda h: F.array_distinct(shingles(h))), lambda s: _cut(s, scale))[0]


def _limits(scale: int) -> list[int]:
    """The largest hashes of the parts that a sketch may keep, from 1 / scale of the range to half of it."""
    parts = [k for k in (scale >> i for i in range(scale.bit_length())) if k > 1]
    return [-(1 << 63) + (1 << 64) // k - 1 for k in parts]


def limit(values: Column, scale: int = SCALE) -> Column:
    """The largest hash that a sketch may have; all hashes of its text up to that are in it."""
    found = F.lit((1 << 63) - 1)
    for last in reversed(_limits(scale)):
        found = F.when(F.size(F.filter(values, lambda x: x <= F.lit(last))) >= LEAST, F.lit(last)).otherwise(found)
    return found


def _up_to(values: Column, last: Column) -> Column:
    """The hashes up to a limit. The limit is bound by an array of one element, as a lambda's body is evaluated anew for each hash."""
    return F.transform(F.array(last), lambda bound: F.filter(values, lambda x: x <= bound))[0]


def _cut(hashes: Column, scale: int) -> Column:
    """Distinct hashes as a sketch."""
    return F.sort_array(_up_to(hashes, limit(hashes, scale)))


def as_text(values: Column) -> Column:
    """All hashes in order, 16 hexadecimal digits each; the sketch can be read back from it."""
    return F.lower(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller shingle set that the other one has."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(least > 0, shared / least).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def near(values: Column, other: Column, scale: int = SCALE) -> Column:
    """Containment of two texts by their sketches, below the smaller of the sketches' limits."""
    pair = F.transform(F.array(F.least(limit(values, scale), limit(other, scale))), lambda last: containment(_up_to(values, last), _up_to(other, last)))
    return pair[0]


def merged(sketches: Column, scale: int = SCALE) -> Column:
    """The sketch of all texts of a group, as an aggregate."""
    every = F.collect_set(sketches)
    last = F.array_min(F.transform(every, lambda s: limit(s, scale)))
    return _cut(F.array_distinct(_up_to(F.flatten(every), last)), scale)


def range_limits(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Descending limits of ranges of doc_id: quantiles, at most MOST_BUCKETS of them, so that each task sorts one range."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    buckets = min(MOST_BUCKETS, n // bucket_rows + 1)
    if buckets < 2:
        return []
    return sorted({int(x) for x in ids.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.1 / buckets)}, reverse=True)


def neighbours(docs: DataFrame, sketched: bool = True, bucket_rows: int = BUCKET_ROWS, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Each row's doc_id, text, next text in the ring, and the sketches of both."""
    limits = range_limits(docs, bucket_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Bucket 0 has the largest ids; a null id is in the last one.
    if limits:
        bucket = F.coalesce(F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x > F.col("doc_id"))), F.lit(len(limits)))
    else:
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1))  # a literal would turn the joins below into loops
    rows = rows.withColumn("bucket", bucket.cast("int"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("less"), F.xxhash64("text").alias("hash"))
    # The first row of each range also goes, marked, to the range before it, and the very first one to the last.
    firsts = rows.groupBy("bucket").agg(F.min(place).alias("first"))
    heads = [r.bucket for r in firsts.select("bucket").orderBy("bucket").collect()]  # MOST_BUCKETS at most
    if not heads:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"), F.lit(None).cast("array<bigint>").alias("fp"), F.lit(None).cast("array<bigint>").alias("next_fp"))
    before = {b: heads[k - 1] for k, b in enumerate(heads)}
    spark = docs.sparkSession
    target = spark.createDataFrame([(b, p) for b, p in before.items()], "head_bucket int, target int")
    marks = firsts.join(F.broadcast(target), F.col("bucket") == F.col("head_bucket")).select(F.col("bucket").alias("head_bucket"), "first", "target")
    marks = marks.withColumn("first_key", F.xxhash64("first"))
    extra = rows.withColumn("place", place).withColumn("place_key", F.xxhash64("place"))
    extra = extra.join(F.broadcast(marks), (F.col("bucket") == F.col("head_bucket")) & (F.col("place_key") == F.col("first_key")) & F.col("place").eqNullSafe(F.col("first")))
    extra = extra.groupBy("target", "doc_id", "text").agg(F.first("bucket").alias("head")).select("doc_id", "text", F.col("target").alias("bucket"), F.lit(1).alias("tail"))
    dealt = rows.withColumn("tail", F.lit(0)).unionByName(extra).repartition("bucket")
    if sketched:
        dealt = dealt.withColumn("fp", sketch(F.col("text"), shingle, scale))
    else:
        dealt = dealt.withColumn("fp", F.lit(None).cast("array<bigint>"))
    ring = Window.partitionBy("bucket").orderBy("tail", *order)
    return dealt.select("doc_id", "text", "tail", "fp", F.lead("text").over(ring).alias("next_text"), F.lead("fp").over(ring).alias("next_fp")).where("tail = 0").drop("tail")
