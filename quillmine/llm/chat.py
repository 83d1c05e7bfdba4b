"""Multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation its dialogue is rendered with that speaker as the assistant
and all others as named users; system turns stay system turns and have no perspective. The mask
marks the characters that are learnt: the text and the end mark of the speaker's own turns.

A dialogue is one row for every `segment_turns` turn numbers, and for every `part_rows` turns of those where
numbers are equal or null, so that no row has a conversation of unbounded length; most have one. Its text is the
concatenation of its parts in order. Turns are shuffled once, by conversation and segment, and meet the speakers of their
conversation there; what is rendered isn't shuffled. Only turns of one segment are sorted in one task, which may spill.

Defined results: a null role is the speaker "unknown", a null text is empty, null turns come first (segment 0),
ties are ordered by role and text, repeated rows are repeated turns, and rows with a null conv_id form one conversation.
A conversation of system turns alone has no row. Marks inside texts are escaped. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.llm.common import id_text

SEGMENT_TURNS = 64
PART_ROWS = 1024
SYSTEM = ("system",)


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def perspectives(turns: DataFrame, segment_turns: int = SEGMENT_TURNS, system_roles: tuple[str, ...] = SYSTEM, part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, perspective, segment, part, n_turns, text, and mask: an array of (start, length) in characters of the text."""
    said = turns.select(
        "conv_id",
        id_text(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown")).alias("role"),
        _escaped(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(0)).cast("long").alias("segment"),
    )
    is_system = F.lower("role").isin(*system_roles)
    speakers = said.where(~is_system).select("conv", F.col("role").alias("perspective")).distinct()
    meetings = said.select("conv", "segment").distinct().join(speakers, "conv")
    place = F.row_number().over(Window.partitionBy("conv", "segment").orderBy("turn", "role", "text"))
    seen = said.withColumn("part", F.floor((place - 1) / part_rows).cast("long")).join(meetings, ["conv", "segment"])
    own = (F.col("role") == F.col("perspective")) & ~is_system
    head = F.when(own, F.lit("<|assistant|>\n")).when(is_system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _escaped("role"), F.lit("|>\n")))
    rendered = seen.select(
        "conv_id", "conv", "perspective", "segment", "part", "turn", "role", "text", head.alias("head"), own.alias("own"),
    )
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "own")))
    grouped = rendered.groupBy("conv", "segment", "part", "perspective").agg(F.first("conv_id").alias("conv_id"), parts.alias("parts"))
    grouped = grouped.withColumn("pieces", F.transform("parts", lambda p: F.concat(p.head, p.text, F.lit("<|end|>\n"))))
    grouped = grouped.withColumn("sizes", F.transform("pieces", F.length))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        F.arrays_zip("parts", "sizes"),
        start,
        lambda a, x: F.struct(
            (a.at + x.sizes).alias("at"),
            F.when(x.parts.own, F.concat(a.spans, F.array(F.struct((a.at + F.length(x.parts.head)).alias("start"), (x.sizes - F.length(x.parts.head)).alias("length")))))
            .otherwise(a.spans)
            .alias("spans"),
        ),
        lambda a: a.spans,
    )
    return grouped.select("conv_id", "perspective", "segment", "part", F.size("parts").alias("n_turns"), F.array_join("pieces", "").alias("text"), spans.alias("mask"))
