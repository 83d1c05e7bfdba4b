"""What a service over the engine answers: its health, transcripts that are kept until they are deleted, and requirement checks of those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.functions.errors import CorpusError
from quillmine.operators.indexing import ChunkIndex
from quillmine.operators.records import parse_transcripts
from quillmine.operators.rules import check_requirements, rules_for
from quillmine.operators.store import KeyedStore

READY, DEGRADED = "ready", "degraded"
#: Status and reason of a request that can't be checked.
GONE, INCOMPLETE, NO_RULES = (404, "no such transcript"), (422, "programme and admission year are needed"), (422, "no rules for this programme and year")
COURSES = ["ordinal", "course_code", "course_name", "credits", "grade", "term", "status", "source_page", "confidence"]
RECORD = ["programme", "admission_year", "total_credits_reported", "warnings"]


def health(index: ChunkIndex) -> str:
    """ready if questions can be answered from the index."""
    try:
        index.corpus()
    except CorpusError:
        return DEGRADED
    return READY


class Transcripts:
    """Parsed transcripts by key under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = KeyedStore(spark, path)

    def parse(self, pages: DataFrame) -> DataFrame:
        """Parse transcripts (key, page, text), keep them, and return them: key, the record's columns, and courses in order."""
        courses, records = parse_transcripts(pages)
        listed = courses.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*COURSES))).alias("courses"))
        found = records.join(listed, "key", "left")
        shape = listed.schema["courses"].dataType
        kept = found.select("key", *RECORD, F.coalesce("courses", F.array().cast(shape)).alias("courses"))
        self.store.put(kept)
        return self.store.get(pages.select("key"))

    def check(self, requests: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(reports, groups, refused) of requests (key, programme, admission_year), whose last two default to the transcript's own.

        reports and groups are those of `rules.check_requirements`; refused has key, status and reason.
        """
        asked = requests.select("key", F.nullif(F.col("programme"), F.lit("")).alias("asked"), F.col("admission_year").alias("year"))
        held = self.store.get(requests.select("key"))
        if held is None:
            held = requests.select("key", *(F.lit(None).cast(t).alias(c) for c, t in zip([*RECORD, "courses"], ["string", "int", "double", "array<string>", "array<struct<ordinal:int,course_code:string,credits:double,status:string>>"]))).limit(0)
        known = asked.join(held.withColumn("__known", F.lit(True)), "key", "left").select(
            "key", F.coalesce("asked", "programme").alias("programme"), F.coalesce("year", "admission_year").cast("int").alias("admission_year"), "courses", F.coalesce("__known", F.lit(False)).alias("known")
        )
        full = F.col("programme").isNotNull() & F.col("admission_year").isNotNull()
        applied = rules_for(known.where(F.col("known") & full), rules)
        courses = known.select("key", F.explode("courses").alias("c")).select("key", "c.ordinal", "c.course_code", "c.credits", "c.status")
        report, groups = check_requirements(courses, applied)
        judged = known.join(applied.select("key").distinct().withColumn("__ruled", F.lit(True)), "key", "left")
        pick = lambda i: F.when(~F.col("known"), GONE[i]).when(~full, INCOMPLETE[i]).when(F.col("__ruled").isNull(), NO_RULES[i])
        refused = judged.select("key", pick(0).alias("status"), pick(1).alias("reason")).where("status is not null")
        return report, groups, refused

    def delete(self, keys: DataFrame) -> None:
        """Forget transcripts (key); their files go with the next `store.compact()`."""
        self.store.delete(keys)
