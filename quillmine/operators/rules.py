"""Requirement rules: which apply to a transcript, and how far they are met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.functions.text import clean, normalize_code

GROUP = "struct<id:string,name:string,type:string,required_credits:double,minimum_courses:int,courses:array<string>>"
RULES_SCHEMA = f"programme string, programme_aliases array<string>, admission_year_start int, admission_year_end int, minimum_total_credits double, requirement_groups array<{GROUP}>, manual_review_rules array<string>"
COUNTED = ("passed", "exempted", "transferred")


def programme_key(name: Column) -> Column:
    return F.replace(F.lower(clean(name)), F.lit("ß"), F.lit("ss"))


def rules_for(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Each record (key, programme, admission_year) with the rules of its programme, by name or alias, and year; a range is open where it has no limit."""
    named = rules.withColumn("alias", F.explode(F.array_distinct(F.transform(F.concat(F.array("programme"), F.coalesce("programme_aliases", F.array().cast("array<string>"))), programme_key))))
    asked = records.select("key", programme_key(F.col("programme")).alias("alias"), "admission_year")
    within = F.col("admission_year").between(F.coalesce("admission_year_start", F.lit(0)), F.coalesce("admission_year_end", F.lit(9999)))
    return asked.join(named, "alias").where(within).drop("alias")


def check_requirements(courses: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, groups) for transcripts with their rules.

    courses: key, ordinal, course_code, credits, status; the last record of a code counts, once. applied: key and the columns of RULES_SCHEMA.
    report: key, overall_status, earned, required, remaining, missing_required_courses, manual_review_items.
    groups: key, position, id, name, required_credits, completed_courses, in_progress_courses, missing_courses, completed_count, required_count, minimum_courses.
    """
    own = courses.withColumn("code", normalize_code(F.col("course_code")))
    passed = own.where(F.col("status").isin(*COUNTED)).groupBy("key", "code").agg(F.max_by("credits", "ordinal").alias("credits"))
    waiting = own.where("status = 'in_progress'").select("key", "code").distinct()
    earned = passed.groupBy("key").agg(F.sum(F.coalesce("credits", F.lit(0.0))).alias("earned"))
    flat = applied.select("key", F.posexplode(F.coalesce("requirement_groups", F.array().cast(f"array<{GROUP}>"))).alias("position", "g"))
    wanted = flat.select("key", "position", "g", F.posexplode_outer("g.courses").alias("at", "course")).withColumn("code", normalize_code(F.col("course")))
    state = wanted.join(passed.select("key", "code", F.lit(True).alias("done")), ["key", "code"], "left").join(waiting.withColumn("now", F.lit(True)), ["key", "code"], "left")
    done, now = F.col("done").isNotNull(), F.col("now").isNotNull()
    real = F.col("code").isNotNull()
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(real & c, F.struct("at", "code")))), lambda x: x.code)
    groups = state.groupBy("key", "position").agg(
        F.first("g").alias("g"), listed(done).alias("completed_courses"), listed(now).alias("in_progress_courses"), listed(~done & ~now).alias("missing_courses"), F.count("code").alias("required_count")
    )
    kind, n = F.coalesce("g.type", F.lit("all_of")), F.size("completed_courses")
    short = F.coalesce("g.minimum_courses", F.lit(0)) - n
    needed = (
        F.when(kind == "all_of", F.col("missing_courses"))
        .when((kind == "one_of") & (n == 0), F.col("missing_courses"))
        .when((kind == "choose_n") & (short > 0), F.slice("missing_courses", F.lit(1), F.greatest(short, F.lit(0))))
        .otherwise(F.array().cast("array<string>"))
    )
    groups = groups.withColumn("needed", needed)
    missing = groups.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("needed")))).alias("missing"))
    report = applied.join(earned, "key", "left").join(missing, "key", "left")
    total, have = F.coalesce("minimum_total_credits", F.lit(0.0)), F.coalesce("earned", F.lit(0.0))
    gone = F.coalesce("missing", F.array().cast("array<string>"))
    remaining = F.greatest(F.lit(0.0), total - have)
    report = report.select(
        "key", F.when((F.size(gone) == 0) & (remaining == 0), "satisfied_for_computable_rules").otherwise("partially_satisfied").alias("overall_status"),
        have.alias("earned"), total.alias("required"), remaining.alias("remaining"), gone.alias("missing_required_courses"), F.coalesce("manual_review_rules", F.array().cast("array<string>")).alias("manual_review_items"),
    )
    shown = groups.select(
        "key", "position", F.col("g.id").alias("id"), F.coalesce("g.name", "g.id").alias("name"), F.col("g.required_credits").alias("required_credits"), "completed_courses", "in_progress_courses", "missing_courses",
        n.alias("completed_count"), "required_count", F.col("g.minimum_courses").alias("minimum_courses"),
    )
    return report, shown
