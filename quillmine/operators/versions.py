"""Versions of a document: the one that is valid for a year, questions that need a version named, and the version that an answer uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.functions import fixed
from quillmine.functions.text import clean, detect_language

_ONE = r"(20\d{2})\s*(?:至|-)\s*(?:20)?\d{2}"
#: Words for "and later".
LATER = ("及以后", "或以后", "之后", "thereafter")
INEXACT = ("及以后", "或以后")


def applies_to_year(title: Column, year: Column) -> Column:
    """A range of years that spans it, a start that equals it, or an open range whose last start is not after it."""
    form = F.lower(clean(title))
    span = rf"(?U){_ONE}\s*年度?\s*(?:至|to)\s*{_ONE}"
    low, high = (F.regexp_extract(form, span, k).try_cast("int") for k in (1, 2))
    starts = F.transform(F.regexp_extract_all(form, F.lit(f"(?U){_ONE}"), F.lit(1)), lambda s: s.cast("int"))
    later = F.lit(False)
    for word in LATER:
        later = later | F.contains(form, F.lit(word))
    open_end = F.when(F.size(starts) > 0, later & (year >= F.try_element_at(starts, F.lit(-1)))).otherwise(F.lit(False))
    return F.coalesce(year.between(low, high), F.lit(False)) | F.array_contains(starts, year) | open_end


def choose_document(documents: DataFrame, year: Column, by: list[str]) -> DataFrame:
    """Of each group's documents (ordinal, title, url) valid for the year the last one, one with exact years before one that is open."""
    valid = documents.where(applies_to_year(F.col("title"), year))
    exact = ~(F.contains("title", F.lit(INEXACT[0])) | F.contains("title", F.lit(INEXACT[1])))
    return valid.groupBy(*by).agg(F.max_by(F.struct("title", "url", "ordinal"), F.struct(exact, F.col("ordinal"))).alias("chosen")).select(*by, "chosen.*")


def crawl_status(chosen_title: Column, on_disk: Column, dry_run: bool = False, content: Column | None = None) -> Column:
    """What becomes of a listing page: not_found, selected, skipped, failed or downloaded."""
    fetched = F.lit("downloaded")
    if content is not None:
        fetched = F.when(F.startswith(content.cast("binary"), F.lit(b"%PDF")), "downloaded").otherwise("failed")
    kept = F.lit("selected") if dry_run else F.when(on_disk, "skipped").otherwise(fetched)
    return F.when(chosen_title.isNull(), "not_found").otherwise(kept)


def scheme_of(document: Column) -> tuple[Column, Column]:
    """Programme and version label of a document's name; empty if it has none."""
    return F.regexp_extract(document, fixed.APPLICABILITY_PATTERN, 1), F.regexp_extract(document, fixed.APPLICABILITY_PATTERN, 2)


def names_a_year(question: Column) -> Column:
    return question.rlike(f"(?U){fixed.YEAR_PATTERN}")


def option(label: Column, language: Column) -> Column:
    english = label
    for a, b in (("至", "–"), ("、", ", "), ("年度及以后入学学生", " academic year and later entrants"), ("年度入学学生", " academic year entrants"), ("及", " and ")):
        english = F.replace(english, F.lit(a), F.lit(b))
    return F.when(language == "zh", F.concat(F.lit("适用于"), label)).otherwise(F.concat(F.lit("For "), english))


def _versioned(evidence: DataFrame) -> DataFrame:
    programme, label = scheme_of(F.col("document"))
    return evidence.withColumn("programme", programme).withColumn("label", label).withColumn("versioned", F.col("programme") != "")


def clarifications(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, programme, message, options: the programme with most versions in the evidence (the first of equals) of each question that names no year."""
    asked = questions.select("qid", F.col("text").alias("question")).where(~names_a_year(F.col("question")))
    seen = _versioned(evidence).where("versioned").join(asked, "qid")
    found = seen.groupBy("qid", "question", "programme").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.min("rank").alias("first")).where("size(labels) > 1")
    best = Window.partitionBy("qid").orderBy(F.size("labels").desc(), "first")
    found = found.withColumn("n", F.row_number().over(best)).where("n = 1")
    language = detect_language(F.col("question"))
    message = F.when(
        language == "en",
        F.concat(F.lit("I found more than one version of the "), "programme", F.lit(" study scheme. Which entry-year version would you like me to use?")),
    ).otherwise(F.concat(F.lit("我找到了多个版本的"), "programme", F.lit("培养方案。为了不把不同年份的要求混在一起，你想看哪一版？")))
    return found.select("qid", "programme", message.alias("message"), F.transform("labels", lambda x: option(x, language)).alias("options"))


def answer_scope(questions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, scopes): evidence without the versions that the answer doesn't use; qid, document, notice and options of each question with a scope.

    The first versioned item of a question that names no year sets the version.
    """
    asked = questions.select("qid", F.col("text").alias("question"))
    seen = _versioned(evidence).join(asked, "qid").withColumn("versioned", F.col("versioned") & ~names_a_year(F.col("question")))
    own = Window.partitionBy("qid")
    ranked = own.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chosen = F.first(F.when(F.col("versioned"), F.struct("document", "programme", "label")), ignorenulls=True).over(ranked)
    seen = seen.withColumn("chosen", chosen)
    kept = seen.where(~F.col("versioned") | (F.col("document") == F.col("chosen.document"))).select(*evidence.columns)
    others = F.collect_set(F.when(F.col("versioned") & (F.col("programme") == F.col("chosen.programme")) & (F.col("label") != F.col("chosen.label")), F.col("label")))
    scopes = seen.where("chosen is not null").groupBy("qid", "question", "chosen").agg(F.array_sort(others).alias("labels"))
    language = detect_language(F.col("question"))
    options = F.transform("labels", lambda x: option(x, language))
    shown = F.regexp_replace(option(F.col("chosen.label"), F.lit("en")), r"\AFor ", "")
    more = F.size("labels") > 0
    english = F.concat(F.lit("This answer uses the "), "chosen.programme", F.lit(" study scheme for "), shown, F.lit("."), F.when(more, " Requirements may differ for other entry years; you can switch versions below.").otherwise(""))
    chinese = F.concat(F.lit("目前按适用于"), "chosen.label", F.lit("的"), "chosen.programme", F.lit("培养方案回答。"), F.when(more, "其他入学年份的要求可能不同，你也可以切换版本继续查看。").otherwise(""))
    return kept, scopes.select("qid", F.col("chosen.document").alias("document"), F.when(language == "en", english).otherwise(chinese).alias("notice"), options.alias("options"))
