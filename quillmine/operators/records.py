"""Transcripts and course catalogues out of page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.functions import fixed
from quillmine.functions.text import SPACE, normalize_code, strip

#: How codes, grades, rows and labels look.
CODE = r"[A-Z]{2,4}\s*[- ]?\s*\d{4}[A-Z]?"
GRADE = r"A\+|A-|A|B\+|B-|B|C\+|C-|C|D\+|D-|D|PA|DI|IP|WD|W|P|F|U"
ROW = rf"(?iuU)^\s*({CODE})\s+(.+?)\s+(\d+(?:\.\d+)?)\s+({GRADE})\s+(N/?A|\d+(?:\.\d+)?)\s*$"
START = rf"(?iuU)^\s*({CODE})\b"
TERM = r"(?iuU)^\s*(20\d{2}[-–—]\d{2})\s+Term\s+([12])\s*$"
PROGRAMME = r"(?imduU)^\s*(?:Major\s*/\s*Programme|Programme|Major|专业)\s*[:：]\s*(.+?)\s*$"
ADMISSION = r"(?imduU)^\s*(?:Admitted\s+in|Admission\s+Year|Entry\s+Year|入学年份|入学年度)\s*[:：]\s*(?:[A-Za-z]+\s+)?(20\d{2})\s*$"
TOTAL = r"(?iuU)(?:Cumulative\s+Units\s+Passed|累计已获学分)\s*=\s*(\d+(?:\.\d+)?)"
HEADER_LABELS = ("course code", "course title", "units", "grade")
TABLE_ENDS = ("units passed", "cumulative units passed", "honour(s)/award(s)", "summary", "remarks", "invalid unless", "end of transcript", "*")
LINE_ENDS = "[\n\x0b\x0c\x1c\x1d\x1e\x85  ]"
CATALOGUE_CODE = r"(?U)\b([A-Z]{2,4}\d{4}[A-Z]?)\b"
CONFIDENCE = 0.98
NO_COURSES = "未识别到课程记录，请确认 PDF 是电子成绩单或改用 OCR"


def grade_status(grade: Column) -> Column:
    value = F.upper(strip(grade))
    out = F.lit("unknown")
    for status, grades in fixed.GRADE_STATUS.items():
        out = F.when(value.isin(*grades), status).otherwise(out)
    return F.when(F.coalesce(F.length(grade), F.lit(0)) == 0, "unknown").otherwise(out)


def is_header(line: Column) -> Column:
    found = F.lit(True)
    for label in HEADER_LABELS:
        found = found & F.contains(F.lower(line), F.lit(label))
    return found


def is_table_end(line: Column) -> Column:
    found = F.lit(False)
    for label in TABLE_ENDS:
        found = found | F.startswith(F.lower(line), F.lit(label))
    return found


def _lines(pages: DataFrame) -> DataFrame:
    """key, page, at, raw and line of each line that isn't blank."""
    text = F.regexp_replace(F.regexp_replace("text", "\\x00", " "), "\r\n|\r", "\n")
    cut = pages.select("key", "page", F.posexplode(F.split(text, LINE_ENDS)).alias("at", "raw"))
    return cut.withColumn("line", strip(F.regexp_replace("raw", "[ \t]+", " "))).where("line <> ''")


def parse_transcripts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(courses, records) of transcripts given as pages (key, page, text).

    courses: key, ordinal, course_code, course_name, credits, grade, term, status, source_page, confidence.
    records: key, programme, admission_year, total_credits_reported, warnings. Terms and tables end with their page.
    """
    pages = pages.select("key", "page", F.coalesce("text", F.lit("")).alias("text"))
    lines = _lines(pages)
    term, header, end = F.col("line").rlike(TERM), is_header(F.col("line")), is_table_end(F.col("line"))
    name = F.concat(F.regexp_replace(F.regexp_extract("line", TERM, 1), "[–—]", "-"), F.lit(" Term "), F.regexp_extract("line", TERM, 2))
    indent = F.length("raw") - F.length(F.regexp_replace("raw", rf"(?U)\A{SPACE}+", ""))
    lines = lines.withColumns(
        {
            "control": F.when(term, 0).when(header, 1).when(end, 0),
            "term_name": F.when(term, name),
            "is_row": F.col("line").rlike(ROW),
            "is_start": F.col("line").rlike(START),
            "may_continue": (indent >= 4) & ~F.contains("line", F.lit("=")),
        }
    )
    so_far = Window.partitionBy("key", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("inside", F.col("control").isNull() & F.coalesce(F.last("control", ignorenulls=True).over(so_far) == 1, F.lit(False)))
    row, start = F.col("inside") & F.col("is_row"), F.col("inside") & ~F.col("is_row") & F.col("is_start")
    owner = F.when(row, F.col("at")).when(F.col("control").isNotNull() | start, -1)
    lines = lines.withColumns({"row": row, "broken": start, "owner": F.last(owner, ignorenulls=True).over(so_far), "term": F.last("term_name", ignorenulls=True).over(so_far)})
    more = lines.where("inside and not row and not broken and may_continue and owner >= 0")
    tails = more.groupBy("key", "page", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line).alias("tail")).withColumnRenamed("owner", "at")
    found = lines.where("row").join(tails, ["key", "page", "at"], "left")
    part = lambda k: F.regexp_extract("line", ROW, k)
    title = F.aggregate(
        F.coalesce("tail", F.array().cast("array<string>")),
        strip(part(2)),
        lambda a, x: strip(F.concat(a, F.when(a.rlike("[-–—]$"), "").otherwise(" "), x)),
    )
    order = Window.partitionBy("key").orderBy("page", "at")
    grade = F.upper(part(4))
    courses = found.select(
        "key", F.row_number().over(order).alias("ordinal"), normalize_code(part(1)).alias("course_code"), title.alias("course_name"), part(3).cast("double").alias("credits"),
        grade.alias("grade"), "term", grade_status(grade).alias("status"), F.col("page").alias("source_page"), F.lit(CONFIDENCE).alias("confidence"),
    )
    broken = F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页课程 "), normalize_code(F.regexp_extract("line", START, 1)), F.lit(" 字段不完整，已跳过"))
    warnings = lines.where("broken").select("key", "page", "at", broken.alias("warning")).unionByName(blank_page_warnings(pages))
    listed = warnings.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "at", "warning"))), lambda x: x.warning).alias("warnings"))
    first = lambda pattern: F.min(F.when(F.regexp_extract("text", pattern, 1) != "", F.struct("page", F.regexp_extract("text", pattern, 1).alias("value"))))
    totals = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(TOTAL), F.lit(1)), lambda x: x.cast("double")))
    unix = pages.withColumn("text", F.regexp_replace(F.regexp_replace("text", "\\x00", " "), "\r\n|\r", "\n"))
    heads = unix.groupBy("key").agg(first(PROGRAMME).alias("programme"), first(ADMISSION).alias("year"), F.max(totals).alias("total_credits_reported"))
    counts = courses.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = heads.join(listed, "key", "left").join(counts, "key", "left")
    none = F.when(F.col("n").isNull(), F.array(F.lit(NO_COURSES))).otherwise(F.array().cast("array<string>"))
    records = joined.select(
        "key", strip(F.col("programme.value")).alias("programme"), F.col("year.value").cast("int").alias("admission_year"), "total_credits_reported",
        F.concat(F.coalesce("warnings", F.array().cast("array<string>")), none).alias("warnings"),
    )
    return courses, records


def blank_page_warnings(pages: DataFrame) -> DataFrame:
    """Blank pages up to a document's last page with text, or all of them if none has any."""
    blank = strip(F.regexp_replace("text", "\\x00", " ")) == ""
    last = F.max(F.when(strip(F.col("text")) != "", F.col("page"))).over(Window.partitionBy("key"))
    told = pages.withColumn("blank", blank).withColumn("last", last).where("blank and (last is null or page <= last)")
    return told.select("key", "page", F.lit(-1).alias("at"), F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页没有文本，可能需要 OCR")).alias("warning"))


def course_catalogue(pages: DataFrame) -> DataFrame:
    """course_code, source_document, page (text), excerpt: the courses of study-scheme pages (document, source_path, page, text).

    A code counts on a page that has the words "course code", or after a Roman numeral in the forty characters before it. Its
    excerpt runs to the next code, 220 characters at most. Of equal excerpts the last page stays.
    """
    scheme = F.array_contains(F.split("source_path", r"[/\\]"), "study_schemes")
    rows = pages.where(scheme).select("document", "page", "text")
    # Odd elements of the split lie between codes: lookaround cuts keep the codes themselves.
    parts = F.split("text", r"(?U)(?=\b[A-Z]{2,4}\d{4}[A-Z]?\b)(?<!\w)")
    cut = rows.withColumn("parts", parts).select("document", "page", "text", "parts", F.posexplode("parts").alias("at", "part"))
    before = F.aggregate(F.slice("parts", 1, F.col("at")), F.lit(""), lambda a, x: F.substring(F.concat(a, x), -40, 40))
    cut = cut.withColumn("code", F.regexp_extract("part", rf"(?U)\A{CATALOGUE_CODE[4:]}", 1)).where("code <> ''")
    numeral = before.rlike(r"(?U)\b(?:I{1,3}|II|III|IV)\.")
    kept = cut.where(F.contains(F.lower("text"), F.lit("course code")) | numeral)
    tail = F.expr("substring(part, length(code) + 1, 220)")
    excerpt = F.regexp_replace(F.regexp_replace(F.concat("code", F.lit(" "), tail), f"(?U){SPACE}+", " "), r"\A[ ,;:]+|[ ,;:]+\z", "")
    found = kept.select(F.col("code").alias("course_code"), F.col("document").alias("source_document"), excerpt.alias("excerpt"), "page", "at")
    last = found.groupBy("course_code", "source_document", "excerpt").agg(F.max_by(F.col("page").cast("string"), F.struct("page", "at")).alias("page"))
    return last.select("course_code", "source_document", "page", "excerpt")


def transcript_summary(courses: DataFrame) -> DataFrame:
    """key, passed, in_progress and passed_credits."""
    passed = F.col("status") == "passed"
    return courses.groupBy("key").agg(F.count_if(passed).alias("passed"), F.count_if(F.col("status") == "in_progress").alias("in_progress"), F.coalesce(F.sum(F.when(passed, F.col("credits"))), F.lit(0.0)).alias("passed_credits"))
