"""Files in and out: documents, web pages, configuration, labelled cases, catalogues and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.functions.text import normalize_text
from quillmine.operators.crawling import WebSource

#: (page number, text) of a file's pages; raises for a file that can't be read.
Extractor = Callable[[bytes], Iterator[tuple[int, str]]]
CASE_SCHEMA = "question string, reference_answer string, relevant_document string, relevant_pages array<int>, should_refuse boolean"
CATALOGUE_SCHEMA = "course_code string, source_document string, page string, excerpt string"


def scan_documents(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """path, document (file name), content, modified_at and sha256 of all files under path with the suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(suffix))
    modified = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return files.select("path", F.substring_index("path", "/", -1).alias("document"), "content", modified.alias("modified_at"), F.sha2("content", 256).alias("sha256"))


def pypdf_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """Pages of a PDF where the library is installed."""
    import io

    from pypdf import PdfReader

    for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        yield number, page.extract_text() or ""


def pypdf_layout(content: bytes) -> Iterator[tuple[int, str]]:
    """Pages with their layout kept, or plain where a page has none."""
    import io

    from pypdf import PdfReader

    from quillmine.functions.text import normalized

    for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        try:
            yield number, page.extract_text(extraction_mode="layout") or ""
        except (TypeError, ValueError):
            yield number, normalized(page.extract_text() or "")


def extract_pages(files: DataFrame, extractor: Extractor = pypdf_pages) -> DataFrame:
    """path, document, modified_at, sha256, page, text, error: a row a page; a file that fails gives one row with its error."""
    keep = ["path", "document", "modified_at", "sha256"]

    def run(batches):
        for batch in batches:
            rows = []
            for *own, content in batch[[*keep, "content"]].itertuples(index=False):
                try:
                    rows += [(*own, number, text, None) for number, text in extractor(bytes(content))]
                except Exception as failure:  # one bad file doesn't end the scan
                    rows.append((*own, None, None, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=[*keep, "page", "text", "error"]).astype({"page": "Int32"})

    return files.select(*keep, "content").mapInPandas(run, "path string, document string, modified_at string, sha256 string, page int, text string, error string")


def parse_pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, warnings): normalised pages, without empty ones and without pages that repeat an earlier one of their file."""
    text = raw.withColumn("text", normalize_text(F.coalesce("text", F.lit(""))))
    same = Window.partitionBy("path", F.sha2("text", 256)).orderBy("page")
    marked = text.withColumn("n", F.row_number().over(same))
    empty, again = F.col("text") == "", F.col("n") > 1
    label = F.concat(F.col("document"), F.lit(" 第 "), F.col("page").cast("string"), F.lit(" 页"))
    what = F.when(F.col("error").isNotNull(), F.concat("document", F.lit(" 索引失败: "), "error")).when(empty, F.concat(label, F.lit("无可提取文本，可能是空白页或扫描页"))).when(again, F.concat(label, F.lit("与前页内容重复，已跳过")))
    marked = marked.withColumn("warning", what)
    pages = marked.where("warning is null").select("text", "document", F.col("path").alias("source_path"), "page", "modified_at", "sha256")
    return pages, marked.where("warning is not null").select("path", "page", "warning")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions, a JSON object a line; empty lines don't count."""
    return spark.read.schema(CASE_SCHEMA).option("mode", "FAILFAST").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A JSON table, or an empty one if it is missing or not JSON."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], schema)
        raise


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_web_sources(spark: SparkSession, path: str) -> list[WebSource]:
    """Crawl sources of a configuration file; each needs a name, start addresses and domains."""
    one = "name string, department string, start_urls array<string>, allowed_domains array<string>, allowed_paths array<string>, max_pages int, max_depth int, delay double"
    rows = spark.read.schema(f"sources array<struct<{one.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    out = []
    for r in rows.select(F.inline("sources")).collect():  # a configuration file
        urls = tuple(u.strip() for u in r.start_urls or () if u and u.strip())
        domains = tuple(d.strip().lower() for d in r.allowed_domains or () if d and d.strip())
        if not (r.name and urls and domains):
            raise ValueError("a web source needs name, start_urls and allowed_domains")
        default = lambda v, d: d if v is None else v
        out.append(WebSource(r.name, urls, domains, tuple(r.allowed_paths or ()) or ("/",), r.department or "", max(1, default(r.max_pages, 50)), max(0, default(r.max_depth, 2)), max(0.0, default(r.delay, 0.5))))
    return out


#: Uploads: the largest size and the first bytes.
MOST_UPLOAD_BYTES = 10 << 20


def upload_status(uploads: DataFrame) -> DataFrame:
    """uploads (name, content) with the status that a service would answer: 200, 415 for another kind of file, 413 for one that is too large, 422 for one without the right first bytes."""
    status = (
        F.when(~F.coalesce(F.endswith(F.lower("name"), F.lit(".pdf")), F.lit(False)), 415)
        .when(F.octet_length("content") > MOST_UPLOAD_BYTES, 413)
        .when(~F.coalesce(F.startswith("content", F.lit(b"%PDF")), F.lit(False)), 422)
        .otherwise(200)
    )
    return uploads.withColumn("status", status)
