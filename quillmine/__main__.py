"""python -m quillmine ingest | ingest-web | crawl | schemes | evaluate: batch jobs for spark-submit or a local session."""

from __future__ import annotations

import argparse
import json
import sys
from hashlib import sha256

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmine.functions.config import Settings
from quillmine.functions.logs import configure
from quillmine.operators import crawling, evaluation, html, indexing, records, schemes
from quillmine.sources import files
from quillmine.sources.tables import persist


def ingest(spark: SparkSession, source: str, index: str, settings: Settings) -> int:
    """Index the documents under a folder and write the course catalogue beside the index; 1 if a document failed."""
    pages, warnings = files.parse_pages(files.extract_pages(files.scan_documents(spark, source)))
    pages = persist(pages, "pages")
    report = indexing.ChunkIndex(spark, index, settings).update_documents(pages)
    files.write_json(records.course_catalogue(pages), f"{index}/course_catalog")
    broken = warnings.where("page is null").count()
    print(json.dumps(vars(report) | {"unreadable": broken}))
    return int(report.failed + broken > 0)


def ingest_web(spark: SparkSession, pages: str, index: str, settings: Settings, name: str) -> int:
    """Index a table of fetched pages (url, html)."""
    kept, short = html.long_enough(html.extract_pages(spark.read.parquet(pages), name))
    report = indexing.ChunkIndex(spark, index, settings).update_pages(kept)
    print(json.dumps(vars(report) | {"short": short.count()}))
    return 0


def crawl(spark: SparkSession, sources: str, pages: str, log: str) -> int:
    """Crawl every source of a configuration file over a table of fetched pages (url, html, allowed, content_type); a crawl that was cut short goes on."""
    rows = spark.read.parquet(pages)
    chars = F.coalesce(html.body_chars(), F.lit(0))
    extracted = html.extract_pages(rows).select("url", chars.alias("chars"))
    known = rows.select("url", "allowed", "content_type").join(extracted, "url").select("url", "allowed", crawling.html_chars(F.col("content_type"), F.col("chars")).alias("body_chars"))
    known, links = persist(known, "known"), persist(html.page_links(rows), "links")
    for source in files.read_web_sources(spark, sources):
        start = spark.createDataFrame(list(enumerate(source.start_urls)), "pos long, url string")
        found = crawling.CrawlLog(spark, f"{log}/{sha256(source.name.encode()).hexdigest()[:16]}", source).run(start, known, links, source.max_pages)
        print(json.dumps({"source": source.name} | {r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()}, ensure_ascii=False))
    return 0


def fetch_schemes(spark: SparkSession, index: str, pages: str, contents: str, output: str, year: int, dry_run: bool) -> int:
    """Write the manifest of the documents valid for a year, and the files themselves unless dry_run; 1 if one failed."""
    manifest, failed = schemes.crawl_schemes(spark, spark.read.parquet(index), spark.read.parquet(pages), spark.read.parquet(contents), year, output, dry_run)
    for r in manifest.toLocalIterator():
        print(json.dumps(r.asDict(), ensure_ascii=False))
    return int(failed > 0)


def evaluate(spark: SparkSession, dataset: str, corpus: str, threshold: float) -> int:
    cases = files.read_cases(spark, dataset).withColumn("qid", F.xxhash64("question"))
    rows = spark.read.schema("document string, page int, text string").option("multiLine", True).json(corpus).withColumn("ordinal", F.monotonically_increasing_id())
    print(json.dumps(evaluation.evaluate(cases, persist(rows, "corpus"), threshold).first().asDict()))
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmine", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for job, names in (("ingest", ("source", "index")), ("ingest-web", ("pages", "index")), ("crawl", ("sources", "pages", "log")), ("schemes", ("index", "pages", "contents", "output")), ("evaluate", ("dataset", "corpus"))):
        own = jobs.add_parser(job)
        for n in names:
            own.add_argument(f"--{n}", required=True)
    jobs.choices["ingest-web"].add_argument("--name", default="")
    jobs.choices["schemes"].add_argument("--year", type=int, default=2023)
    jobs.choices["schemes"].add_argument("--dry-run", action="store_true")
    jobs.choices["evaluate"].add_argument("--threshold", type=float, default=0.35)
    asked = parser.parse_args(arguments)
    settings = Settings.from_env()
    configure(settings.log_level)
    spark = SparkSession.builder.appName("quillmine").getOrCreate()
    if asked.job == "ingest":
        return ingest(spark, asked.source, asked.index, settings)
    if asked.job == "ingest-web":
        return ingest_web(spark, asked.pages, asked.index, settings, asked.name)
    if asked.job == "crawl":
        return crawl(spark, asked.sources, asked.pages, asked.log)
    if asked.job == "schemes":
        return fetch_schemes(spark, asked.index, asked.pages, asked.contents, asked.output, asked.year, asked.dry_run)
    return evaluate(spark, asked.dataset, asked.corpus, asked.threshold)


if __name__ == "__main__":
    sys.exit(main())
