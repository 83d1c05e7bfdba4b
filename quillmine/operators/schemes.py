"""The crawl for the one document of each listing page that is valid for a year, over fetched contents, and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.functions.text import safe_filename
from quillmine.operators.crawling import host_of
from quillmine.operators.html import listings
from quillmine.operators.versions import choose_document, crawl_status
from quillmine.sources.files import write_json
from quillmine.sources.tables import persist

#: Manifest: one row a listing page.
MANIFEST = ["major", "page_url", "status", "title", "pdf_url", "path", "error"]
NOT_FETCHED, FOREIGN, NO_PDF = "not fetched", "outside the site", "not a PDF"


def scheme_manifest(index: DataFrame, pages: DataFrame, contents: DataFrame, year: int, folder: str, on_disk: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """`MANIFEST` rows and content (what is to be stored, of downloaded ones) for the listing pages that an index links.

    index, pages: url, html; contents: url, content (bytes); on_disk: path. A page or file that wasn't fetched, is of another host than the
    index, or isn't a PDF fails alone, with its label, address and error only. Raises if the index has no links, as its form must have changed.
    """
    majors = listings(index).select(host_of(F.col("url")).alias("host"), F.posexplode("majors").alias("at", "m")).select("host", "at", "m.label", F.col("m.url").alias("page_url"))
    majors = persist(majors.dropDuplicates(["page_url"]), "majors")
    if majors.isEmpty():
        raise ValueError("the index has no links to listing pages")
    found = listings(pages.join(majors.select(F.col("page_url").alias("url")).distinct(), "url", "left_semi")).withColumn("fetched", F.lit(True))
    listed = majors.join(found.select(F.col("url").alias("page_url"), F.col("title").alias("page_title"), "documents", "fetched"), "page_url", "left")
    documents = listed.select("page_url", F.posexplode("documents").alias("ordinal", "d")).select("page_url", "ordinal", "d.title", "d.url")
    chosen = choose_document(documents, F.lit(year), ["page_url"]).select("page_url", "title", F.col("url").alias("pdf_url"))
    rows = listed.join(chosen, "page_url", "left").withColumn("path", F.when(F.col("title").isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), safe_filename(F.col("title")))))
    there = F.lit(False)
    if on_disk is not None:
        rows = rows.join(on_disk.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
        there = F.coalesce("there", F.lit(False))
    rows = rows.join(contents.select(F.col("url").alias("pdf_url"), "content"), "pdf_url", "left")
    status = crawl_status(F.col("title"), there, dry_run, F.col("content"))
    foreign = (host_of(F.col("page_url")) != F.col("host")) | (host_of(F.col("pdf_url")) != F.col("host"))
    error = (
        F.when(host_of(F.col("page_url")) != F.col("host"), FOREIGN)
        .when(F.col("fetched").isNull(), NOT_FETCHED)
        .when(F.lit(not dry_run) & (status != "skipped") & F.coalesce(foreign, F.lit(False)), FOREIGN)
        .when((status == "failed") | ((status == "downloaded") & F.col("content").isNull()), F.when(F.col("content").isNull(), NOT_FETCHED).otherwise(NO_PDF))
    )
    out = rows.withColumn("error", error).withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(status))
    good = F.col("error").isNull()
    major = F.when(good & (F.coalesce("page_title", F.lit("")) != ""), F.col("page_title")).otherwise(F.col("label"))
    kept = lambda c: F.when(good & (F.col("status") != "not_found"), F.col(c)).alias(c)
    return out.select("at", major.alias("major"), "page_url", "status", kept("title"), kept("pdf_url"), kept("path"), "error", F.when(F.col("status") == "downloaded", F.col("content")).alias("content"))


def crawl_schemes(spark: SparkSession, index: DataFrame, pages: DataFrame, contents: DataFrame, year: int, folder: str, dry_run: bool = False) -> tuple[DataFrame, int]:
    """Runs the crawl, adds downloaded files (path, content) to `<folder>/files`, writes `<folder>/manifest`, and returns the manifest and the number of failures."""
    held = f"{folder.rstrip('/')}/files"
    place = spark._jvm.org.apache.hadoop.fs.Path(held)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    on_disk = spark.read.parquet(held) if there else None
    rows = persist(scheme_manifest(index, pages, contents, year, folder, on_disk, dry_run), "schemes")
    if not dry_run:
        rows.where("status = 'downloaded'").select("path", "content").write.mode("append").parquet(held)
    manifest = rows.orderBy("at").select(*MANIFEST)
    write_json(manifest, f"{folder.rstrip('/')}/manifest")
    return manifest, rows.where("status = 'failed'").count()
