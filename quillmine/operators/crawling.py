"""Which addresses may be read, and the pages that a crawl reaches over a table of links."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.functions import fixed
from quillmine.sources.commits import Change, CommitLog
from quillmine.sources.tables import numbered, persist


@dataclass(frozen=True)
class WebSource:
    name: str
    start_urls: tuple[str, ...]
    allowed_domains: tuple[str, ...]
    allowed_paths: tuple[str, ...] = ("/",)
    department: str = ""
    max_pages: int = 50
    max_depth: int = 2
    delay: float = 0.5


def without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    net = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(net, r"\A.*@", ""), r":[^\]]*\z", ""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*\z", "")


def is_allowed(url: Column, source: WebSource) -> Column:
    """Web schemes, hosts under an allowed domain, paths under an allowed prefix, no files of skipped kinds. Null is not allowed."""
    host, path = host_of(url), path_of(url)
    any_of = lambda parts: F.coalesce(*[F.lit(False)]) if not parts else parts[0] if len(parts) == 1 else parts[0] | any_of(parts[1:])
    domain = any_of([(host == d) | F.endswith(host, F.lit(f".{d}")) for d in source.allowed_domains])
    prefix = any_of([F.startswith(path, F.lit(p)) for p in source.allowed_paths])
    skipped = any_of([F.endswith(F.lower(path), F.lit(s)) for s in fixed.SKIPPED_SUFFIXES])
    return F.coalesce(url.rlike(r"(?i)\Ahttps?:") & domain & prefix & ~skipped, F.lit(False))


def robots_allow(url: Column, status: Column, rules: Column, agent: str = "*") -> Column:
    """The verdict of a robots file that was fetched with this status: rules if it was found, everything if it is missing, nothing if it failed."""

    @F.pandas_udf("boolean")
    def verdict(urls: pd.Series, found: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for u, text in zip(urls, found):
            if text not in parsed:
                parsed[text] = RobotFileParser()
                parsed[text].parse((text or "").splitlines())
            out.append(parsed[text].can_fetch(agent, u))
        return pd.Series(out)

    return F.when(status.between(200, 299), verdict(url, rules)).otherwise(F.coalesce(status.between(400, 499), F.lit(False)))


def crawl(source: WebSource, pages: DataFrame, links: DataFrame) -> DataFrame:
    """url, depth, place and outcome of every address that a breadth-first crawl visits, in order.

    pages: url, allowed (robots), body_chars (null: not HTML). links: src, pos, dst. A link is followed from pages that are
    kept. Addresses that robots deny count as visited. One join a level; the number of visits is limited by max_pages.
    """
    spark = pages.sparkSession
    start = spark.createDataFrame([(u, k, 0) for k, u in enumerate(source.start_urls)], "url string, parent int, pos int")
    frontier = start.withColumn("url", without_fragment(F.col("url")))
    visited = None
    count = 0
    for depth in range(source.max_depth + 1):
        fresh = frontier.where(is_allowed(F.col("url"), source)).groupBy("url").agg(F.min(F.struct("parent", "pos")).alias("first"))
        if visited is not None:
            fresh = fresh.join(visited.select("url"), "url", "left_anti")
        # At most max_pages rows are numbered, so the single window below is bounded.
        fresh = fresh.orderBy("first", "url").limit(source.max_pages - count)
        fresh = fresh.withColumn("place", F.row_number().over(Window.orderBy("first", "url")) + count)
        seen = fresh.join(pages, "url", "left")
        outcome = F.when(F.col("allowed").isNull(), "failed").when(~F.col("allowed"), "denied").when(F.col("body_chars").isNull(), "not_html").when(F.col("body_chars") < 40, "short").otherwise("kept")
        level = persist(seen.select("url", F.lit(depth).alias("depth"), "place", outcome.alias("outcome")), "crawl")
        visited = level if visited is None else visited.unionByName(level)
        count += level.count()
        if count >= source.max_pages or depth == source.max_depth:
            break
        kept = level.where("outcome = 'kept'").select(F.col("url").alias("src"), F.col("place").alias("parent"))
        frontier = links.join(kept, "src").select(without_fragment(F.col("dst")).alias("url"), "parent", "pos")
    return visited


SHORTEST_PAGE = 40
VISITED = "url string, depth int, place long, outcome string"


def outcome(allowed: Column, body_chars: Column) -> Column:
    """What becomes of a visited address. allowed: by robots, null without an answer; body_chars: null for what isn't HTML."""
    return F.when(allowed.isNull(), "failed").when(~allowed, "denied").when(body_chars.isNull(), "not_html").when(body_chars < SHORTEST_PAGE, "short").otherwise("kept")


def html_chars(content_type: Column, chars: Column) -> Column:
    """Characters of a page's body, null unless its content type is HTML."""
    return F.when(F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html")), chars)


class CrawlLog:
    """A breadth-first crawl of any size, level by level, each level one commit; a run that is cut short goes on with the level it was in.

    Visited addresses (url, depth, place, outcome) lie in hash buckets. A level joins the links of the pages that the last one kept, drops what
    was visited, and numbers the rest in the order of (place of the page, place of the link) by sorted ranges, so no task has a level. Only buckets with a new
    address are written. Unlike `crawl` it has no bound on pages unless `most` is given.
    """

    def __init__(self, spark, path: str, source: WebSource, buckets: int = 64):
        self.spark, self.source, self.log = spark, source, CommitLog(spark, path, {"visited": ["url"]}, buckets)

    def visited(self) -> DataFrame:
        found = self.log.read("visited")
        return self.spark.createDataFrame([], VISITED) if found is None else found

    def run(self, start: DataFrame, pages: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
        """Visit start (url, pos) and what is linked, to the source's depth. pages: url, allowed, body_chars; links: src, pos, dst. Returns all visited."""
        while self.step(start, pages, links, most):
            pass
        return self.visited()

    def step(self, start: DataFrame, pages: DataFrame, links: DataFrame, most: int | None = None) -> bool:
        """One level; whether there is another."""
        base = self.log.version()
        depth, count = base.values.get("depth", 0), base.values.get("count", 0)
        if base.values.get("done"):
            return False
        before = self.log.read("visited", base)
        if depth == 0 or before is None:
            frontier = start.select(without_fragment(F.col("url")).alias("url"), F.lit(0).cast("long").alias("parent"), F.col("pos").cast("long").alias("pos"))
        else:
            kept = before.where((F.col("depth") == depth - 1) & (F.col("outcome") == "kept")).select(F.col("url").alias("src"), F.col("place").alias("parent"))
            frontier = links.join(kept, "src").select(without_fragment(F.col("dst")).alias("url"), "parent", F.col("pos").cast("long").alias("pos"))
        fresh = frontier.where(is_allowed(F.col("url"), self.source)).groupBy("url").agg(F.min(F.struct("parent", "pos")).alias("first"))
        if before is not None:
            fresh = fresh.join(before.select("url"), "url", "left_anti")
        # Places are numbers of all visited ones from 1, as `crawl` gives them.
        placed = numbered(fresh, [F.col("first"), F.col("url")], count + 1, "crawl-level").withColumnRenamed("ordinal", "place")
        if most is not None:
            placed = placed.where(F.col("place") <= most)
        seen = placed.join(pages.select("url", "allowed", "body_chars").dropDuplicates(["url"]), "url", "left")
        level = persist(seen.select("url", F.lit(depth).alias("depth"), "place", outcome(F.col("allowed"), F.col("body_chars")).alias("outcome")), "crawl-visits")
        new = level.count()
        done = not new or depth >= self.source.max_depth or (most is not None and count + new >= most)
        self.log.commit({"visited": Change(added=level)} if new else {}, {"depth": depth + 1, "count": count + new, "done": done}, base)
        return not done
