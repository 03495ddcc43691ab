"""A crawl over captured responses: the frontier is a DataFrame, a level is a join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import url
from siteatlas.operators.extract import extract_links, first_of, link_key, with_resolved
from siteatlas.rules import CLI_RULES, Rules
from siteatlas.sources.tables import written


@dataclass(frozen=True)
class CrawlOptions:
    max_depth: int = 3
    request_limit: int = 0
    all_domains: bool = False
    follow: list[str] = field(default_factory=list)
    show: set[str] = field(default_factory=set)


def fetched(frontier: DataFrame, responses: DataFrame, left: int | None = None) -> DataFrame:
    """The responses to the URLs of a level, written; ``left``: no more than so many, by URL."""
    got = frontier.join(responses, "url")
    if left is not None:
        got = got.orderBy("url").limit(max(left, 0))
    return written(got.select("url", "content_type", F.col("body").cast("string").alias("body")), "responses")


def found_on(level: DataFrame, depth: int, rules: Rules) -> DataFrame:
    """The links on the pages of a level."""
    return with_resolved(extract_links(level, rules)).withColumn("depth", F.lit(depth + 1))


def logged(level: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """(url, depth, content_type, links) of the pages of a level."""
    counts = found.groupBy(F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("links"))
    return level.select("url", "content_type").join(counts, "url", "left").select(
        "url", F.lit(depth).alias("depth"), "content_type", F.coalesce("links", F.lit(0)).alias("links")
    )


def to_fetch(found: DataFrame, start: str, options: CrawlOptions) -> DataFrame:
    """The distinct URLs in scope that links lead to, fetched before or not."""
    hidden = [c for c in ("WAF", "CDN", "cache", "noise") if c not in options.show]
    queue = found.where(F.col("category").isin("web-page", "API") & ~F.col("class").isin(hidden))
    queue = queue.select(url.cut_at(link_key(), "#").alias("url")).distinct()
    if options.all_domains:
        return queue
    return queue.where(url.host_in(url.host(F.col("url")), [*options.follow, start_host(start)]))


def distinct_links(every: DataFrame, responses: DataFrame) -> DataFrame:
    """Links of all levels, the first of each href; a JSON answer makes the links to it API links."""
    once = first_of(every, ["href"], ["depth", "source_url", "rank", "pos"])
    json = responses.where(F.lower(F.col("content_type")).contains("json")).select(F.col("url").alias("resolved")).distinct()
    once = once.join(json.withColumn("json", F.lit(True)), "resolved", "left")
    return once.withColumn("category", F.when(F.col("json"), "API").otherwise(F.col("category"))).drop("json")


def crawl(responses: DataFrame, start: str, options: CrawlOptions = CrawlOptions(), rules: Rules = CLI_RULES) -> dict[str, DataFrame]:
    """Links and pages that a breadth-first crawl from ``start`` finds.

    ``responses``: url, status, content_type, body.  A level joins its URLs
    with the responses, extracts links, and queues those in scope that were
    not fetched before.  Levels are written, so a lost executor costs one
    level's unfinished tasks; :class:`siteatlas.operators.resume.StoredCrawl`
    keeps them, to stop and go on.
    """
    frontier = responses.sparkSession.createDataFrame([(start,)], "url string")
    visited = written(frontier, "visited")
    links, pages, n_fetched = [], [], 0
    for depth in range(options.max_depth + 1):
        level = fetched(frontier, responses, options.request_limit - n_fetched if options.request_limit else None)
        n = level.count()
        if not n:
            break
        n_fetched += n
        found = written(found_on(level, depth, rules), "links")
        pages.append(logged(level, found, depth))
        links.append(found)
        frontier = written(to_fetch(found, start, options).join(visited, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    if not links:
        return {}
    return {"links": distinct_links(union(links), responses), "pages": union(pages)}


def start_host(start: str) -> str:
    from urllib.parse import urlsplit

    return (urlsplit(start).hostname or "").lower()


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
