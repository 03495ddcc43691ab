"""A crawl that can be stopped after any level and goes on later, in another session.

Its folder holds, for each level, the links and pages found and the frontier of
the next, and an index of all URLs queued so far.  The index is made of sorted
runs in buckets of the URL, with Parquet Bloom filters: a level's new URLs are
dealt to the buckets and merge-anti-joined with the runs where these lie, so
the URLs of earlier levels are never exchanged again, and a look-up of single
URLs skips most row groups.  Runs of one size are compacted ``fan`` at a time.

A level counts once its frontier is complete, which is written last; what a
stopped level left is written again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.operators.crawl import CrawlOptions, distinct_links, fetched, found_on, logged, to_fetch, union
from siteatlas.rules import CLI_RULES, Rules
from siteatlas.sources.tables import setting

IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass
class StoredCrawl:
    """The state of a crawl from ``start`` in ``folder``, which all machines share; ``options`` and ``rules`` are to stay the same."""

    spark: SparkSession
    folder: str
    start: str
    options: CrawlOptions = CrawlOptions()
    rules: Rules = field(default_factory=lambda: CLI_RULES)
    buckets: int = 64
    fan: int = 4

    def files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def done(self, name: str) -> bool:
        fs, path = self.files()
        return fs.exists(path(f"{self.folder}/{name}/_SUCCESS"))

    def names(self, name: str) -> list[str]:
        fs, path = self.files()
        at = path(f"{self.folder}/{name}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    @property
    def levels(self) -> int:
        """How many levels are complete."""
        n = 0
        while self.done(f"level-{n}/frontier"):
            n += 1
        return n

    def read(self, name: str, levels: int | None = None) -> DataFrame | None:
        tables = [self.spark.read.parquet(f"{self.folder}/level-{k}/{name}") for k in range(self.levels if levels is None else levels)]
        return union(tables) if tables else None

    # The index of queued URLs.

    def runs(self, below: int | None = None) -> list[tuple[int, int]]:
        """The complete runs (first level, last level) in use: those within no larger one; ``below``: of earlier levels only."""
        found = [tuple(map(int, n.split("-"))) for n in self.names("queued") if self.done(f"queued/{n}")]
        if below is not None:
            found = [(a, b) for a, b in found if b < below]
        return sorted((a, b) for a, b in found if not any((c, d) != (a, b) and c <= a and b <= d for c, d in found))

    def run(self, first: int, last: int) -> DataFrame:
        """A run as a table in its buckets, each in order."""
        name = f"queued_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (url STRING) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.folder}/queued/{first}-{last}'"
        )
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def put_run(self, urls: DataFrame, first: int, last: int) -> None:
        name = f"queued_{uuid.uuid4().hex}"
        out = urls.repartition(self.buckets, "url").write.mode("overwrite").bucketBy(self.buckets, "url").sortBy("url")
        out = out.option("parquet.bloom.filter.enabled#url", "true").option("path", f"{self.folder}/queued/{first}-{last}")
        out.saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def compact(self) -> None:
        while True:
            tail = self.runs()[-self.fan :]
            if len(tail) < self.fan or len({b - a for a, b in tail}) > 1:
                return
            every = union([self.run(*r) for r in tail])
            self.put_run(every, tail[0][0], tail[-1][1])

    def new_urls(self, urls: DataFrame, level: int) -> DataFrame:
        """The distinct ``urls`` that no run before a level holds, in the buckets of the index."""
        fresh = urls.select("url").distinct().repartition(self.buckets, "url")
        for r in self.runs(below=level):
            fresh = fresh.join(self.run(*r).hint("merge"), "url", "left_anti")
        return fresh

    def is_queued(self, urls: list[str]) -> set[str]:
        """Which of a few URLs are in the index; row groups that cannot hold one are skipped."""
        return {r[0] for a, b in self.runs() for r in self.run(a, b).where(F.col("url").isin(urls)).collect()}

    # Levels.

    def advance(self, responses: DataFrame, levels: int | None = None) -> bool:
        """Crawl ``levels`` further levels, or all that are left; whether there is more to do.

        The same as one run of :func:`siteatlas.operators.crawl.crawl`, wherever
        it is stopped.
        """
        if not self.runs():
            self.put_run(self.spark.createDataFrame([(self.start,)], "url string"), 0, 0)
        depth = self.levels
        last = self.options.max_depth if levels is None else min(self.options.max_depth, depth + levels - 1)
        while depth <= last and self.more(depth):
            self.level(responses, depth)
            depth += 1
        return depth <= self.options.max_depth and self.more(depth)

    def more(self, depth: int) -> bool:
        return depth == 0 or not self.spark.read.parquet(f"{self.folder}/level-{depth - 1}/frontier").isEmpty()

    def level(self, responses: DataFrame, depth: int) -> None:
        at = f"{self.folder}/level-{depth}"
        frontier = self.run(0, 0) if depth == 0 else self.spark.read.parquet(f"{self.folder}/level-{depth - 1}/frontier")
        left = None
        if self.options.request_limit:
            seen = self.read("pages", depth)
            left = self.options.request_limit - (seen.count() if seen is not None else 0)
        page_rows = fetched(frontier, responses, left)
        found_on(page_rows, depth, self.rules).write.mode("overwrite").parquet(f"{at}/links")
        links = self.spark.read.parquet(f"{at}/links")
        logged(page_rows, links, depth).write.mode("overwrite").parquet(f"{at}/pages")
        with setting(self.spark, IN_ORDER, "true"):
            # Runs are of the frontiers: that of this level is run depth + 1.
            self.put_run(self.new_urls(to_fetch(links, self.start, self.options), depth + 1), depth + 1, depth + 1)
            self.run(depth + 1, depth + 1).write.mode("overwrite").parquet(f"{at}/frontier")
            self.compact()

    def result(self, responses: DataFrame) -> dict[str, DataFrame]:
        """links and pages of the levels so far."""
        pages = self.read("pages")
        if pages is None or pages.isEmpty():
            return {}
        return {"links": distinct_links(self.read("links"), responses), "pages": pages}
