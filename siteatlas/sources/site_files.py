"""Reports and graphs as folders of text: a data source writer whose tasks write parts and whose commit shows them all at once.

Rows have ``file`` and ``line``.  Each task writes its lines to a part of each
file they belong to, in a staging folder of the job; only when all tasks are
done does the commit move that folder to its place, so a failed or repeated
task leaves nothing behind.  Parts are numbered in the order of the lines:
``<folder>/<file>/part-00000``, ...; a file read in the order of its parts is
whole, whatever its length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from siteatlas.operators import fold
from siteatlas.operators.extract import link_key

FORMAT = "siteatlas_files"


@dataclass
class Parts(WriterCommitMessage):
    """The parts of one task: (attempt's folder, files in it)."""

    attempt: str
    files: list[str]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"{folder.rstrip('/')}.writing-{uuid.uuid4().hex}"

    def system(self):
        """The file system of the folder and the path within it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.staging) if "://" in self.staging or self.staging.startswith("file:") else (fs.LocalFileSystem(), self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        attempt = f"{context.partitionId():05}-{context.taskAttemptId()}"
        system, staging = self.system()
        open_: dict[str, pa.NativeFile] = {}
        try:
            for batch in iterator:
                for file, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    if file not in open_:
                        system.create_dir(f"{staging}/{attempt}/{file}", recursive=True)
                        open_[file] = system.open_output_stream(f"{staging}/{attempt}/{file}/part-{context.partitionId():05}")
                    open_[file].write(f"{line or ''}\n".encode())
        finally:
            for f in open_.values():
                f.close()
        return Parts(attempt, sorted(open_))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staging = self.system()
        for m in messages:
            for file in m.files if m else []:
                system.create_dir(f"{staging}/whole/{file}", recursive=True)
                part = f"part-{m.attempt.split('-')[0]}"
                system.move(f"{staging}/{m.attempt}/{file}/{part}", f"{staging}/whole/{file}/{part}")
        system.create_dir(f"{staging}/whole", recursive=True)
        target = staging.rsplit(".writing-", 1)[0]
        from pyarrow import fs

        if system.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                system.delete_dir(staging)
                raise FileExistsError(target)
            system.delete_dir(target)
        system.move(f"{staging}/whole", target)
        system.delete_dir(staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, staging = self.system()
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class SiteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(lines: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write lines (file, order, line) to a folder that all machines share; ``order`` may be of any type that sorts.

    The lines of a file go in ranges of their order, so its parts are in order
    and no task has a file whole.  A folder that is there is an error unless
    ``overwrite``.
    """
    lines.sparkSession.dataSource.register(SiteFiles)
    ordered = lines.repartitionByRange("file", "order", "line").sortWithinPartitions("file", "order", "line").select("file", "line")
    ordered.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(folder)


def read_files(spark: SparkSession, folder: str, file: str) -> list[str]:
    """The lines of one file of a folder, in order; for small files and tests."""
    rows = spark.read.text(f"{folder}/{file}").select("value", F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("n"))
    return [r["value"] for r in rows.orderBy("part", "n").collect()]


def graph_lines(links: DataFrame) -> DataFrame:
    """(file, order, line): the visual graph, a JSON line for each node and each edge."""
    nodes, edges = fold.visual_nodes(links), fold.visual_edges(links)
    as_line = lambda df, file, order: df.select(F.lit(file).alias("file"), F.col(order).alias("order"), F.to_json(F.struct(*df.columns)).alias("line"))
    return as_line(nodes, "nodes.jsonl", "id").unionByName(as_line(edges, "edges.jsonl", "from_id"))


# The lists of a written report, by category.
LISTS = {"web-page": "pages.md", "API": "api.md", "web-asset": "assets.md"}


def by_category(links: DataFrame) -> DataFrame:
    """(category, n): how many links each category has."""
    return links.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def report_lines(links: DataFrame) -> DataFrame:
    """(file, order, line): a written report of links, every list whole.

    README.md has how many links each category has, and under each page the
    links worth listing; pages.md, api.md and assets.md the links of their
    category, with the page on which each was first found.
    """
    row = lambda file, *order, line: [F.lit(file).alias("file"), F.concat_ws("\x1f", *order).alias("order"), line.alias("line")]
    title = links.sparkSession.createDataFrame([(f, f"# {t}") for f, t in [("README.md", "Site"), ("pages.md", "Pages"), ("api.md", "API"), ("assets.md", "Assets")]], "f string, t string")
    heads = title.select(F.col("f").alias("file"), F.lit("").alias("order"), F.col("t").alias("line"))
    counts = by_category(links).select(*row("README.md", F.lit("1"), F.col("category"), line=F.concat(F.lit("- "), "category", F.lit(": "), F.col("n").cast("string"))))
    worth = fold.valuable(links).select("source_url", "href", link_key().alias("key")).distinct()
    pages = worth.select("source_url").distinct().select(*row("README.md", F.lit("2"), F.col("source_url"), line=F.concat(F.lit("## "), "source_url")))
    below = worth.select(*row("README.md", F.lit("2"), F.col("source_url"), F.col("key"), F.col("href"), line=F.concat(F.lit("- "), "href")))
    file = F.create_map(*(F.lit(x) for kv in LISTS.items() for x in kv))[F.col("category")]
    each = links.groupBy(file.alias("file"), link_key().alias("key")).agg(F.min("source_url").alias("source_url")).where("file is not null")
    listed = each.select("file", F.concat_ws("\x1f", F.lit("1"), "key").alias("order"), F.concat(F.lit("- "), "key", F.lit(" ("), "source_url", F.lit(")")).alias("line"))
    out = heads
    for part in (counts, pages, below, listed):
        out = out.unionByName(part)
    return out


def save_graph(links: DataFrame, folder: str, overwrite: bool = False) -> None:
    """nodes.jsonl and edges.jsonl of the visual graph in a folder."""
    write_files(graph_lines(links), folder, overwrite)


def save_report(links: DataFrame, folder: str, overwrite: bool = False) -> None:
    """README.md, pages.md, api.md and assets.md in a folder."""
    write_files(report_lines(links), folder, overwrite)
