"""Helpers shared by the operators: normalisation columns, batches, and tables in the shared folder."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.sources.tables import CLEANUP, setting, shared_root, written

__all__ = ["ascii_lower", "back_to_rows", "bounded_batches", "bucketed_table", "runs_in_order", "sorted_run", "text_or_empty", "utf8", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character kept.

    For a text of ASCII only, ``lower`` gives the same and runs on bytes.
    """
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Keep the Arrow batches that reach Python workers small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def utf8(batch, name: str) -> list[bytes]:
    """The texts of a column of an Arrow batch as UTF-8; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def bucketed_table(df: DataFrame, name: str, keys: list[str], sort: bool = False, spread: int = 1) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, in buckets of ``keys``: what goes by them needs no exchange.

    Rows of one key are to be in few tasks, or each task writes a file for each
    bucket.  There are ``spread`` buckets for each shuffle partition.  The table leaves the catalog at once; its files stay for the plans
    that read it.
    """
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(spread * int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    with setting(spark, CLEANUP, "true"):
        (writer.sortBy(*keys) if sort else writer).option("path", f"{shared_root(spark)}/siteatlas/{name}").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


@contextlib.contextmanager
def runs_in_order(spark: SparkSession):
    """Tables in sorted buckets of one file each are read as sorted, so that merge joins of runs sort nothing."""
    with setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
        yield


def sorted_run(rows: DataFrame, name: str, keys: list[str], apart: bool = True) -> DataFrame:
    """Rows as a run: a table in buckets of ``keys``, each in order.  ``apart``: whether they have to be dealt to their buckets first."""
    if apart:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return bucketed_table(rows, name, keys, sort=True)


#: A group of more than this share of all rows is hot; so no more than its inverse of groups can be.
HOT_SHARE = 1 / 2000


def back_to_rows(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with the groups they are in; both are written tables, ``size`` counts a group's rows.

    Hot groups, 2000 at most whatever the input, are broadcast, so the rows of
    one stay where they are instead of meeting in one task.  The rest goes by
    an exchange of the keys.
    """
    hot = F.col(size) > rows.count() * HOT_SHARE
    few = groups.where(hot)
    stay = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(groups.where(~hot), keys)
    return stay.unionByName(rest)
