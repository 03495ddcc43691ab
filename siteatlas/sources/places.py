"""Links of a capture by place, so that a look-up or a folder reads little of it.

The table is sorted by place (host and decoded path without trailing slashes)
over all its files, in small row groups with Bloom filters.  A place is then
found by an equality, and all that is below one by a range of places, since
``/`` comes just before ``0``: both reach the scan as filters, which skip files
and row groups by their least and greatest place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.functions import url
from siteatlas.operators.extract import link_key


def save_places(links: DataFrame, folder: str, row_group: int = 4 << 20) -> None:
    """Write ``links`` with ``key`` and ``place`` to a folder; ``row_group`` bytes are read for a place at least."""
    rows = links.withColumn("key", link_key()).withColumn("place", url.host_path_key(F.col("key")))
    ordered = rows.repartitionByRange("place", "key").sortWithinPartitions("place", "key")
    out = ordered.write.mode("overwrite").option("parquet.block.size", str(row_group)).option("parquet.page.row.count.limit", "1000")
    out.option("parquet.bloom.filter.enabled#place", "true").parquet(folder)


def below(place: Column) -> Column:
    """Whether the row's place is a place given, or lies below it on the same host."""
    head = F.when(place.endswith("/"), place).otherwise(F.concat(place, F.lit("/")))
    stop = F.concat(F.regexp_replace(head, "/$", ""), F.lit("0"))
    at = F.col("place")
    return (at == place) | ((at >= head) & (at < stop))


@dataclass
class Places:
    """The links of a folder that :func:`save_places` wrote."""

    table: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Places:
        return cls(spark.read.parquet(folder))

    def at(self, full: str) -> DataFrame:
        """Links of the place of a URL: of any query, fragment, scheme and trailing slash."""
        return self.table.where(F.col("place") == url.host_path_key(F.lit(full)))

    def under(self, full: str) -> DataFrame:
        """Links at the place of a URL or below it."""
        return self.table.where(below(url.host_path_key(F.lit(full))))

    def children(self, full: str) -> DataFrame:
        """(place, n, links): the places one step below, each with how many links it and all below it have, and whether it has links of its own."""
        top = url.host_path_key(F.lit(full))
        head = F.when(top.endswith("/"), top).otherwise(F.concat(top, F.lit("/")))
        rest = F.substring("place", F.length(head) + 1, F.length("place"))
        rows = self.under(full).where(F.col("place") != top).select(F.concat(head, F.substring_index(rest, "/", 1)).alias("step"), "place")
        return rows.groupBy(F.col("step").alias("place")).agg(F.count("*").alias("n"), F.bool_or(F.col("place") == F.col("step")).alias("own"))
