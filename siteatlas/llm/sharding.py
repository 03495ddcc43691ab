"""Contiguous shards of equal byte size, by global prefix sums from per-partition totals.

Rows are put in order of their id over range partitions.  Each partition sums
its own sizes; the totals of the partitions before it, a table with one row
per partition, give its offset.  A row's global position is then known without
any task seeing all rows, and the law is one division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.common import text_or_empty, written


def with_offsets(sized: DataFrame, order: list[str], rows_per_range: int = 200_000) -> DataFrame:
    """``sized`` (has ``size``) plus ``before`` (bytes) and ``index`` (rows) ahead of each row in the order given."""
    spark = sized.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Ties in the order, such as repeated rows, spread over ranges by an id that is fixed once the table is written.
    tied = sized.withColumn("__tie", F.monotonically_increasing_id())
    ranged = written(
        tied.repartitionByRange(ranges, *order, "__tie").withColumn("__range", F.spark_partition_id()), "ranges"
    )
    totals = (
        ranged.groupBy("__range")
        .agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
        .orderBy("__range")
        .collect()  # one row per range: bounded by the number of ranges
    )
    offsets, byte, row = [], 0, 0
    for t in totals:
        offsets.append((t["__range"], byte, row))
        byte, row = byte + t["__bytes"], row + t["__rows"]
    bases = spark.createDataFrame(offsets, "__range int, __byte0 long, __row0 long")
    within = Window.partitionBy("__range").orderBy(*order, "__tie")
    return (
        ranged.withColumn("__sum", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__nth", F.row_number().over(within))
        .join(F.broadcast(bases), "__range")
        .withColumn("before", F.col("__byte0") + F.col("__sum") - F.col("size"))
        .withColumn("index", F.col("__row0") + F.col("__nth") - 1)
        .withColumn("total", F.lit(byte).cast("long"))
        .drop("__sum", "__nth", "__byte0", "__row0", "__range", "__tie")
    )


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row under the law ``bytes``.

    Size is the UTF-8 length of the text (null: none) plus 1.  Shards are
    contiguous in the order of doc_id (nulls first, then ties by size and
    checksum); a row goes to the shard in which its middle byte falls, so no
    shard is off its target by more than the row at either cut.  ``slot``
    counts from 0 within a shard.  Repeated rows get slots of their own; an
    empty table gives an empty result; fewer rows than shards leave some
    shards empty.  ``grown_shard`` is null: under this law a change of the
    shard count moves rows.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text_or_empty(text), "UTF-8")).alias("text_crc32"),
    )
    placed = with_offsets(sized, ["doc_id", "size", "text_crc32"])
    # floor(shards * (before + size/2) / total), in integers
    law = F.expr(f"({shards} * (2 * before + size)) div (2 * total)")
    placed = placed.withColumn("shard", F.least(law, F.lit(shards - 1)).cast("int"))
    starts = placed.groupBy("shard").agg(F.min("index").alias("__first"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("index") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
