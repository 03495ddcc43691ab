"""API contracts of a stream of requests: mergeable state, a part for each micro-batch, merged in levels.

A micro-batch becomes the partial contracts of its requests, written as one
part; parts are combined by aggregates, so a batch costs what it brings and not
what came before.  ``fan`` parts of a level become one of the next, so there
are few parts and a row is rewritten a logarithmic number of times.  A part's
name is the range of batches that it holds; one that lies within a finished
larger one is out of use, so a run that was stopped anywhere goes on from its
checkpoint, and a batch that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from siteatlas.operators.contracts import MAX_RAW, MERGE, combined, partial_contracts, whole_contracts
from siteatlas.streaming.incremental import distinct_observations


def parts_in(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """The finished parts (first batch, last batch) that no larger finished part covers, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = fs.exists
    last = list(MERGE)[-1]  # written last
    found = [tuple(map(int, n.split("-"))) for n in names if done(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/{last}/_SUCCESS"))]
    return sorted((a, b) for a, b in found if not any((c, d) != (a, b) and c <= a and b <= d for c, d in found))


def write_part(tables: dict[str, DataFrame], folder: str, first: int, last: int) -> None:
    for name in MERGE:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{first}-{last}/{name}")


def read_parts(spark: SparkSession, folder: str, parts: list[tuple[int, int]], max_raw: int) -> dict[str, DataFrame]:
    return {name: combined(name, spark.read.parquet(*(f"{folder}/{a}-{b}/{name}" for a, b in parts)), max_raw) for name in MERGE}


def merge_full_levels(spark: SparkSession, folder: str, fan: int, max_raw: int) -> None:
    """Combine ``fan`` neighbouring parts of one size, from the latest on, until none are left."""
    while True:
        parts = parts_in(spark, folder)
        tail = parts[-fan:]
        if len(tail) < fan or len({b - a for a, b in tail}) > 1:
            return
        write_part(read_parts(spark, folder, tail, max_raw), folder, tail[0][0], tail[-1][1])


def contract_stream(
    observations: DataFrame, folder: str, late: str | None = "1 hour", fan: int = 8, max_raw: int = MAX_RAW
) -> DataStreamWriter:
    """A writer that keeps the partial contracts of a stream of observations in ``folder``, which all machines share.

    With ``late``, rows have a time ``fetched_at``; of equal requests within
    the watermark the first counts, and rows behind it go.  The caller gives a
    checkpoint location and starts it.
    """
    rows = distinct_observations(observations, late) if late else observations

    def merge(batch: DataFrame, number: int) -> None:
        write_part(partial_contracts(batch, max_raw), folder, number, number)
        merge_full_levels(batch.sparkSession, folder, fan, max_raw)

    return rows.writeStream.foreachBatch(merge).outputMode("append")


def contracts_so_far(spark: SparkSession, folder: str, max_raw: int = MAX_RAW) -> dict[str, DataFrame]:
    """The contracts of all batches so far, as ``infer_contracts`` gives them for all their rows; empty without a batch."""
    parts = parts_in(spark, folder)
    return whole_contracts(read_parts(spark, folder, parts, max_raw)) if parts else {}
