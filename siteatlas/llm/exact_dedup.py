"""Exact deduplication by a tree-merge of sorted digest runs.

The input partitions make ``runs`` runs: the distinct digests of a run in
order, each with the identifier to keep and the number of rows.  A run is a
table in buckets of the digest space, each in order, so that bucket k of all
runs can be merged in one place.  In binomial rounds, run 2j takes in run
2j + 1: a full outer merge join walks along the two sorted runs, records of
equal texts become one, and what comes out is the next round's run.  A bucket
holds one record of a digest for each run at most, however many rows have it,
so no task sees a group of rows whole.  Equal digests count as equal texts only
if byte length and a second, independent hash agree as well; they are part of
every merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import ascii_lower, back_to_rows, bucketed_table, runs_in_order, sorted_run, text_or_empty, written

IDENTITY = ["text_sha256", "n_bytes", "check_hash"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the digest of its normalised text, and the run it belongs to."""
    text = ascii_lower(text_or_empty(F.col(text_col)))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.sha2("t", 256).alias("text_sha256"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("check_hash"),
        F.spark_partition_id().alias("run"),
    )


def better(a: Column, b: Column, keep: str) -> Column:
    """The identifier of two that stays; a null one only beside another."""
    return (F.greatest if keep == "largest" else F.least)(a, b)


def sorted_runs(table: DataFrame, keep: str, runs: int) -> list[DataFrame]:
    """(digest, keep_id, group_size): the runs, combined in their partitions before they are dealt to buckets and sorted."""
    best = F.max if keep == "largest" else F.min
    own = table.groupBy("run", *IDENTITY).agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return [sorted_run(own.where(F.col("run") == r).drop("run"), "digest_run", IDENTITY) for r in range(runs)]


def merge_runs(one: DataFrame, other: DataFrame, keep: str) -> DataFrame:
    """Two sorted runs as one, in order and in the same buckets."""
    more = other.select(*IDENTITY, F.col("keep_id").alias("other_id"), F.col("group_size").alias("more")).hint("merge")
    return one.join(more, IDENTITY, "full_outer").select(
        *IDENTITY,
        better(F.col("keep_id"), F.col("other_id"), keep).alias("keep_id"),
        (F.coalesce("group_size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("group_size"),
    )


def tree_merge(runs: list[DataFrame], keep: str) -> DataFrame:
    """One run of all, by rounds in which every second run is merged into the one before it."""
    with runs_in_order(runs[0].sparkSession):
        while len(runs) > 1:
            pairs = [runs[k : k + 2] for k in range(0, len(runs), 2)]
            # The rows of a merge are in their buckets already, so each task writes one.
            runs = [p[0] if len(p) == 1 else bucketed_table(merge_runs(*p, keep), "digest_run", IDENTITY, sort=True) for p in pairs]
    return runs[0]


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int = 4,
) -> DataFrame:
    """Group equal texts (A-Z lower-cased) and name the row that stays, by ``runs`` sorted runs.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256.  A null text counts as empty, and all empty texts are equal.
    Rows that repeat both id and text share ``keep_id`` and are all ``kept``
    (the id, not the row, is what stays); a null id stays only if its whole
    group has null ids.  An empty table gives an empty result.  Further
    columns of ``docs`` are ignored, whatever their names.
    """
    table = written(digests(docs, id_col, text_col).withColumn("run", F.col("run") % runs), "digests")
    groups = tree_merge(sorted_runs(table, keep, runs), keep)
    return back_to_rows(table, groups, IDENTITY, "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; columns as given.

    Of rows that repeat id and text, one stays.
    """
    kept = exact_dedup(docs, id_col, text_col, **how).where("kept")
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_text")).distinct()
    keyed = docs.withColumn("__text", F.sha2(ascii_lower(text_or_empty(F.col(text_col))), 256))
    same = keyed[id_col].eqNullSafe(kept["__kept_id"]) & (keyed["__text"] == kept["__kept_text"])
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_col, "__text"]).drop("__text")
