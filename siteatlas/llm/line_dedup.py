"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys in order, in buckets by key, each with the number of documents that
hold it and, where this run saw the key first, the largest id among them.  A
batch of documents is merge-anti-joined with the runs: keys that no run has
are fresh and bring their owner, the others only add to the count.  Both make
a new run at level 0; ``fan`` runs of a level are compacted into one of the
next, so a key is rewritten a logarithmic number of times.  Batches come in
descending order of doc_id, which makes the first document seen the owner.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siteatlas.llm.common import ascii_lower, back_to_rows, runs_in_order, sorted_run, text_or_empty, written

BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
ROW = ["doc_id", "row"]


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key has ``min_chars`` code points or more.

    ``row`` tells rows that repeat a doc_id apart by their text; h1 and h2 are
    independent 64-bit hashes of the key.
    """
    text = text_or_empty(F.col("text"))
    lines = docs.select("doc_id", F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.select(*ROW, "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


@dataclass
class LineRuns:
    """The runs of all batches so far, by level."""

    fan: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)

    def add(self, batch: DataFrame) -> DataFrame:
        """Add the lines (doc_id, h1, h2) of a batch; returns its own run, where fresh keys have an owner.

        No document may come in two batches, and no later batch may have a
        larger doc_id.
        """
        own = batch.select("doc_id", *KEY).distinct().groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("owner")
        )
        # Merge-anti-joins with each run: a key found in one is not fresh.
        for k, run in enumerate(r for level in self.levels for r in level):
            known = run.select(*KEY, F.lit(True).alias(f"known{k}")).hint("merge")
            own = own.join(known, KEY, "left").select(
                *KEY, "n_docs", F.when(F.col(f"known{k}").isNull(), F.col("owner")).alias("owner")
            )
        with runs_in_order(batch.sparkSession):
            run = sorted_run(own, "line_run", KEY)
            self._put(run, 0)
        return run

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            merged = sorted_run(self._merge(self.levels[level]), "line_run", KEY)
            self.levels[level] = []
            self._put(merged, level + 1)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Sorted runs walk along each other: counts of equal keys add up, and one of them brings the owner."""
        every = runs[0]
        for r in runs[1:]:
            other = r.select(*KEY, F.col("n_docs").alias("more"), F.col("owner").alias("other")).hint("merge")
            docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            every = every.join(other, KEY, "full_outer").select(*KEY, docs.alias("n_docs"), F.greatest("owner", "other").alias("owner"))
        return every

    def keys(self) -> DataFrame | None:
        """(h1, h2, n_docs, owner) of every key of all batches."""
        runs = [r for level in self.levels for r in level]
        return self._merge(runs) if runs else None


def batches_of(lines: DataFrame, batches: int) -> DataFrame:
    """``lines`` with a number of their batch, from 0 for the largest ids on; null ids come last.

    Batches are of about equal size.  Ids that are no integers go by the first
    seven bytes of their text, whose order is theirs, so ids alike in these are
    in one batch.
    """
    place = F.col("doc_id")
    if not isinstance(lines.schema["doc_id"].dataType, IntegralType):
        start = F.rpad(F.hex(F.substring(place.cast("string").cast("binary"), 1, 7)), 14, "0")
        place = F.conv(start, 16, 10).cast("long")
    shares = [k / batches for k in range(1, batches)]
    cuts = lines.agg(F.percentile_approx(place, shares, 1000)).first()[0] if shares else []
    number = F.lit(0)
    for c in sorted(set(cuts or [])):
        number = number + (F.coalesce(place, F.lit(-(1 << 63))) <= F.lit(c)).cast("int")
    return lines.withColumn("batch", number)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan: int = 2) -> DataFrame:
    """Drop lines that many documents share, but for the largest document that holds them.

    Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines except in the document of the largest id.
    Returns one row per input row: doc_id, n_lines (before dropping),
    n_dropped, kept_text and kept_sha256.  A null or empty text is one empty
    line and is returned as such; a text whose every line goes becomes empty.
    Rows that repeat a doc_id are one document; a null id is one document that
    never owns a key which another document holds.  Ids may be numbers or
    strings.  An empty table gives an
    empty result.
    """
    docs = docs.select("doc_id", "text")
    lines = written(long_lines(docs, min_chars), "lines")
    lines = written(batches_of(lines, batches), "batches")
    runs = LineRuns(fan)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    with runs_in_order(docs.sparkSession):
        hot = written(runs.keys().where(F.col("n_docs") >= min_docs), "hot")
    goes = (
        back_to_rows(lines, hot, KEY, "n_docs")
        .where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"))
        .agg(F.array_sort(F.collect_set("pos")).alias("goes"))  # bounded by the lines of one document
    )
    text = text_or_empty(F.col("text"))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("row"))
    both = keyed.join(goes, keyed["doc_id"].eqNullSafe(goes["__doc"]) & (keyed["row"] == goes["__row"]), "left")
    return (
        both.withColumn("lines", F.split("text", "\n", -1))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("kept_text", F.when(F.col("goes").isNull(), F.col("text")).otherwise(F.expr(KEPT)))
        .select(
            "doc_id",
            "n_lines",
            F.coalesce(F.size("goes"), F.lit(0)).cast("long").alias("n_dropped"),
            "kept_text",
            F.sha2("kept_text", 256).alias("kept_sha256"),
        )
    )


#: One flag for each line, made from the sorted positions in linear time, then the lines whose flag is 0.
KEPT = """array_join(filter(transform(
  arrays_zip(lines, split(rpad(array_join(transform(goes,
    (p, i) -> concat(repeat('0', p - if(i = 0, 0, get(goes, i - 1) + 1)), '1')), ''), size(lines), '0'), '')),
  x -> if(x['1'] = '0', x.lines, null)), x -> x is not null), '\\n')"""
