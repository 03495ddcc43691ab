"""Runs (maximal periodic stretches) of words, by Lyndon arrays in an order and in its inverse.

The words themselves are the ordered alphabet: they are only compared, never
hashed or ranked, and no suffix structure is built.  A run's period, repeated,
has a rotation that is a Lyndon word in one of the two orders, and where that
rotation starts it is the longest Lyndon word; so every run appears as an edge
from a start i to its next smaller suffix j, with period j - i, as far as the
words at i and at j agree to both sides.

The edges are found from left to right.  How far two suffixes agree is read
from what was matched before: along a chain of smaller suffixes the lengths
already known decide all but ties, and a tie inside the stretch that an earlier
pair has matched is a copy of a pair further left.  Words are compared only
beyond the rightmost word matched so far, or once for a step of a chain, which
makes the work linear in the words of a text (Ellert and Fischer, "Linear Time
Runs over General Ordered Alphabets", 2021).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import bounded_batches, utf8

MIN_LENGTH = 6
MIN_EXPONENT = 4


def lyndon_roots(words: Sequence, up: bool, exponent: int) -> list[tuple[int, int, int]]:
    """(i, j, m): j starts the next smaller suffix of i, the suffixes agree in m words, and m > (exponent - 2) * (j - i).

    ``up``: smaller in the order of the words, or else in its inverse; the end
    of the text is smaller than any word in both.
    """
    n = len(words)
    found = []
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix, and in how many words it agrees
    after, agreed = [n] * n, [0] * n  # the next smaller suffix, and in how many words it agrees
    same = [0] * (n + 1)  # in how many words a suffix and the one just before it agree
    for j in range(n - 1, 0, -1):
        if words[j] == words[j - 1]:
            same[j] = same[j + 1] + 1
    reach, shift = 0, 0  # words[x] == words[x - shift] from an earlier start up to reach, and not at reach
    most = exponent - 2
    for j in range(1, n):
        i, m = j - 1, same[j]
        end = j + m
        if end > reach and m:
            reach, shift = end, 1
        while True:
            if end != n and (words[i + m] < words[end]) is up:
                before[j], shared[j] = i, m
                break
            after[i], agreed[i] = j, m
            if m and m > most * (j - i):
                found.append((i, j, m))
            known = shared[i]
            i = before[i]
            if i < 0:
                break
            if m < known:  # the same word decides
                continue
            if m > known:  # what made i smaller than its successor makes it smaller than j
                before[j], shared[j] = i, known
                break
            if end < reach:  # inside what has been matched: the same pair stands ``shift`` words to the left
                left, right = i - shift, j - shift
                copy = shared[right] if before[right] == left else agreed[left]
                rest = reach - j
                m = min(copy, rest)
                end = j + m
                if copy != rest:
                    continue
            while end < n and words[end] == words[i + m]:
                end += 1
                m += 1
            if end > reach:
                reach, shift = end, j - i
    return found


def word_runs(words: Sequence, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with length >= max(min_length, min_exponent * period), by start, then period.

    ``min_exponent`` is at least 2.  The first root of a run starts less than a
    period after the run; only it is extended to the left.
    """
    if len(words) < min_length:
        return []
    runs = set()
    for up in (True, False):
        roots = lyndon_roots(words, up, min_exponent)
        known = {i: (j, m) for i, j, m in roots}
        for i, j, m in roots:
            period = j - i
            if known.get(i - period) == (i, m + period):
                continue
            left = 0
            while left < i and words[i - 1 - left] == words[j - 1 - left]:
                left += 1
            length = left + period + m
            if length >= min_length and length >= min_exponent * period:
                runs.add((i - left, length, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    goes = bytearray(len(words))
    for start, length, period in runs:
        goes[start + period : start + length] = b"\1" * (length - period)
    return b" ".join([w for w, g in zip(words, goes, strict=True) if not g])


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """The runs of words of every text, and the text with each run cut to its first period.

    Words are what ASCII white space parts, as they are written.  Returns one
    row per input row, repeated rows and null ids too: doc_id, n_words (long),
    runs (array of start, length, period; by start, then period) and collapsed
    (the kept words joined by one space).  A null, empty or blank text has no
    words and no runs and an empty ``collapsed``; an empty table gives an empty
    result; further columns are not read.  Every text stays in its task; memory
    grows with the longest text only.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, runs, kept = [], [], []
            for text in utf8(batch, "text"):
                words = text.split()
                found = word_runs(words, min_length, min_exponent)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(without_repeats(words, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a tenth of the texts made periodic from some word on, as the fixed rule of the query says.

    Let h be the crc32 of the id in decimal and g = floor(h / 10).  Where h ends
    in 0 and the text has n > 0 words, each word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Other texts stay as they are; so do those of null ids.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("__words")
    a = g % n
    p = F.floor((n - a) / (g % 8 + 3)) + 1
    planted = F.array_join(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get("__words", F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")),
        ),
        " ",
    )
    chosen = (h % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return (
        docs.withColumn("__words", F.when(chosen, words))
        .withColumns({"__a": F.when(n > 0, a), "__p": F.when(n > 0, p)})
        .withColumn(text_col, F.when(n > 0, planted).otherwise(F.col(text_col)))
        .drop("__words", "__a", "__p")
    )


def run_digest(found: DataFrame) -> DataFrame:
    """One row for each row of ``find_runs``: doc_id, n_runs, the longest run, and digests of all runs and of the kept words.

    start, length, period and exponent_milli are of the run with the greatest
    length (ties: smallest start, then period), null without a run.
    runs_sha256 is of ``start,length,period`` and a line feed for each run,
    collapsed_sha256 of the collapsed text; both lowercase hex over UTF-8.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        best.alias("best"),
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
