"""Benchmark decontamination: which words of a document lie in a window of a benchmark text.

The windows of the benchmark are searched for with Wu-Manber, in one pass over
the documents for each ``block_bytes`` of benchmark text.  A pass is a stage of
its own: what it found and the texts are written for the next one, and its
tables are given up before those of the next are made.  So driver and workers
hold the tables of one block: a window for each word of it, so about ``window``
times its bytes and twice that for shifts and buckets.  That is bounded by the
parameter and not by the benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import bounded_batches, utf8, written
from siteatlas.llm.wu_manber import WuManber

#: Bytes of a word after A-Z is lower-cased: 0-9, a-z, all beyond ASCII; the rest parts words.
TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
FOUND = "doc_id {id}, n_words long, spans array<struct<first: long, last: long>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def windows(items: list[tuple[str, bytes]], size: int) -> dict[bytes, set[str]]:
    """Each distinct window, between spaces, and the items that have it."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            found.setdefault(b" " + b" ".join(w[i : i + size]) + b" ", set()).add(item)
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(texts: list[bytes], automaton: WuManber, sizes: list[int], items: list[list[str]]):
    """For each text: number of words, merged word spans of the hits, ids of the items."""
    split = [words(t) for t in texts]
    flat = [b" " + b" ".join(w) + b" " if w else b"" for w in split]
    starts = np.cumsum([0, *(len(t) + 1 for t in flat)])
    buffer = b"\n".join(flat)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[set[str]] = [set() for _ in texts]
    if hits := automaton.search(buffer):
        spaces = np.flatnonzero(np.frombuffer(buffer, dtype=np.uint8) == 32)
        at = np.array([s for s, _ in hits])
        doc = np.searchsorted(starts, at, side="right") - 1
        word = np.searchsorted(spaces, at) - np.searchsorted(spaces, starts[doc])
        for d, w, (_, k) in zip(doc.tolist(), word.tolist(), hits, strict=True):
            spans[d].append((w, w + sizes[k] - 1))
            names[d].update(items[k])
    return [len(w) for w in split], [merged(s) for s in spans], [sorted(n) for n in names]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Words of each document that are part of a benchmark window.

    Returns one row per input row: doc_id, n_words, ``spans`` (first and last
    index of runs of hit words) and ``items`` (ids of the benchmark texts with
    a window in the document, as strings in order).  A null or empty text has
    no words and no hits; a benchmark text of fewer words than the window is
    one window, one without words is none; repeated benchmark texts count
    under each of their ids, a null id as ``""``.  Rows are never compared, so
    repeated rows have a row each, however many blocks the benchmark needs.
    Empty tables give an empty result or no hits.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks > 1:
        tests = written(tests.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark")
    found = rows
    for k in range(blocks):
        block = tests.where(F.col("block") == k) if blocks > 1 else tests
        patterns = windows([(r["item"], (r["text"] or "").encode()) for r in block.toLocalIterator()], window)
        last = k == blocks - 1
        tables = spark.sparkContext.broadcast(block_tables(patterns))
        found = found.mapInArrow(one_pass(tables, last), one_schema(found, last))
        if not last:
            found = written(found, "found")
            tables.destroy()
    return found


def block_tables(found: dict[bytes, set[str]]) -> tuple[WuManber, list[int], list[list[str]]]:
    """The search tables of a block's windows, how many words each has, and whose it is."""
    patterns = list(found)
    return WuManber(patterns), [p.count(b" ") - 1 for p in patterns], [sorted(found[p]) for p in patterns]


def one_schema(rows: DataFrame, last: bool) -> str:
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return ("" if last else "text string, ") + FOUND.format(id=id_type)


def one_pass(tables, last: bool):
    """Search for one block; what blocks before it have found in a row is united with it, the text goes on to the next."""

    def run(batches):
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            n, spans, items = scan(utf8(batch, "text"), *tables.value)
            if "spans" in batch.schema.names:
                earlier = [[(s["first"], s["last"]) for s in x] for x in batch.column("spans").to_pylist()]
                spans = [merged(a + b) for a, b in zip(earlier, spans, strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), items, strict=True)]
            ranges = [[{"first": a, "last": b} for a, b in s] for s in spans]
            cols = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64())}
            cols |= {"spans": pa.array(ranges, span), "items": pa.array(items, pa.list_(pa.string()))}
            if not last:
                cols = {"text": batch.column("text")} | cols
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def contamination_report(found: DataFrame) -> DataFrame:
    """Counts and digest of what :func:`find_contamination` found."""
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that have a benchmark window; columns as given.

    Rows are told apart by id and text, so a clean row stays although another
    shares its id or has none either.  Null and empty texts are clean.
    """
    names = {"id_col": "doc_id", "text_col": "text"} | how
    id_col, text = names["id_col"], F.coalesce(F.col(names["text_col"]), F.lit(""))
    keyed = docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")))
    found = find_contamination(keyed, benchmark, **names | {"id_col": "__row"})
    bad = found.where(F.size("spans") > 0).select(F.col("doc_id.id").alias("__id"), F.col("doc_id.hash").alias("__hash"))
    same = keyed[id_col].eqNullSafe(bad["__id"]) & (keyed["__row.hash"] == bad["__hash"])
    return keyed.join(bad, same, "left_anti").drop("__row")
