"""SimHash near-duplicates, linked by meeting in the middle of Hamming balls.

Two fingerprints link at ``3`` or fewer differing bits.  The ball of radius 3
is met in the middle: fingerprints at distance 1 or 2 share a variant with one
bit flipped on either side; at distance 3 exactly one of the two has an odd
number of set bits, and that one also flips two bits.  Of three differing bits
two lie in the same half of the word, so only pairs of flips within a half are
needed.  In a bucket of equal variants every member is within 3 of a member
that flipped at most one bit, so linking all to the least such member loses no
link between components and never makes pairs within a group.  The bits that
the fingerprints of a pair differ in are counted before it links.

Two-flip variants are many (992), so they are made only for fingerprints that
can have a partner at all.  A first exchange finds these: with one of three
blocks of the word blanked, partners differ by 2 or fewer of the other bits, so
they too meet in the middle, at variants with at most one flip.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.common import back_to_rows, bounded_batches, utf8, written
from siteatlas.llm.components import connected_components

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: For each byte, its bits as eight counters of a byte each.
SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8))


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of the 3-word shingles of a text, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    hashed = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [hashed(line, SEED)]
    starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    return [hashed(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text as a signed 64-bit number: a bit is set if over half the hashes have it."""
    hashes = [shingle_hashes(t) for t in texts]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
    n = counts[full]
    first = np.cumsum(n) - n
    # Byte counters hold 255: sum in pieces of that many hashes, then the pieces of a text.
    pieces = -(-n // 255)
    piece_first = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    by_byte = flat.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(SPREAD[by_byte[:, j]], piece_first) for j in range(8)], axis=1)
    bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS).astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    out[full] = np.packbits(2 * bits > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: list[str] = []) -> DataFrame:
    """(doc_id, fp) and the long columns ``also`` for every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = pa.array(fingerprints_of(utf8(batch, "text")), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), fp, *(batch.column(c) for c in also)], ["doc_id", "fp", *also]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *also)
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}, fp long", *(f"{c} long" for c in also)]))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def longs(values: list[int]):
    return F.array(*(F.lit(signed(v)).cast("long") for v in values))


def active(fps: DataFrame) -> DataFrame:
    """The distinct fingerprints that share a blanked variant with another; all with a partner are among them."""
    word, edges = (1 << BITS) - 1, [0, 21, 42, BITS]
    variants = []
    for low, high in zip(edges, edges[1:], strict=False):
        blank = ((1 << high) - 1) ^ ((1 << low) - 1)
        flips = [0, *(1 << b for b in range(BITS) if not blank >> b & 1)]
        variants.append(fps.select("fp", F.explode(longs(flips)).alias("v"), F.lit(signed(word ^ blank)).alias("mask")))
    rows = variants[0].union(variants[1]).union(variants[2])
    rows = rows.select("fp", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("v")).alias("key"))
    bucket = Window.partitionBy("key")
    return (
        rows.withColumn("low", F.min("fp").over(bucket))
        .withColumn("high", F.max("fp").over(bucket))
        .where("low <> high")
        .select("fp")
        .distinct()
    )


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that link; each at 3 or fewer bits."""
    half = BITS // 2
    near = [0, *(1 << b for b in range(BITS))]
    far = [1 << a | 1 << b for h in (0, half) for a in range(h, h + half) for b in range(h, a)]
    key = F.col("fp").bitwiseXOR(F.col("v")).alias("key")
    odd = F.bit_count("fp") % 2 == 1
    rows = (
        fps.select("fp", F.explode(longs(near)).alias("v"))
        .select(key, "fp", F.col("fp").alias("centre"))
        .union(
            fps.where(odd)
            .select("fp", F.explode(longs(far)).alias("v"))
            .select(key, "fp", F.lit(None).cast("long").alias("centre"))
        )
    )
    centre = F.min("centre").over(Window.partitionBy("key"))
    pairs = rows.select(F.col("fp").alias("a"), centre.alias("b")).where("b is not null and a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every row.

    Returns one row per input row: doc_id, fingerprint (16 hex digits) and
    component_id, the least doc_id that can be reached over links.  Null, empty
    and blank texts have fingerprint zero and link like any other; rows with
    equal fingerprints are one node, so copies are never paired.  Null ids get
    a row, and a component_id if any linked row has an id.  An empty table
    gives an empty result.  Texts are read whole.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    return back_to_rows(rows, written(components(rows), "components"), ["fp"], "copies").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def components(rows: DataFrame) -> DataFrame:
    """(fp, copies, group, component_id) of the fingerprints of ``rows`` (doc_id, fp); linked ones have one group."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    partners = written(active(nodes.select("fp")), "active")
    labels = connected_components(links(partners)).select(F.col("node").alias("fp"), "label")
    linked = written(labels.join(nodes.drop("copies"), "fp"), "labels")
    groups = linked.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    members = linked.join(groups, "label").select("fp", "label", "component_id")
    return nodes.join(members, "fp", "left").select(
        "fp", "copies", F.coalesce("label", "fp").alias("group"), F.coalesce("component_id", "first_doc").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; columns as given.

    The row of the least id stays, of rows with that id the one of the least
    hash of the text; one without an id only if no row of its component has
    one.  Rows are told apart by id and text, so rows of other components that
    share an id, or have none, stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__hash", F.xxhash64(text))
    rows = written(fingerprints(keyed, id_col, text_col, ["__hash"]), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__hash").alias("hash"))).alias("least")
    kept = (
        back_to_rows(rows, written(components(rows), "components"), ["fp"], "copies")
        .groupBy("group")
        .agg(least)
        .select(F.col("least.doc_id").alias("__kept"), F.col("least.hash").alias("__kept_hash"))
    )
    same = keyed[id_col].eqNullSafe(kept["__kept"]) & (keyed["__hash"] == kept["__kept_hash"])
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_col, "__hash"]).drop("__hash")
