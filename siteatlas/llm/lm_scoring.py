"""Language-model scores from subword lattices.

A word's probability is the marginal of its lattice: the sum over all
segmentations into the pieces of an existing unigram vocabulary, and then the
end of the word, by a forward recursion in log space.  A text's score is the
log10 of the product over its words and its end, which is the marginal over all
segmentations of the text, since no piece crosses a word's start.

The vocabulary's scores are rescaled to the corpus by ``rescale_steps`` steps of
expected counts: over the lattices of all distinct training words, each as
often as it occurs, weighted by the scores so far.  In each step the existing
scores keep a share of ``kept``, so that pieces which the corpus lacks keep
their order; without steps they are used as they are.

The exchange is of postings: each task gathers, for every distinct word of a
block of texts, which of these have it and how often.  A word that every text
has is one record for each block.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import back_to_rows, bounded_batches, utf8, written
from siteatlas.llm.lattice import Lattices, Vocabulary, in_groups, load_sentencepiece
from siteatlas.llm.sentencepiece_codec import DEFAULT_MODEL

#: A block closes at so many (word, text) pairs or texts; a text's number and a count share 32 bits.
BLOCK_PAIRS, BLOCK_TEXTS, COUNT_MAX = 4_000_000, 1 << 15, (1 << 16) - 1
#: Share of the existing scores in the rescaled ones, if nothing else is said.
KEPT = 0.1
#: Probability of the end of a text where there is no training text to tell.
END_SHARE = 1e-3


def is_held_out(doc_id: Column) -> Column:
    """Rows not learned from: crc32 of the id as text leaves 2 by 7; null ids are held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(True))


class Block:
    """Postings of some texts by word; the word b"" stands for the end of a text."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.word, self.count, self.size = array("i"), array("q"), array("i")
        self.docs: list = []
        self.held_out = array("b")

    def add(self, doc_id, text: bytes, held_out: bool) -> None:
        counts = Counter(text.lower().split())
        counts[b""] = 1
        find = self.words
        self.word.extend([find.setdefault(w, len(find)) for w in counts])
        self.count.extend(counts.values())
        self.size.append(len(counts))
        self.docs.append(doc_id)
        self.held_out.append(held_out)

    def full(self) -> bool:
        return len(self.word) >= BLOCK_PAIRS or len(self.docs) >= BLOCK_TEXTS

    def batches(self, block: int, doc_type: pa.DataType):
        if not self.docs:
            return
        word, count = np.frombuffer(self.word, np.int32), np.frombuffer(self.count, np.int64)
        doc = np.repeat(np.arange(len(self.docs), dtype=np.int32), np.frombuffer(self.size, np.int32))
        learned, m = np.frombuffer(self.held_out, np.int8)[doc] == 0, len(self.words)
        seen = np.bincount(word[learned], count[learned], m).astype(np.int64)
        over = np.flatnonzero(count > COUNT_MAX)
        if len(over):  # a count beyond 16 bits takes several entries
            times = -(-count // COUNT_MAX)
            last = np.cumsum(times) - 1
            word, doc, rest = np.repeat(word, times), np.repeat(doc, times), count - (times - 1) * COUNT_MAX
            count = np.full(len(word), COUNT_MAX)
            count[last] = rest
        order = np.argsort(word, kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(word, minlength=m))).astype(np.int32)
        packed = (doc[order].astype(np.int64) << 16 | count[order]).astype(np.int32)
        names = list(self.words)
        ends = np.zeros(m + 1, np.int32)
        ends[names.index(b"") + 1 :] = len(self.docs)
        table = pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.binary()),
                pa.array(seen),
                pa.array(np.full(m, block, np.int64)),
                pa.ListArray.from_arrays(pa.array(edges), pa.array(packed)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(self.docs, doc_type)),
            ],
            ["word", "c", "block", "pairs", "docs"],
        )
        for at in range(0, len(table), 20_000):
            yield table.slice(at, 20_000)


def postings(docs: DataFrame) -> DataFrame:
    """(word, c: its count in training texts, block, pairs, docs).

    ``pairs``: a text's number in its block and the count of the word; ``docs``:
    at the word b"", the ids of the block's texts by number.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        block, number = Block(), TaskContext.get().partitionId() << 32
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            cols = (batch.column(c).to_pylist() for c in ("doc_id", "held_out"))
            for doc_id, held_out, text in zip(*cols, utf8(batch, "text"), strict=True):
                block.add(doc_id, text, held_out)
                if block.full():
                    yield from block.batches(number, doc_type)
                    block, number = Block(), number + 1
        if doc_type is not None:
            yield from block.batches(number, doc_type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        run, f"word binary, c long, block long, pairs array<int>, docs array<{kind}>"
    )


def lattice_groups(vocabulary: Vocabulary, words: list[bytes]):
    """The lattices of the words, each after a whitespace marker, in groups of bounded size."""
    for group in in_groups([b" " + w for w in words]):
        yield Lattices(vocabulary, group)


def edge_scores(lattices: Lattices, weights: np.ndarray) -> np.ndarray:
    """Log weights of edges; the last 256 of ``weights`` are for single bytes, a bare character is the product of its bytes."""
    size = lattices.vocabulary.size
    score = weights[lattices.ids]
    bare = np.flatnonzero(lattices.ids < 0)
    if len(bare):
        score[bare] = lattices.span[bare] * weights[size]
    return score


def normalised(shares: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Log weights that sum to 1 over what may begin a word and over what may follow.

    A word begins with a piece that has the marker; then come pieces without
    it, a byte of no piece, or the end of the word.
    """
    first = np.zeros(len(shares), dtype=bool)
    first[: v.size] = [s[:1] == b" " for s in v.surface]
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(first, np.log(shares / shares[first].sum()), np.log(shares / shares[~first].sum()))
    logs[v.size] -= np.log(256.0)  # one of 256 bytes
    return logs


def first_weights(v: Vocabulary) -> np.ndarray:
    """The vocabulary's own scores, with shares for a byte of no piece and for the end of a word."""
    return normalised(np.append(np.exp(v.scores), [1e-4, 0.2]), v)


def expected_counts(words: DataFrame, shared, weights: np.ndarray) -> np.ndarray:
    """Expected pieces over the lattices of the words (word, c), each c times; the result has the vocabulary's size and two."""

    def run(batches):
        v = shared.value
        total = np.zeros(v.size + 2)
        for batch in batches:
            found = {w: c for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True) if w}
            for lattices in lattice_groups(v, list(found)):
                often = np.array([found[w[1:]] for w in lattices.chunks], np.float64)
                chunk = np.searchsorted(lattices.ends, lattices.start, side="right")
                share = lattices.posterior(edge_scores(lattices, weights)) * often[chunk]
                bare = lattices.ids < 0
                total[: v.size] += np.bincount(lattices.ids[~bare], share[~bare], v.size)
                total[v.size] += (share * lattices.span)[bare].sum()
                total[v.size + 1] += often.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "n"])

    rows = words.select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    total = np.zeros(len(weights))
    for r in rows.collect():  # at most one row per piece of the vocabulary
        total[r["piece"]] = r["n"]
    return total


def rescaled(first: np.ndarray, counts: np.ndarray, v: Vocabulary, kept: float = KEPT) -> np.ndarray:
    """The weights of a step of expected counts, of which the first weights keep a share of ``kept``."""
    before = np.where(np.isfinite(first), np.exp(first), 0)
    before[v.size] *= 256  # as one share for all bytes
    return normalised((1 - kept) * counts / counts.sum() + kept * before / before.sum(), v)


def word_scores(v: Vocabulary, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The natural log of the marginal of each word and its end."""
    groups = [g.marginal(edge_scores(g, weights)) for g in lattice_groups(v, words)]
    return np.concatenate([np.empty(0), *groups]) + weights[v.size + 1]


def lm_scores(docs: DataFrame, model: str = DEFAULT_MODEL, rescale_steps: int = 1, kept: float = KEPT) -> DataFrame:
    """Score every text under a model learned from the rows that are not held out.

    ``rescale_steps`` is how often the vocabulary's scores are rescaled to the
    training rows, 0 for the scores as they are, and ``kept`` their share in
    each step; a step is one more pass over the distinct training words.
    Returns one row per doc_id: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score.  A null or empty text is its end
    alone.  Rows that repeat a doc_id are scored as one document, with one end
    for each row; rows with a null id are held out and scored together.
    Without training rows the vocabulary's scores are used as they are.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_sentencepiece(model))  # of the size of the vocabulary file
    rows = written(postings(docs), "postings", compression="zstd")
    words = rows.groupBy("word").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("blocks"))
    words = written(words, "words", compression="zstd")
    count = lambda x: F.coalesce(F.sum(x), F.lit(0))
    texts = F.when(F.length("word") == 0, F.col("c"))
    n, v, ends = words.agg(count("c"), F.count_if(F.col("c") > 0), count(texts)).first()
    first = weights = first_weights(shared.value)
    for _ in range(rescale_steps if n > ends else 0):
        weights = rescaled(first, expected_counts(words.where("c > 0"), shared, weights), shared.value, kept)
    end = ends / n if 0 < ends < n else END_SHARE

    def run(batches):
        for batch in batches:
            found = batch.column("word").to_pylist()
            is_end = np.fromiter((not w for w in found), bool, len(found))
            log_p = np.where(is_end, np.log(end), word_scores(shared.value, found, weights) + np.log1p(-end)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "c", "blocks")), pa.array(log_p)], ["word", "c", "blocks", "log_p"])

    scored = written(words.mapInArrow(run, "word binary, c long, blocks long, log_p double"), "scored", compression="zstd")
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    # To the block of each posting, where the sums of its texts are complete.
    back = back_to_rows(rows.select("word", "block", "pairs", "docs"), scored, ["word"], "blocks").drop("word", "blocks")
    entries = back.repartition("block").select(
        "block", F.posexplode("pairs").alias("pos", "pair"), F.when(F.size("docs") > 0, F.col("docs")).alias("docs"), "c", "log_p"
    ).select(
        "block",
        F.shiftrightunsigned("pair", 16).alias("number"),
        F.col("pair").bitwiseAND(COUNT_MAX).cast("long").alias("tf"),
        F.get("docs", F.col("pos")).alias("doc_id"),
        base.alias("base"),
        (F.col("c") > 0).cast("long").alias("known"),
        "log_p",
    )
    texts_of = entries.groupBy("block", "number").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("tf").alias("n_tokens"),
        F.sum(F.col("tf") * F.col("known")).alias("n_known"),
        F.sum(F.col("tf") * F.col("base")).alias("base_score"),
        F.sum(F.col("tf") * F.col("log_p")).alias("score"),
    )
    by_id = texts_of.groupBy("doc_id").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")))
    return by_id.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
