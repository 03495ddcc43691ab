"""Toxicity: a linear classifier of words, held to equal scores when identity terms are swapped.

Words are counted by label over a bounded sample of labelled training rows, the
most telling ones become features, and a logistic regression is fitted on the
sample by accelerated proximal gradient.  For each labelled text that mentions
a group, the text with every identity term replaced by the next of its group is
made as well, and the squared change of the logit is part of the loss, so a
mention by itself carries no weight.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import bounded_batches, utf8
from siteatlas.llm.decontamination import words

# Interchangeable identity terms, one group a line.
IDENTITY_GROUPS = [
    "women men",
    "woman man",
    "girls boys",
    "muslim christian jewish hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists",
    "black white asian latino arab",
    "gay straight lesbian bisexual transgender",
    "immigrants refugees foreigners natives",
    "immigrant refugee foreigner native",
    "femmes hommes",
    "femme homme",
    "musulman chrétien juif",
    "noir blanc arabe",
    "frauen männer",
    "frau mann",
    "muslime christen juden",
    "mujeres hombres",
    "mujer hombre",
    "musulmán cristiano judío",
    "negro blanco árabe",
]
SWAP = {
    a.encode(): b.encode()
    for group in map(str.split, IDENTITY_GROUPS)
    for a, b in zip(group, group[1:] + group[:1], strict=True)
}


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: bytes) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & set(words(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by ``folds``; null ids are held out too."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled training rows, chosen by a hash of their ids."""
    label = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = label.where(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows small rows
    rows = docs.select(F.col("doc_id"), F.col("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def count_words(sample: DataFrame) -> DataFrame:
    """(word, n0, n1): texts of either label that have the word; the word "" counts all texts."""

    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for text, y in zip(utf8(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
                counts[y].update({b"", *words(text)})
            found = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), *(pa.array([c[w] for w in found], pa.int64()) for c in counts)],
                ["word", "n0", "n1"],
            )

    partial = sample.where("toxic in (0, 1)").mapInArrow(run, "word binary, n0 long, n1 long")
    return partial.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def choose_features(counts: DataFrame, all0: int, all1: int, features: int, min_texts: int) -> list[bytes]:
    """The words whose share of texts differs most between labels, by chi-square, then by word."""
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    c, d = F.lit(float(all1)) - a, F.lit(float(all0)) - b
    chi = (all0 + all1) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * all0 * all1)
    best = (
        counts.where((F.length("word") > 0) & (a + b >= min_texts) & (c + d > 0))
        .orderBy(F.round(chi, 6).desc(), "word")
        .limit(features)
    )
    return [bytes(r["word"]) for r in best.select("word").collect()]


def encoded_sample(sample: DataFrame, features: list[bytes]) -> list:
    """(toxic, features, features after the swap) of each text; at most ``max_rows`` short rows."""
    index = {w: i for i, w in enumerate(features)}

    def run(batches):
        ints = pa.list_(pa.int32())
        for batch in batches:
            here, swapped = [], []
            for text in utf8(batch, "text"):
                w = set(words(text))
                here.append(sorted(index[x] for x in w if x in index))
                other = {SWAP.get(x, x) for x in w}
                swapped.append(sorted(index[x] for x in other if x in index) if other != w else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(here, ints), pa.array(swapped, ints)], ["toxic", "here", "swapped"]
            )

    rows = sample.where("toxic in (0, 1)").mapInArrow(run, "toxic int, here array<int>, swapped array<int>")
    return rows.groupBy("toxic", "here", "swapped").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "here", "swapped").collect()


class Rows:
    """Sparse rows of ones, for products either way."""

    def __init__(self, rows: list[list[int]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((x for r in rows for x in r), np.int64, len(self.row))
        self.shape = (len(rows), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, v[self.row], self.shape[1])


def fit(rows: list, width: int, swap_weight: float, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """FISTA on log loss + swap_weight * mean squared logit change + l2/2 |w|^2 + l1 |w|; both labels weigh the same."""
    x = Rows([r["here"] for r in rows], width)
    y = np.array([r["toxic"] for r in rows], dtype=float)
    n = np.array([r["n"] for r in rows], dtype=float)
    n /= 2 * np.where(y == 1, n[y == 1].sum(), n[y == 0].sum())
    pairs = [r for r in rows if r["swapped"] is not None]
    before, after = (Rows([r[k] for r in pairs], width) for k in ("here", "swapped"))
    m = np.array([r["n"] for r in pairs], dtype=float)
    m = m / m.sum() if len(m) else m
    # A bound of the curvature for each weight: for rows of ones, X'NX is at most diag(X'N X1).
    curve = 0.25 * x.back(n * (x.dot(np.ones(width)) + 1)) + l2 + 1e-12
    if pairs:
        moved = 2 * swap_weight * m * (before.dot(np.ones(width)) + after.dot(np.ones(width)))
        curve += before.back(moved) + after.back(moved)
    rate, bias_rate = 1 / curve, 4 / (1 + n @ x.dot(np.ones(width)))
    w, b = np.zeros(width), float(np.log(max(n @ y, 1e-6) / max(1 - n @ y, 1e-6)))
    w0, b0, t = w, b, 1.0
    at, bias = w, b
    for _ in range(steps):
        r = n * (1 / (1 + np.exp(-(x.dot(at) + bias))) - y)
        grad = x.back(r) + l2 * at
        if pairs:
            change = 2 * swap_weight * m * (before.dot(at) - after.dot(at))
            grad += before.back(change) - after.back(change)
        w = at - rate * grad
        w, b = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0), bias - bias_rate * r.sum()
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, bias = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        w0, b0, t = w, b, t1
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    features: int = 1_000,
    min_texts: int = 3,
    swap_weight: float = 1.0,
    sparsity: float = 0.0125,
    l2: float = 1e-5,
    steps: int = 600,
) -> Model:
    """Fit on at most ``max_rows`` labelled rows whose id is not held out.

    The bound keeps the fit the same size whatever the input.  Without any
    label the model scores every text 0.5; with labels of one kind only it
    gives their share.  The l1 weight is ``sparsity`` over the root of the
    number of rows.  Of labels that repeat a doc_id the largest counts.
    """
    bounded_batches(docs.sparkSession)
    sample = training_sample(docs, labels, max_rows)
    counts = count_words(sample).persist()
    try:
        all_ = counts.where(F.length("word") == 0).first()
        if all_ is None:
            return Model({}, 0.0)
        n0, n1 = all_["n0"], all_["n1"]
        if not n0 or not n1:
            return Model({}, float(np.log((n1 + 0.5) / (n0 + 0.5))))
        chosen = choose_features(counts, n0, n1, features, min_texts)
    finally:
        counts.unpersist()
    chosen = sorted({*chosen, *SWAP})
    l1 = sparsity / (n0 + n1) ** 0.5
    w, b = fit(encoded_sample(sample, chosen), len(chosen), swap_weight, l1, l2, steps)
    return Model({word: float(v) for word, v in zip(chosen, w, strict=True) if v}, b)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """Score every text for toxicity.

    Returns one row per input row: doc_id, held_out, score (0 to 1; higher:
    toxic likelier) and predicted (1 if score >= ``threshold``).  A score
    depends on the text alone; null and empty texts have no words and get the
    score of the bias.  Rows with a null id are scored and count as held out.
    Repeated rows get equal scores; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, **how))  # at most ``features`` words and the swaps
    bounded_batches(spark)

    def run(batches):
        for batch in batches:
            scores = [model.value.score(t) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` without the texts that score at or over ``threshold``; columns as given.

    The score is taken where the row is, so nothing is exchanged.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, **how))
    bounded_batches(spark)

    def run(batches):
        for batch in batches:
            keep = [model.value.score(t) < threshold for t in utf8(batch, "text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
