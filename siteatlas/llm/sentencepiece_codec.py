"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is taken as a space, for the whitespace marker, then the text.  Where no
piece crosses a word's start, the best segmentation of a text is that of its
chunks, so each worker segments a chunk once and keeps it; the chunks that a
batch brings anew are segmented together.  What a worker keeps is bounded by
``CACHE`` chunks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import bounded_batches, utf8
from siteatlas.llm.lattice import Lattices, Vocabulary, in_groups, load_sentencepiece

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 300_000
WORDS = re.compile(rb" *[^ \n]+| +|\n")
SPACES_ONLY = re.compile(rb" *[^ ]+| +")


class Encoder:
    """Encodes batches of texts and remembers chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        v = vocabulary
        self.chunks = WORDS.findall if v.cut_spaces and v.cut_lines else SPACES_ONLY.findall if v.cut_spaces else lambda t: [t]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(0, np.int32)
        self.counts = np.empty(0, np.int64)

    def learn(self, new: list[bytes]) -> None:
        found = [Lattices(self.vocabulary, g).best() for g in in_groups(new)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.counts = np.concatenate([self.counts, *(counts for _, counts in found)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has."""
        if len(self.known) > CACHE:
            self.forget()
        split = [self.chunks(b" " + t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(sorted(new))
        find = self.known.__getitem__
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        chunk = np.fromiter((find(c) for s in split for c in s), np.int64, int(sizes.sum()))
        n = self.counts[chunk]
        begin = (np.cumsum(self.counts) - self.counts)[chunk]
        ids = self.ids[np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        upto = np.append(0, np.cumsum(n))
        edges = np.append(0, np.cumsum(sizes))
        return ids, np.diff(upto[edges])

    def decode(self, ids: list[int]) -> bytes:
        """The text of a sequence of ids: byte pieces as bytes, markers as spaces, without the first."""
        text = b"".join(map(self.vocabulary.surface.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, and whether they decode to it.

    Returns one row per input row: doc_id, n_tokens, n_byte_tokens, token_ids,
    decoded_sha256 (lowercase hex, of the decoded text in UTF-8) and
    round_trip.  A null or empty text has no tokens and decodes to the empty
    text.  Characters without a piece, a literal whitespace marker among them,
    are spelled in byte pieces, so every text round-trips.  Of segmentations
    with equal scores the first found is taken.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load_sentencepiece(model))  # of the size of the vocabulary file

    def run(batches):
        import hashlib

        encoder = Encoder(shared.value)
        is_byte = np.zeros(encoder.vocabulary.size, dtype=bool)
        is_byte[encoder.vocabulary.byte_ids] = True
        for batch in batches:
            texts = utf8(batch, "text")
            ids, counts = encoder.encode(texts)
            edges = np.append(0, np.cumsum(counts))
            as_list = ids.tolist()
            decoded = [encoder.decode(as_list[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            spelled = np.diff(np.append(0, np.cumsum(is_byte[ids]))[edges])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(spelled, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded]),
                    pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "n_byte_tokens", "token_ids", "decoded_sha256", "round_trip"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, n_tokens long, n_byte_tokens long, token_ids array<int>, decoded_sha256 string, round_trip boolean",
    )


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of rows with doc_id and token_ids; null ids decode to the empty text."""
    spark = encoded.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load_sentencepiece(model))

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [encoder.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, text string")
