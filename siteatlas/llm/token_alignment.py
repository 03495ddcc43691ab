"""Alignment of two tokenisations of the same texts, by relations over token ends.

Each token is a row, its byte offset a windowed sum of token lengths.  Where
tokens of both sides end at one offset, an equi-join on (text, end) finds a
cut; the running count of cuts numbers the groups; and each stretch between
neighbouring ends of either side is one link, since a token of each side covers
it and two tokens that overlap do so in one such stretch.  So links are the rows
of the full outer join, each with the nearest token of either side that ends
there or later: no pairs are formed to be thrown away, however large a group.

Neither tokeniser has a token across the place between a character that is not
white space and a following space, so texts are taken apart there, and in each
bounded batch of texts a distinct part is tokenised once.  Where tokens end
depends on their lengths alone: parts with the same lengths on both sides have
one shape, and in each batch a distinct shape is aligned once.  A document is a
list of part numbers; its groups and sums come from its parts, whose links are
those of their shape with their own ids.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteatlas.llm.common import bounded_batches, bucketed_table, written
from siteatlas.sources.tables import discard, setting

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text to a batch, whose shapes are aligned once and whose documents are put together at once.
BATCH = 4 << 20
#: So many parts are tokenised as one text, and so many share a row.
SLICE = 4_000
#: Buckets for each shuffle partition, so that a task has one or two batches.
SPREAD = 2
#: Whether a join may use a partitioning by some of its keys.
WHOLE_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
MARKER = "▁"


def byte_of_symbol() -> dict[str, int]:
    """The byte behind each symbol of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Tokeniser:
    """``encode`` gives the ids of a text that starts with a space; ``surface`` has the bytes of each id."""

    encode: Callable[[str], list[int]]
    surface: list[bytes]

    def __post_init__(self):
        self.lengths = np.array([len(s) for s in self.surface], np.int64)
        # Whether no token holds a space after another character that is not white space.
        self.parts_apart = not any(re.search(r"\S ", s.decode("utf-8", "replace")) for s in self.surface)

    def of_parts(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many are each one's: none where its tokens do not spell it.  The parts are tokenised as one text."""
        text = "".join(" " + p for p in some)
        found = self.encode(text)
        ids = np.array(found, np.int32)
        if b"".join(map(self.surface.__getitem__, found)) == text.encode():
            ends = np.cumsum(self.lengths[ids])
            wanted = np.cumsum([1 + len(p.encode()) for p in some])
            cuts = np.searchsorted(ends, wanted) + 1
            if np.array_equal(ends[cuts - 1], wanted):
                return ids, np.diff(cuts, prepend=0)
        if len(some) == 1:
            return ids[:0], np.zeros(1, np.int64)
        half = len(some) // 2
        first, second = self.of_parts(some[:half]), self.of_parts(some[half:])
        return np.append(first[0], second[0]), np.append(first[1], second[1])


# Fixed value: where a byte-level BPE is cut before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache
def byte_level(path: str) -> Tokeniser:
    """A byte-level BPE of a file of the ``tokenizers`` library; special tokens are plain text.

    Where the file's ids are in the order of its merges, they are the ranks with
    which ``tiktoken`` gives the same ids in less time.
    """
    import json

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    symbol = byte_of_symbol()
    ids: dict[str, int] = file["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    surface = [b""] * (1 + max([*ids.values(), *(t["id"] for t in file["added_tokens"])]))
    for token, i in ids.items():
        surface[i] = bytes(symbol[c] for c in token)
    cut = file["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not file["normalizer"]
    if plain and all(ids[a + b] == 256 + k for k, (a, b) in enumerate(merges)):
        import tiktoken

        model = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks={surface[i]: i for i in ids.values()}, special_tokens={})
        return Tokeniser(model.encode_ordinary, surface)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return Tokeniser(lambda text: model.encode(text, add_special_tokens=False).ids, surface)


@functools.lru_cache
def sentence_pieces(path: str) -> Tokeniser:
    """A SentencePiece model that adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    surface = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(MARKER, " ").encode()
        for i in range(model.get_piece_size())
    ]
    space = [model.piece_to_id(MARKER)]  # the model adds no space to an empty text
    return Tokeniser(lambda text: model.encode(text[1:]) or space, surface)


LOADERS = {"byte_level": byte_level, "sentence_pieces": sentence_pieces}


def parts(text: str) -> list[str]:
    """``text`` taken apart at the spaces that follow a character other than white space; those spaces are left out."""
    found = text.split(" ")
    if "" not in found and not any(p[-1].isspace() for p in found):
        return found
    joined: list[str] = []
    open_ = False
    for p in found:
        if open_:
            joined[-1] += " " + p
        else:
            joined.append(p)
        open_ = not p or p[-1].isspace()
    return joined


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """``values`` as consecutive lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32)))


def shapes_of(a_lengths: np.ndarray, a_sizes: np.ndarray, b_lengths: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[bytes, bytes]]]:
    """The shape of each part, and the lengths of both sides' tokens (as 32-bit numbers) of each shape; ``*_sizes`` count a part's tokens."""
    number: dict[tuple[bytes, bytes], int] = {}
    a, b = (x.astype(np.int32).tobytes() for x in (a_lengths, b_lengths))
    a_at, b_at = ((4 * np.append(0, np.cumsum(n))).tolist() for n in (a_sizes, b_sizes))
    bounds = zip(a_at, a_at[1:], b_at, b_at[1:])  # noqa: B905
    found = [number.setdefault((a[i:j], b[k:m]), len(number)) for i, j, k, m in bounds]
    return np.array(found, np.int32), list(number)


def cut_texts(docs: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """A table with three sorts of rows, in buckets of their batch: documents (batch, doc_id, parts), slices of distinct parts, and shapes.

    A slice has its batch, ``slice`` (its number within it) and of each part, in
    order, the shape and ``uses`` (how often texts with tokens hold it);
    ``a_ids`` and ``b_ids`` are those of all its parts.  A shape has its batch,
    ``part`` (its number within it) and the lengths of its tokens in ``a_ids``
    and ``b_ids``.  A text without tokens has no parts.  A task writes a file
    for each batch at most.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        sides = [LOADERS[kind](path) for kind, path in (a, b)]
        apart = all(s.parts_apart for s in sides)
        number_of_batch = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text")
            number: dict[str, int] = {}
            held = []
            for i in range(len(texts)):
                t = texts[i].as_py()
                found = [] if not t else parts(t) if apart else [t]
                held.append(np.fromiter((number.setdefault(p, len(number)) for p in found), np.int32, len(found)))
            names = list(number)
            del number
            ids, sizes = [], []
            for s in sides:
                pieces = [s.of_parts(names[at : at + SLICE]) for at in range(0, len(names), SLICE)]
                ids.append(np.concatenate([np.empty(0, np.int32), *(x for x, _ in pieces)]))
                sizes.append(np.concatenate([np.empty(0, np.int64), *(n for _, n in pieces)]))
            del names
            bad = (sizes[0] == 0) | (sizes[1] == 0)
            if bad.any():  # texts with such a part have no tokens
                held = [x[:0] if bad[x].any() else x for x in held]
            flat = np.concatenate([*held, np.empty(0, np.int32)])
            uses = np.bincount(flat, minlength=len(bad))
            used = uses > 0
            if not used.all():
                ids = [x[np.repeat(used, n)] for x, n in zip(ids, sizes, strict=True)]
                sizes = [n[used] for n in sizes]
                flat = (np.cumsum(used) - 1)[flat]
                uses = uses[used]
            of, shapes = shapes_of(sides[0].lengths[ids[0]], sizes[0], sides[1].lengths[ids[1]], sizes[1])
            first = np.arange(0, len(of), SLICE)
            n, k, m = len(held), len(first), len(shapes)

            def of_slices_and_shapes(side):
                in_slice = np.add.reduceat(sizes[side], first) if k else first
                in_shape = np.array([len(x[side]) // 4 for x in shapes], np.int64)
                values = np.append(ids[side], np.frombuffer(b"".join(x[side] for x in shapes), np.int32))
                return pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), lists(values, np.append(in_slice, in_shape))])

            def of_slices(values):
                return pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), lists(values, np.diff(np.append(first, len(of)))), pa.nulls(m, pa.list_(pa.int32()))])

            numbers = lists(flat, np.array([len(x) for x in held], np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + k + m, number_of_batch)),
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(k + m, batch.column("doc_id").type)]),
                    pa.concat_arrays([numbers, pa.nulls(k + m, numbers.type)]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(k), pa.int32()), pa.nulls(m, pa.int32())]),
                    of_slices(of),
                    of_slices(uses),
                    pa.concat_arrays([pa.nulls(n + k, pa.int32()), pa.array(np.arange(m), pa.int32())]),
                    of_slices_and_shapes(0),
                    of_slices_and_shapes(1),
                ],
                ["batch", "doc_id", "parts", "slice", "shapes", "uses", "part", "a_ids", "b_ids"],
            )
            number_of_batch += 1
        pa.default_memory_pool().release_unused()

    of_slices = "slice int, shapes array<int>, uses array<int>"
    schema = f"batch long, doc_id {kind}, parts array<int>, {of_slices}, part int, a_ids array<int>, b_ids array<int>"
    return bucketed_table(docs.mapInArrow(run, schema), "parts", ["batch"], spread=SPREAD)


#: What a text is known by in an alignment: a shape of a batch.
UNIT = ["part", "batch"]


def token_ends(units: DataFrame, side: str, lengths: DataFrame) -> DataFrame:
    """(part, batch, end, <side>_own): every token of one side and the byte offset at which it ends."""
    tokens = units.select(*UNIT, F.posexplode(f"{side}_ids").alias("pos", f"{side}_own"))
    upto = Window.partitionBy(*UNIT).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = tokens.join(F.broadcast(lengths.withColumnRenamed("id", f"{side}_own")), f"{side}_own")
    return sized.select(*UNIT, F.sum("length").over(upto).alias("end"), f"{side}_own")


def aligned(units: DataFrame, a_lengths: DataFrame, b_lengths: DataFrame) -> DataFrame:
    """The links of every text: one row for each pair of overlapping tokens.

    ``units`` has part and batch, which name a text, a_ids and b_ids, whose
    tokens cover the same bytes; ``*_lengths`` (id, length) are vocabularies,
    which bound what is broadcast.  Returns part, batch, end (of the stretch
    that both tokens cover), a_id, b_id, group (numbered from the end of the
    text, from 1), and a_own and b_own: the id where the token ends here, else
    null.
    """
    return linked(all_ends(units, a_lengths, b_lengths))


def all_ends(units: DataFrame, a_lengths: DataFrame, b_lengths: DataFrame) -> DataFrame:
    """(part, batch, end, a_own, b_own): every offset at which a token of either side ends."""
    return token_ends(units, "a", a_lengths).join(token_ends(units, "b", b_lengths), [*UNIT, "end"], "full_outer")


def linked(ends: DataFrame) -> DataFrame:
    """The links of :func:`aligned`: each end with the nearest token of either side that ends there or later."""
    from_end = Window.partitionBy(*UNIT).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.col("a_own").isNotNull() & F.col("b_own").isNotNull()
    return ends.select(
        *UNIT,
        "end",
        F.last("a_own", ignorenulls=True).over(from_end).alias("a_id"),
        F.last("b_own", ignorenulls=True).over(from_end).alias("b_id"),
        F.count_if(cut).over(from_end).cast("int").alias("group"),
        "a_own",
        "b_own",
    )


def by_text(links: DataFrame) -> DataFrame:
    """(part, batch, links): one row for each text of ``aligned``, its links in text order: of each where it ends, and in two bits whether a token of either side ends there."""
    code = F.shiftleft(F.col("end").cast("long"), 2) + F.col("a_own").isNotNull().cast("long") * 2 + F.col("b_own").isNotNull().cast("long")
    return links.groupBy(*UNIT).agg(F.sort_array(F.collect_list(code)).alias("links"))


#: A pair of ids as one number.
ID_BITS = 17


def numbers_in(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column of lists, one list after the other."""
    return np.concatenate([np.empty(0, np.int64), *(np.asarray(c.flatten()) for c in column.chunks)])


def sizes_in(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.asarray(c.value_lengths(), np.int64) for c in column.chunks)])


class Links:
    """The links of all parts of a batch: those of their shapes with the parts' own ids.

    ``own_a`` and ``own_b``: whether a token of that side ends there; ``sizes``:
    links of each part; ``pair``: both ids as one number.
    """

    def __init__(self, slices: pa.Table, shapes: pa.Table):
        slices, shapes = slices.sort_by("slice"), shapes.sort_by("part")
        of_shape = sizes_in(shapes["links"])
        shape = numbers_in(slices["shapes"]).astype(np.int64)
        self.uses = numbers_in(slices["uses"])
        self.sizes = of_shape[shape]
        self.upto = np.append(0, np.cumsum(self.sizes))
        at = np.repeat((np.cumsum(of_shape) - of_shape)[shape] - self.upto[:-1], self.sizes) + np.arange(self.upto[-1])
        ends = numbers_in(shapes["links"])[at].astype(np.int8)
        self.own_a, self.own_b = ends >> 1 & 1, ends & 1
        # A part ends with tokens of both sides, so the tokens that ended before name the next one over all parts.
        self.a, self.b = numbers_in(slices["a_ids"]).astype(np.int64), numbers_in(slices["b_ids"]).astype(np.int64)
        a_at, b_at = (np.cumsum(own, dtype=np.int64) - own for own in (self.own_a, self.own_b))
        self.pair = self.a[a_at] << ID_BITS | self.b[b_at]

    def added(self, numbers: np.ndarray) -> np.ndarray:
        """``numbers`` of links summed for each part."""
        sums = np.append(0, np.cumsum(numbers, dtype=np.int64))
        return sums[self.upto[1:]] - sums[self.upto[:-1]]

    def groups(self) -> pa.StringArray:
        """The ids of each part's groups, ``a1,a2|b1;a3|b2,b3;``."""
        cut = self.own_a & self.own_b
        group = np.cumsum(cut, dtype=np.int64) - cut
        a_group, b_group = group[self.own_a > 0], group[self.own_b > 0]
        side = np.append(2 * a_group, 2 * b_group + 1)
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.append(self.a, self.b)[order]
        last = np.append(side[1:] != side[:-1], True)[: len(side)]
        tokens = rendered(1 << ID_BITS).take(pa.array(np.where(last, 1 + (side & 1), 0) << ID_BITS | ids))
        return merged(tokens, self.added(self.own_a) + self.added(self.own_b))


@functools.lru_cache
def rendered(n: int) -> pa.StringArray:
    """Every number below n with a comma, then every one with a bar, then with a semicolon."""
    return pa.array([f"{k}{end}" for end in ",|;" for k in range(n)], pa.string())


def merged(strings: pa.StringArray, sizes: np.ndarray) -> pa.StringArray:
    """Consecutive strings joined, so many to one as ``sizes`` says."""
    if not len(strings):
        return pa.array([""] * len(sizes), pa.string())
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets[np.append(0, np.cumsum(sizes))]), data)


def pair_counts(slices: DataFrame, shapes: DataFrame) -> DataFrame:
    """(batch, a_id, b_id, n): how often texts of a batch hold an id pair linked."""

    def count(slices: pa.Table, shapes: pa.Table) -> pa.Table:
        links = Links(slices, shapes)
        pair, of = np.unique(links.pair, return_inverse=True)
        n = np.bincount(of, np.repeat(links.uses, links.sizes), minlength=len(pair)).astype(np.int64)  # below 2^53, so exact
        batch = np.full(len(pair), slices["batch"][0].as_py() if slices.num_rows else 0, np.int64)
        a_id, b_id = (pair >> ID_BITS).astype(np.int32), (pair & ((1 << ID_BITS) - 1)).astype(np.int32)
        return pa.table({"batch": batch, "a_id": a_id, "b_id": b_id, "n": n})

    schema = "batch long, a_id int, b_id int, n long"
    return slices.groupBy("batch").cogroup(shapes.groupBy("batch")).applyInArrow(count, schema)


def per_document(table: DataFrame, known: DataFrame) -> DataFrame:
    """The documents of each batch from its parts: sums of numbers, and the parts' groups in order.

    ``table`` as :func:`cut_texts` gives it, documents and slices; ``known`` has
    the batch's shapes with their links, and its id pairs with n and best.  Both
    sides lie in buckets of their batch, which is bounded.
    """
    kind = table.schema["doc_id"].dataType.simpleString()

    def assemble(own: pa.Table, known: pa.Table) -> pa.Table:
        docs, slices = own.filter(pc.is_null(own["slice"])), own.filter(pc.is_valid(own["slice"]))
        links = Links(slices, known.filter(pc.is_valid(known["part"])).select(["part", "links"]))
        pairs = known.filter(pc.is_valid(known["a_id"])).select(["a_id", "b_id", "n", "best"])
        pair = np.asarray(pairs["a_id"], np.int64) << ID_BITS | np.asarray(pairs["b_id"], np.int64)
        order = np.argsort(pair)
        at = order[np.searchsorted(pair[order], links.pair)] if len(pair) else np.empty(0, np.int64)
        of = {"n_a": links.added(links.own_a), "n_b": links.added(links.own_b), "n_groups": links.added(links.own_a & links.own_b), "n_links": links.sizes}
        of |= {"n_best": links.added(np.asarray(pairs["best"], np.int64)[at]), "count_sum": links.added(np.asarray(pairs["n"], np.int64)[at])}
        held, sizes = numbers_in(docs["parts"]).astype(np.int64), sizes_in(docs["parts"])
        edges = np.append(0, np.cumsum(sizes))
        columns = {"doc_id": docs["doc_id"]}
        for n, numbers in of.items():
            sums = np.append(0, np.cumsum(numbers[held])).astype(np.int64)
            columns[n] = pa.array(sums[edges[1:]] - sums[edges[:-1]])
        columns["groups"] = pc.ascii_rtrim(merged(links.groups().take(pa.array(held)), sizes), ";")
        return pa.table(columns)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return table.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(assemble, schema)


def lengths_of(spark: SparkSession, tokeniser: Tokeniser) -> DataFrame:
    """(id, length): every length of a token of a vocabulary, which is its own id."""
    return spark.createDataFrame([(n, n) for n in np.unique(tokeniser.lengths).tolist()], "id int, length int")


def align_tokens(
    docs: DataFrame,
    a: tuple[str, str] = ("byte_level", BYTE_LEVEL),
    b: tuple[str, str] = ("sentence_pieces", PIECES),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups and links of the tokens of two tokenisers over every text, each text with a space before it.

    ``a`` and ``b`` are (loader, path).  Returns one row per input row, repeated
    rows and null ids too: doc_id, n_a, n_b, n_groups, n_links (overlapping
    token pairs), n_best (links whose id pair is linked as often, corpus-wide,
    as any with this B id), count_sum (over the links, how often their id pair is
    linked), all long, and groups (``a1,a2|b1;a3|b2,b3``).  A text that is null or
    empty, or that either side's tokens do not spell, has no tokens: zeros and
    an empty ``groups``.  An empty table gives an empty result; further columns
    are not read.  A batch of texts is bounded, and so is all that one row or
    task holds, but for a single text beyond that bound.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=20_000, size=BATCH)
    a_lengths, b_lengths = (lengths_of(spark, LOADERS[kind](path)) for kind, path in (a, b))
    table = cut_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), a, b)
    # Rows of a batch are together, so they may be joined by more than their batch where they are.
    with setting(spark, WHOLE_KEYS, "false"):
        # An outer join does not tell that its rows are still together; a table in buckets does.
        units = table.where(F.col("part").isNotNull()).select(*UNIT, "a_ids", "b_ids")
        ends = bucketed_table(all_ends(units, a_lengths, b_lengths), "ends", ["batch"], spread=SPREAD)
        shapes = bucketed_table(by_text(linked(ends)), "shapes", ["batch"], spread=SPREAD)
        discard(ends)
    slices = table.where(F.col("slice").isNotNull()).select("batch", "slice", "shapes", "uses", "a_ids", "b_ids")
    used = written(pair_counts(slices, shapes), "used")
    counts = written(used.groupBy("a_id", "b_id").agg(F.sum("n").alias("n")), "counts")
    best = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    pairs = written(counts.join(best, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "pairs")
    known = used.drop("n").join(pairs, ["a_id", "b_id"]).select("batch", "a_id", "b_id", "n", "best")
    texts = table.where(F.col("part").isNull()).select("batch", "doc_id", "parts", "slice", "shapes", "uses", "a_ids", "b_ids")
    return per_document(texts, shapes.unionByName(known, allowMissingColumns=True))


def alignment_digest(found: DataFrame) -> DataFrame:
    """``align_tokens`` with groups_sha256 (lowercase hex, empty without tokens) in place of ``groups``."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.withColumn("groups_sha256", digest).drop("groups")
