"""Exact top-k search by inner product over vectors sorted by length, with bounds on rotated partial sums.

Vectors are held in blocks in order of descending length, and so are queries.
Against a block of candidates, a query's k-th best score so far rules out, by
Cauchy-Schwarz, first the whole block (its longest vector), then single vectors
(their length), then vectors whose first rotated coordinates plus the product
of what is left of both lengths stay below it.  The rotation is that of the
singular vectors of all vectors, so the first coordinates hold most of the
length; being orthonormal it changes no product, and every bound is widened by
far more than rounding.  What is left is scored exactly, in integers.

Rounds take more and more blocks: the first takes the longest vectors only and
sets the k-th best scores that let later rounds skip.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.common import bounded_batches, written

#: Vectors to a block of candidates, and to a block of queries.
BLOCK = 4096
QUERY_BLOCK = 512
#: How many times the blocks seen so far a round takes.
GROWTH = 16
#: Shares of the coordinates after which vectors are ruled out.
STEPS = (0.25, 0.5)
#: Bounds are widened by this share of the product of the lengths, far above the rounding of doubles.
SLACK = 1e-9
#: Doubles add integers up to it exactly.
EXACT = float(1 << 53)

FOUND_SCHEMA = "query_row long, query_id long, row long, id long, score long"
BLOCK_SCHEMA = "block long, longest double, need double, row binary, id binary, norm binary, floor binary, vector binary, kind string"


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return embedding.isNotNull() & F.coalesce(F.forall(embedding, finite), F.lit(False))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows of 64-bit integers; shorter ones are filled with zeros."""
    column = batch.column("vector")
    flat = np.asarray(column.flatten(), dtype=np.int64)
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((batch.num_rows, width), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from their second moments, which are summed before they reach the driver."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch, width).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "v": total.ravel()})

    summed = vectors.select("vector").mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    m = np.zeros((width, width))
    for i, j, v in summed.collect():  # width * width numbers
        m[i, j] = v
    _, vectors_ = np.linalg.eigh(m)
    return vectors_[:, ::-1]


def narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    top = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    return m.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def in_blocks(vectors: DataFrame, size: int, width: int, by: str, name: str) -> DataFrame:
    """A written table of blocks of ``size`` vectors at most, by descending ``by`` (norm, or need).

    ``vectors`` has row, id, vector, norm, floor and need; ``longest`` is the
    greatest norm of a block and ``need`` its least need.  Equal keys are parted
    by row, so many copies of a vector fill many blocks.
    """
    ordered = vectors.repartitionByRange(F.desc(by), "row").sortWithinPartitions(F.desc(by), "row")

    def block(number: int, rows: pa.Table) -> pa.RecordBatch:
        batch = rows.combine_chunks().to_batches()[0]
        as_bytes = lambda c, t: np.asarray(batch.column(c), dtype=t).tobytes()
        m = narrow(matrix(batch, width))
        return pa.RecordBatch.from_pydict(
            {
                "block": [number],
                "longest": [float(np.max(batch.column("norm")))],
                "need": [float(np.min(batch.column("need")))],
                "row": [as_bytes("row", np.int64)],
                "id": [as_bytes("id", np.int64)],
                "norm": [as_bytes("norm", np.float64)],
                "floor": [as_bytes("floor", np.float64)],
                "vector": [m.tobytes()],
                "kind": [m.dtype.str],
            }
        )

    def pack(batches):
        number = TaskContext.get().partitionId() << 33
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            while held >= size:
                rows = pa.Table.from_batches(waiting)
                yield block(number, rows.slice(0, size))
                waiting = rows.slice(size).to_batches()
                number, held = number + 1, held - size
        if held:
            yield block(number, pa.Table.from_batches(waiting))

    return written(ordered.mapInArrow(pack, BLOCK_SCHEMA), name)


class Block:
    """Vectors of a block row: integers, lengths, rotated coordinates and what is left of the length after each step."""

    def __init__(self, row: dict, width: int, turn: np.ndarray):
        self.row = np.frombuffer(row["row"], dtype=np.int64)
        self.id = np.frombuffer(row["id"], dtype=np.int64)
        self.norm = np.frombuffer(row["norm"], dtype=np.float64)
        self.floor = np.frombuffer(row["floor"], dtype=np.float64)
        self.exact = np.frombuffer(row["vector"], dtype=row["kind"]).reshape(len(self.row), width).astype(np.int64)
        self.plain = self.exact.astype(np.float64)
        self.turned = self.plain @ turn
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.cuts = sorted({min(width, max(1, round(s * width))) for s in STEPS})
        self.left = {c: np.sqrt(squares[:, c]) if c < width else np.zeros(len(self.row)) for c in self.cuts}


def products(q: Block, x: Block, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The exact products of pairs of rows."""
    a, b = pairs
    if float(q.norm.max(initial=0)) * float(x.norm.max(initial=0)) < EXACT:
        if len(a) * 8 > len(q.row) * len(x.row):  # most pairs: all at once
            return (q.plain @ x.plain.T)[a, b].astype(np.int64)
        return np.einsum("ij,ij->i", q.plain[a], x.plain[b]).astype(np.int64)
    return np.einsum("ij,ij->i", q.exact[a], x.exact[b])


def best_of(q: Block, x: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the pairs that may be among the k best of a query, k for each query at most."""
    floor = q.floor
    slack = SLACK * np.outer(q.norm, x.norm) + SLACK
    may = np.outer(q.norm, x.norm) + slack >= floor[:, None]
    may &= q.row[:, None] != x.row[None, :]
    some = np.flatnonzero(may.any(axis=1))
    last, partial = 0, np.zeros((len(some), len(x.row)))
    for cut in q.cuts:
        if not len(some):
            break
        partial += q.turned[some, last:cut] @ x.turned[:, last:cut].T
        may[some] &= partial + np.outer(q.left[cut][some], x.left[cut]) + slack[some] >= floor[some, None]
        last = cut
    a, b = np.nonzero(may)
    score = products(q, x, (a, b))
    keep = score >= floor[a]
    a, b, score = a[keep], b[keep], score[keep]
    order = np.lexsort((b, x.id[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    return a[nth < k], b[nth < k], score[nth < k]


def scored(pairs: DataFrame, width: int, turn: np.ndarray, k: int) -> DataFrame:
    """(query_row, query_id, row, id, score): for each pair of blocks (q, x) the best candidates of each query."""
    shared = pairs.sparkSession.sparkContext.broadcast(turn)  # width * width numbers

    def run(batches):
        last, x = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if last != row["x"]["block"]:
                    last, x = row["x"]["block"], Block(row["x"], width, shared.value)
                q = Block(row["q"], width, shared.value)
                a, b, score = best_of(q, x, k)
                yield pa.RecordBatch.from_pydict({"query_row": q.row[a], "query_id": q.id[a], "row": x.row[b], "id": x.id[b], "score": score})

    return pairs.select("q", "x").mapInArrow(run, FOUND_SCHEMA)


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank; ties to the smaller id."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_floor(queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The queries with their k-th best score (minus infinity for fewer) and the least length that can reach it."""
    kth = best.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    rows = queries.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return rows.withColumn("need", F.when(F.col("floor") > 0, F.col("floor") / F.col("norm")).otherwise(0.0))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """For every query row the ``k`` other rows with the greatest integer inner product (all, if fewer).

    Components are taken as floor(scale * x); ``is_query`` is a condition on the
    rows of ``vectors``.  Returns query_id, rank (int, from 1), vec_id and score
    (long): ties go to the smaller id.  Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part; shorter vectors
    count as filled with zeros, an empty one as all zeros.  Rows that repeat are
    rows of their own: each is a candidate for the others, and each repeated
    query row has its own ranks.  Without usable vectors, and for an empty
    table, the result is empty; further columns are not read but by
    ``is_query``.  Products must fit 64 bits.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=BLOCK)
    chosen = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = chosen.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        quantised(F.col(vector_col), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    square = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    table = written(rows.withColumn("norm", F.sqrt(square)), "vectors")
    width = table.agg(F.max(F.size("vector"))).first()[0] or 1
    turn = rotation(table, width)
    size = max(64, min(BLOCK, (32 << 20) // (8 * width)))
    plain = table.select("row", "id", "vector", "norm")
    blocks = in_blocks(plain.withColumns({"floor": F.lit(0.0), "need": F.lit(0.0)}), size, width, "norm", "blocks")
    queries = table.where("query").select("row", "id", "vector", "norm")
    # One small row for each block; they are numbered together.
    order = written(blocks.select(F.col("block").alias("x_block"), "longest", (F.row_number().over(Window.orderBy("block")) - 1).alias("nth")), "order")
    n_blocks = order.count()
    best = spark.createDataFrame([], f"{FOUND_SCHEMA}, rank int")
    done = 0
    while done < n_blocks:
        upto = min(n_blocks, max(1, done * GROWTH))
        asked = in_blocks(with_floor(queries, best, k), QUERY_BLOCK, width, "need", "queries")
        numbers = asked.select(F.col("block").alias("q_block"), "need", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))).alias("nth"))
        meets = numbers.join(order, "nth").where(F.col("longest") * (1 + SLACK) >= F.col("need")).select("q_block", "x_block")
        pairs = meets.join(asked.select(F.col("block").alias("q_block"), F.struct(*asked.columns).alias("q")), "q_block").join(
            blocks.select(F.col("block").alias("x_block"), F.struct(*blocks.columns).alias("x")), "x_block"
        )
        found = written(scored(pairs, width, turn, k), "found")
        best = written(best_rows(best.drop("rank").unionByName(found), k), "best")
        done = upto
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
