"""Substring deduplication: MinHash bands over paragraphs, exact Jaccard, components of what collides.

Each line of ``MIN_WORDS`` words or more is a paragraph.  A repeated passage may
start and end inside a line, so there are paragraphs besides, which overlap the
lines: such a line, and what lies between such lines, is cut where a pair of
words has the least hash among its neighbours.  The cuts inside a passage
depend on the passage alone, and one of 50 words or more has whole paragraphs
between them, wherever it stands; a piece too short is joined to the next.

Paragraphs with equal words are one class.  Its MinHash sketch are its least
shingle hashes, and each of them is a band.  Of n shingles n - ceil(0.8 n) + 1
are taken: two sets that reach the threshold of 0.8 have so many in common that
one of the least of either is among the least of the other, so they have a
common bucket, always.  That holds in any order, so shingles that are common in
the table come after all others: buckets do not grow with the square of the
table where many classes share a shingle and little else.  Buckets of up to ``SMALL`` classes are compared in full,
larger ones first with their least classes; what is then still in different
components of a larger bucket is compared in full, beyond ``FULL`` classes in
parts by their rarest shingles, which part no such pair.  No class is left out,
no number of partners is fixed, and no link depends on chance.  A link holds if
the exact Jaccard similarity of the shingle sets reaches the threshold.
Components of classes are the units of removal: the first paragraph of a
component stays.

A bucket that very many classes share is dealt over salted parts, each with a
centre of its own, before the first exchange.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.common import back_to_rows, bounded_batches, bucketed_table, utf8, written
from siteatlas.llm.components import connected_components
from siteatlas.llm.word_hashes import STEP, Words, mix, runs

SHINGLE = 5
#: A cut has the least hash of so many word pairs on either side.
REACH = 6
MIN_WORDS = 8
#: Of the classes of a batch in one bucket, so many go to the bucket itself, the rest to a salted part of it.
UNSALTED = 4
#: A piece with this Jaccard similarity to a line it stands in is no paragraph besides the line.
NEAR_LINE = 0.8
#: Buckets of up to so many classes are compared in full at first.
SMALL = 9
#: Buckets of up to so many classes are compared without being parted.
FULL = 5000
#: Words of 64 bits in the sketch of a shingle set.
SKETCH = 4
SKETCHES = [f"s{k}" for k in range(SKETCH)]
#: A larger bucket is compared with so many of its classes before it is compared in full.
CENTRES = 32
#: Keeps bounds on the safe side of rounding.
EPSILON = 1e-6
#: Common shingles are told by so many of their last bits; others that share these come late, too.
SLOT_BITS = 22
#: A shingle is common if it is counted so often at least; or twice, four times ... as often, so that there are no more than ``COMMON_MOST``.
COMMON_LEAST, COMMON_MOST = 4, 1 << 20
#: How common a shingle is, by steps of eight times as often, in so many bits.
LEVEL_BITS = 2
#: Words whose shingles a task counts together; one that stands there once is not counted.
COUNTED = 1 << 22


#: Of the two hashes of a run of words.
SEEDS = np.uint64(1), np.uint64(0x51ED270B0A1F39C1)


class Paragraphs:
    """The paragraphs of a list of texts: text, first word, number of words, two hashes, shingles."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts)
        n = len(w.hash)
        following = np.append(w.hash[1:], np.zeros(min(n, 1), np.uint64))
        following[(w.first + w.counts - 1)[w.counts > 0]] = 0  # a text's last word has none, whatever text comes next
        pair = mix(w.hash * STEP ^ mix(following))
        # Texts are kept apart by gaps of the largest hash, so that no cut depends on a neighbour.
        at = np.arange(n) + REACH * (w.text + 1)
        padded = np.full(n + REACH * (len(texts) + 2), np.iinfo(np.uint64).max)
        padded[at] = pair
        core = padded[REACH:-REACH]
        cut = np.ones(len(core), dtype=bool)
        for k in range(1, REACH + 1):
            cut &= (core < padded[REACH - k : -REACH - k]) & (core <= padded[REACH + k : len(core) + REACH + k])
        cut = cut[at - REACH]
        text_start = np.zeros(n, dtype=bool)
        text_start[w.first[w.counts > 0]] = True
        line = np.flatnonzero(w.line_start | text_start)
        line_size = np.diff(np.append(line, n))
        whole = line_size >= MIN_WORDS
        # A line that is a paragraph shares no piece with its neighbours.
        hard = text_start.copy()
        hard[line[whole]] = True
        after = (line + line_size)[whole]
        hard[after[after < n]] = True
        piece = self.joined(np.flatnonzero(cut | hard), hard)
        size = np.diff(np.append(piece, n))
        keep = (size >= MIN_WORDS) & ~self.near_line(piece, size, line, line_size)
        self.start = np.append(piece[keep], line[whole])
        self.length = np.append(size[keep], line_size[whole])
        order = np.lexsort((-self.length, self.start))
        self.start, self.length = self.start[order], self.length[order]
        self.text = w.text[self.start]
        self.first = self.start - w.first[self.text]
        number = np.arange(len(self.start))
        new = np.append(True, self.text[1:] != self.text[:-1]) if len(number) else np.empty(0, bool)
        self.number = number - np.maximum.accumulate(np.where(new, number, 0)) if len(number) else number

    @staticmethod
    def near_line(piece: np.ndarray, size: np.ndarray, line: np.ndarray, line_size: np.ndarray) -> np.ndarray:
        """Whether a piece is nearly one of the lines it stands in, which is a paragraph in its place."""
        if not len(piece):
            return np.empty(0, bool)
        low = np.searchsorted(line, piece, side="right") - 1
        many = np.searchsorted(line, piece + size - 1, side="right") - low
        of = np.repeat(np.arange(len(piece)), many)
        at = low[of] + np.arange(len(of)) - (np.cumsum(many) - many)[of]
        both = np.minimum(piece[of] + size[of], line[at] + line_size[at]) - np.maximum(piece[of], line[at])
        common = np.maximum(both - SHINGLE + 1, 0)
        near = (line_size[at] >= MIN_WORDS) & (common >= NEAR_LINE * (size[of] + line_size[at] - 2 * SHINGLE + 2 - common))
        return np.bincount(of, near, minlength=len(piece)) > 0

    @staticmethod
    def joined(start: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """The starts of pieces, with each piece of under ``MIN_WORDS`` words joined to the next, the last before a hard start to the one before."""
        if not len(start):
            return start
        end = np.append(start[1:], len(hard))
        free = ~hard[start]
        keep = np.ones(len(start), bool)
        head = 0  # where the piece begins that the last one was joined to
        for k in (np.flatnonzero((end - start < MIN_WORDS)[:-1] & free[1:]) + 1).tolist():
            head = k - 1 if keep[k - 1] else head
            keep[k] = start[k] - start[head] >= MIN_WORDS
        last = np.maximum.accumulate(np.where(keep, np.arange(len(start)), 0))[np.append(~free[1:], True)]
        short = end[np.append(~free[1:], True)] - start[last] < MIN_WORDS
        keep[last[short & free[last] & (last > 0)]] = False
        return start[keep]

    def spread(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ``lengths`` items of each paragraph: their index in the words, position, and where each paragraph begins."""
        return spread(self.start, lengths)

    def classes(self) -> np.ndarray:
        """The first of the :meth:`hashes`."""
        return hashes_of(self.words, self.start, self.length)[0]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        first, second = hashes_of(self.words, self.start, self.length, *SEEDS)
        return first, second

    def bands(self, wanted: np.ndarray, threshold: float, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each wanted paragraph its least shingles, one of which it has in common with what reaches the threshold.

        ``common``: levels by a shingle's last ``SLOT_BITS`` bits; those of lesser ones are less.  Returns paragraph, bucket, and as one number how many distinct shingles there are (the high 32 bits) and how many of them are not less than the bucket's.
        """
        if not len(wanted):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = np.zeros(len(self.start), np.int64)
        lengths[wanted] = self.length[wanted] - SHINGLE + 1
        index, _, _ = self.spread(lengths)
        every = runs(self.words.hash, SHINGLE)
        late = None if common is None else common[every & np.uint64((1 << SLOT_BITS) - 1)][index]
        of = np.repeat(np.arange(len(lengths)), lengths)
        shingle = sorted_within(every[index], of, late)
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1]))
        shingle, of = shingle[new], of[new]
        n = np.bincount(of, minlength=len(lengths))
        nth = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        least = nth <= n[of] - np.ceil(threshold * n[of] - EPSILON)
        return of[least], shingle[least].view(np.int64), (n[of] << 32 | n[of] - nth)[least]


def spread(start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``lengths`` items from each of ``start`` on: their index, position from the start, and where each start's begin."""
    begin = np.cumsum(lengths) - lengths
    nth = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    return np.repeat(start, lengths) + nth, nth, begin


def hashes_of(words: Words, start: np.ndarray, length: np.ndarray, *seeds: np.uint64) -> list[np.ndarray]:
    """A hash of each run of ``length`` words from ``start`` on for each of ``seeds``, the first of ``SEEDS`` if none."""
    seeds = seeds or SEEDS[:1]
    if not len(start):
        return [np.empty(0, np.int64) for _ in seeds]
    index, nth, begin = spread(start, length)
    word, place = words.hash[index], np.arange(int(length.max())).astype(np.uint64) * np.uint64(2)
    return [mix(np.add.reduceat(mix(word ^ mix(place + seed)[nth]), begin)).view(np.int64) for seed in seeds]


def sorted_within(values: np.ndarray, of: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """``values`` in the order of ``of``, which ascends, and within it their own, by their level in ``late`` first.

    Sorted by one number, of ``of``, ``late`` and the first bits of a value;
    where these do not tell two values apart, by all.
    """
    first = values if late is None else values >> np.uint64(LEVEL_BITS) | late.astype(np.uint64) << np.uint64(64 - LEVEL_BITS)
    bits = np.uint64(int(of[-1]).bit_length() if len(of) else 0)
    if bits:
        number = of.astype(np.uint64) << (np.uint64(64) - bits) | first >> bits
        order = np.argsort(number)
        number, found = number[order], values[order]
        if not ((number[1:] == number[:-1]) & (found[1:] != found[:-1])).any():
            return found
    return values[np.lexsort((values, first, of))]


def salted(key: np.ndarray, salt: int, *more: np.ndarray) -> list[np.ndarray]:
    """[key, salt, many, *more] of one batch: a key of more than ``UNSALTED`` rows keeps those, and the first of them is the centre of the rest.

    ``many`` marks all rows of such a key.
    """
    order = np.argsort(key, kind="stable")
    key, more = key[order], [x[order] for x in more]
    n = np.arange(len(key))
    first = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1])[: len(key)], n, 0)) if len(key) else n
    far = n - first >= UNSALTED
    centres = np.unique(first[far])
    salts = np.append(np.where(far, salt, 0), np.full(len(centres), salt)).astype(np.int64)
    many = np.zeros(len(key), bool)
    many[centres] = True
    many = np.append(many[first], many[centres])
    return [np.append(key, key[centres]), salts, many, *(np.append(x, x[centres]) for x in more)]


def common_shingles(counts: DataFrame) -> np.ndarray:
    """How common shingles are, in words of 32 levels of two bits, by a shingle's last ``SLOT_BITS`` bits; ``counts`` as :func:`paragraph_rows` gives them.

    Its size is fixed, whatever the input.  It decides about the order of
    shingles, thus about the size of buckets, and about no link.
    """
    often = counts.groupBy("class").agg(F.sum("n_words").alias("n")).where(F.col("n") >= COMMON_LEAST)
    often = written(often.select("class", F.floor(F.log2("n")).cast("int").alias("power")), "often")
    many = dict(often.groupBy("power").count().collect())
    least = int(math.log2(COMMON_LEAST))
    while sum(n for power, n in many.items() if power >= least) > COMMON_MOST:
        least += 1
    level = F.least(F.floor((F.col("power") - least) / 3) + 1, F.lit((1 << LEVEL_BITS) - 1))
    place = F.shiftright(F.col("class").bitwiseAND((1 << SLOT_BITS) - 1), 5)
    levels = often.where(F.col("power") >= least).select("class", level.cast("long").alias("level"), place.alias("place"))
    found = levels.groupBy("place").agg(F.expr(f"bit_or(shiftleft(level, cast({LEVEL_BITS} * (class & 31) as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << SLOT_BITS - 5, np.int64)
    table[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return table


def levels_of(common: np.ndarray) -> np.ndarray:
    """The level of each place of :func:`common_shingles`."""
    return (common.astype("<i8").view(np.uint8)[:, None] >> np.arange(0, 8, LEVEL_BITS, dtype=np.uint8) & np.uint8((1 << LEVEL_BITS) - 1)).ravel()


def band_rows(docs: DataFrame, threshold: float, common: np.ndarray) -> DataFrame:
    """(key, salt, class, n, rest, many) in every bucket; each class once for about every half million classes of a task.

    Thus a class of very many copies sends few rows, and rows need only one
    exchange to be made distinct and put in buckets.  ``rest`` counts the
    shingles that do not come before the bucket's, in the order that ``common``
    (of :func:`common_shingles`) gives.
    """

    def run(batches):
        from pyspark import TaskContext

        late = levels_of(common)
        seen: set[int] = set()
        salt = TaskContext.get().partitionId() << 32
        for batch in batches:
            p, salt = Paragraphs(utf8(batch, "text")), salt + 1
            h = p.classes()
            once = np.array([k for k, x in enumerate(h.tolist()) if x not in seen and not seen.add(x)], np.int64)
            of, key, sizes = p.bands(once, threshold, late)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, salted(key, salt, h[of], sizes))), ["key", "salt", "many", "class", "sizes"])
            if len(seen) > 500_000:
                seen = set()

    rows = docs.select("text").mapInArrow(run, "key long, salt long, many boolean, class long, sizes long")
    rows = rows.repartition("key", "salt").groupBy("key", "salt", "class", "sizes").agg(F.max("many").alias("many"))
    n, rest = F.shiftright("sizes", 32).cast("int").alias("n"), F.col("sizes").bitwiseAND((1 << 32) - 1).cast("int").alias("rest")
    return rows.select("key", "salt", "class", n, rest, "many")


def repeats(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that stand in ``shingles`` more than once, and how often."""
    found, n = np.unique(np.concatenate(shingles), return_counts=True)
    return found[n > 1].view(np.int64), n[n > 1]


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, number, first, length, class, check) of every paragraph; number is -1 in one row for each text.

    Rows whose number is -2 have shingles in place of classes and in ``n_words``
    how often they stand in about ``COUNTED`` words of a task, if more than once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "number", "first", "length", "class", "check"]

    def counted(batch, shingles):
        found, n = repeats(shingles)
        zero = pa.array(np.zeros(len(n), np.int32))
        cols = [pa.nulls(len(n), batch.column("doc_id").type), pa.array(n), pa.array(np.full(len(n), -2, np.int32)), zero, zero, pa.array(found)]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(n), pa.int64())], names)

    def run(batches):
        batch, shingles, size = None, [], 0
        for batch in batches:
            p = Paragraphs(utf8(batch, "text"))
            every = runs(p.words.hash, SHINGLE)
            shingles.append(every[np.append(True, every[1:] != every[:-1])[: len(every)]])  # a word that repeats itself is one place
            size += len(shingles[-1])
            if size >= COUNTED:
                yield counted(batch, shingles)
                shingles, size = [], 0
            h, g = p.hashes()
            n, m = batch.num_rows, len(h)
            blank = pa.nulls(n, pa.int64())
            of = pa.array(np.append(p.text, np.arange(n)))
            cols = [
                batch.column("doc_id").take(of),
                pa.array(np.append(np.zeros(m, np.int64), p.words.counts)),
                pa.array(np.append(p.number, np.full(n, -1)).astype(np.int32)),
                pa.array(np.append(p.first, np.zeros(n, np.int64)).astype(np.int32)),
                pa.array(np.append(p.length, np.zeros(n, np.int64)).astype(np.int32)),
                pa.concat_arrays([pa.array(h), blank]),
                pa.concat_arrays([pa.array(g), blank]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)
        if shingles:
            yield counted(batch, shingles)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, number int, first int, length int, class long, check long"
    )


def shingle_sets(words: Words, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each run of ``length`` words from ``start`` on, one after another, where each run's begin and end, and their sketches."""
    index, _, _ = spread(start, length - SHINGLE + 1)
    of = np.repeat(np.arange(len(start)), length - SHINGLE + 1)
    shingle = sorted_within(runs(words.hash, SHINGLE)[index], of)
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1]))[: len(of)]
    shingle, of = shingle[new], of[new]
    bounds = np.append(0, np.cumsum(np.bincount(of, minlength=len(start))))
    bits = np.zeros((len(start), 64 * SKETCH), np.uint8)
    bits[of, shingle % np.uint64(64 * SKETCH)] = 1
    return shingle.view(np.int64), bounds, np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def shingles_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, shingles, s0 ... s3) of wanted (class, doc_id, at): the shingles of that class's paragraph in that document, and their sketch.

    ``at``: the paragraph's first word and its number of words, as
    :func:`sets_of` puts them in one number.  Of rows that share a doc_id those
    whose words there have the class's hash count.  Each shingle sets one of
    the sketch's 256 bits.
    """
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("class", "at")).alias("classes"))  # bounded by one document
    both = docs.select("doc_id", "text").join(lists, "doc_id")

    def run(batches):
        for batch in batches:
            w = Words(utf8(batch, "text"))
            lists = batch.column("classes")
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            name, at = (lists.flatten().field(k).to_numpy() for k in range(2))
            first, length = at >> 32, at & ((1 << 32) - 1)
            inside = first + length <= w.counts[of]
            name, start, length = name[inside], (w.first[of] + first)[inside], length[inside]
            same = hashes_of(w, start, length)[0] == name
            name, start, length = name[same], start[same], length[same]
            shingle, bounds, sketch = shingle_sets(w, start, length)
            shingle = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingle))
            columns = [pa.array(name), shingle, *(pa.array(sketch[:, k].view(np.int64)) for k in range(SKETCH))]
            yield pa.RecordBatch.from_arrays(columns, ["class", "shingles", *SKETCHES])

    schema = f"class long, shingles array<long>, {', '.join(f'{c} long' for c in SKETCHES)}"
    return both.mapInArrow(run, schema).dropDuplicates(["class"])


def sets_of(classes: DataFrame, paragraphs: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, shingles, sketch) of the given classes, in buckets of their class, so that no join by it moves the sets."""
    # Any document of a class will do: its paragraphs have equal words.
    at = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))
    named = paragraphs.where("doc_id is not null").select("class", "doc_id", at.alias("at")).join(classes.distinct(), "class")
    one = named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min_by("at", "doc_id").alias("at"))
    return bucketed_table(shingles_of(one, docs), "shingles", ["class"])


def side(rows: DataFrame, name: str, **columns: str) -> DataFrame:
    """The shingle sets of ``rows`` under the names of one side of a comparison."""
    names = {"shingles": name} | {c: f"{name}{k}" for k, c in enumerate(SKETCHES)} | columns
    return rows.withColumnsRenamed(names)


def reach(both: Column, nx: Column, ny: Column, threshold: float) -> Column:
    """Whether ``both`` of nx and ny shingles in common are enough.

    ``both`` stands here once: Spark writes an expression out wherever it
    stands, and the JVM never compiles a join whose condition gets too long.
    """
    return (1 + threshold) * both + F.lit(EPSILON) >= threshold * (nx + ny)


def can_reach(nx: Column, ny: Column, threshold: float) -> Column:
    """Whether sets of nx and ny shingles can reach the threshold, by sizes and sketches.

    A bit of one sketch that the other lacks stands for a shingle that the
    other lacks.
    """
    lacks = lambda x, y: sum((F.bit_count(F.expr(f"{x}{k} & ~{y}{k}")) for k in range(1, SKETCH)), F.bit_count(F.expr(f"{x}0 & ~{y}0")))
    most = F.least(nx - lacks("x", "y"), ny - lacks("y", "x"))
    return reach(F.least(nx, ny), nx, ny, threshold) & reach(most, nx, ny, threshold)


def similar(threshold: float) -> Column:
    """Whether the shingle sets x and y reach the Jaccard threshold, exactly; sizes and sketches decide most pairs without a look at the sets."""
    nx, ny = F.size("x"), F.size("y")
    return can_reach(nx, ny, threshold) & reach(F.size(F.array_intersect("x", "y")), nx, ny, threshold)


def sketches_of(sets: DataFrame) -> DataFrame:
    """``sets`` with sizes in place of the shingles."""
    return sets.withColumn("shingles", F.size("shingles"))


def outlines_of(sets: DataFrame) -> DataFrame:
    """``sets`` with ``n``, the number of shingles, and 16 bits of each shingle in place of its 64."""
    outline = F.array_distinct(F.transform("shingles", lambda x: F.shiftright(x, 48).cast("short")))
    return sets.select("class", F.size("shingles").alias("n"), outline.alias("shingles"), *SKETCHES)


def outlines_reach(threshold: float) -> Column:
    """Whether sets with the sizes xn and yn and the outlines x and y can reach the threshold; most pairs are decided by sizes and sketches.

    What one outline has and the other lacks stands for a shingle that the
    other lacks, so no pair that reaches it is left out.
    """
    nx, ny, both = F.col("xn"), F.col("yn"), F.size(F.array_intersect("x", "y"))
    most = F.least(nx - F.size("x"), ny - F.size("y")) + both
    return can_reach(nx, ny, threshold) & reach(most, nx, ny, threshold)


def reaching(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (class, c, ...) of classes those whose shingle sets reach the threshold, exactly; a pair is compared once."""
    pairs = written(pairs.distinct(), "pairs")
    x, y = (sets.select(F.col("class").alias(c), F.col("shingles").alias(n)) for c, n in (("class", "x"), ("c", "y")))
    enough = reach(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), threshold)
    return pairs.join(x, "class").join(y, "c").where(enough).drop("x", "y")


def buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` of :func:`band_rows` that can have a partner here: (key, salt, part, class, size, nth, n, rest).

    Without a ``rest`` in ``rows`` it is all of a set.

    Two sets that reach the threshold do so in the bucket of the least shingle
    they share, where what they share is no more than the ``rest`` of either;
    rows that can't with the sizes next to theirs go.  ``part`` parts a bucket
    by its salt and where sizes are too far apart; ``size`` counts the rows of a
    part and ``nth`` is a row's place in it.  Of a salted bucket all rows stay,
    since their partners may have another salt.
    """
    rows = rows if "rest" in rows.columns else rows.withColumn("rest", F.col("n"))
    ordered = Window.partitionBy("key", "salt").orderBy("n", "class")
    joins = F.coalesce(F.lag("n").over(ordered) + F.lit(EPSILON) >= threshold * F.col("n"), F.lit(False))
    joined = F.coalesce(F.col("n") + F.lit(EPSILON) >= threshold * F.lead("n").over(ordered), F.lit(False))
    many = F.max("many").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n, least = F.col("n"), F.first("n").over(ordered)
    with_less = joins & reach(F.col("rest"), n, F.greatest(least, F.ceil(threshold * n - F.lit(EPSILON))), threshold)
    with_more = joined & F.coalesce(reach(F.col("rest"), n, F.lead("n").over(ordered), threshold), F.lit(False))
    rows = rows.withColumns({"joins": joins, "can": with_less | with_more, "many": many}).where("can or many")
    part = F.count_if(~F.col("joins")).over(ordered)
    within = Window.partitionBy("key", "salt", "part")
    rows = rows.withColumn("part", part).withColumn("size", F.count(F.lit(1)).over(within)).where("size > 1 or many")
    return rows.select("key", "salt", "part", "class", "size", F.row_number().over(within.orderBy("class")).alias("nth"), "n", "rest")


def least_shared(nx: str, ny: str, threshold: float) -> Column:
    """Whether sets of nx and ny shingles can reach the threshold if the least they share is the bucket's, by ``rest`` and ``yrest``."""
    return reach(F.least("rest", "yrest"), F.col(nx), F.col(ny), threshold)


def first_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b), a > b, among all pairs of a part of ``SMALL`` classes, in a larger one of each class with the ``SMALL`` - 1 least.

    Only sizes and sketches go into the buckets, so a long paragraph of many
    bands is no burden; the pairs they leave are compared by their sets.
    """
    part = ["key", "salt", "part"]
    members = members.join(sketches_of(sets), "class")
    least = side(members.where(F.col("nth") < SMALL), "y", **{"class": "c", "n": "yn", "rest": "yrest"}).drop("size", "nth")
    here = (F.col("size") > SMALL) | least_shared("n", "yn", threshold)  # in a larger part, whatever links, so that less is left for later
    both = side(members, "x").join(least, part).where("c < class").where(here & can_reach(F.col("x"), F.col("y"), threshold))
    return reaching(both.select("class", "c"), sets, threshold).select(F.col("class").alias("a"), F.col("c").alias("b"))


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (key, class, label) of buckets of more than one label, with the bucket's ``size``."""
    totals = rows.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")
    )
    return rows.join(totals.where("low <> high").drop("low", "high"), "key")


def by_rarest(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (key, class, label, shingles) in parts of their bucket: one for each of the rarest shingles of a class there.

    Two sets that reach the threshold share one of these, however ties are
    broken; a shingle that one class has alone makes no part.
    """
    every = rows.select("key", "class", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = every.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    every = every.join(often, ["key", "shingle"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("key", "class").orderBy("often", "shingle"))
    found = every.withColumn("nth", nth).where((F.col("nth") <= n_least(F.col("n"), threshold)) & (F.col("often") > 1))
    return found.select(F.xxhash64("key", "shingle").alias("key"), "class", "label")


def n_least(n: Column, threshold: float) -> Column:
    """How many of ``n`` shingles, in any order, hold one of what reaches the threshold with them."""
    return n - F.ceil(threshold * n - F.lit(EPSILON)) + 1


def links_across(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among all pairs of a bucket with different labels, in buckets of any size; ``mixed`` as :func:`mixed_buckets` gives it.

    One of a pair does not have the bucket's commonest label, so only the
    others meet all.  A large bucket is dealt over several tasks, each with a
    share of its classes and all that these have to meet.
    """
    lead = mixed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("lead"))
    rows = written(mixed.join(lead, "key").withColumn("shares", F.ceil(F.col("size") / FULL).cast("int")), "dealt")
    all_of = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    other = side(rows.where("label <> lead").join(sets, "class").drop("size", "lead"), "y", **{"class": "c", "label": "b"})
    other = other.select("*", all_of).drop("shares")
    here = side(rows.withColumn("share", F.pmod(F.xxhash64("class"), F.col("shares")).cast("int")).join(sets, "class"), "x")
    both = here.join(other, ["key", "share"]).where("label <> b and (label = lead or class > c)").where(similar(threshold))
    return both.select(F.col("label").alias("a"), "b").distinct()


def size_step(n: Column, threshold: float) -> Column:
    """The step of a size: of two sets that reach the threshold it is the same, or the smaller one's is one less."""
    return F.floor(F.log(n) / F.lit(math.log((1 + EPSILON) / threshold)))


def further_links(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between labels, among all pairs of a bucket that have different ones.

    ``rows``: key, class, label and, unless unknown, rest.  A bucket of up to ``FULL`` classes is
    compared in full by what can be shared from its shingle on and by outlines,
    a quarter of the sets, inside the join that makes its pairs, where a class
    meets those of its own step of sizes and of the one below; the pairs they
    leave are compared by their sets.  A larger one is
    parted by the rarest shingles of its classes, which leaves out no pair that
    reaches the threshold, and its parts are compared in full, whatever their
    size.
    """
    mixed = written(mixed_buckets(rows), "mixed")
    here = mixed.where(f"size <= {FULL}").drop("size").join(outlines_of(sets), "class")
    here = here if "rest" in here.columns else here.withColumn("rest", F.col("n"))
    other = side(here, "y", **{"class": "c", "label": "b", "n": "yn", "rest": "yrest"}).withColumn("step", size_step(F.col("yn"), threshold))
    step = size_step(F.col("n"), threshold)
    here = side(here.withColumn("step", F.explode(F.array(step, step - 1))), "x", n="xn")
    both = here.join(other, ["key", "step"]).where("label <> b and (xn > yn or xn = yn and class > c)")
    both = both.where(least_shared("xn", "yn", threshold) & outlines_reach(threshold))
    both = reaching(both.select("class", "c", "label", "b"), sets, threshold)
    found = written(both.select(F.col("label").alias("a"), "b").distinct(), "links")
    large = mixed.where(f"size > {FULL}")
    if large.isEmpty():
        return found
    parts = written(by_rarest(large.join(sets, "class"), threshold).distinct(), "parts")
    return found.union(links_across(written(mixed_buckets(parts), "mixed"), sets, threshold))


def centre_links(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between labels, of each class of a bucket with the ``CENTRES`` that stand for it; ``rows``: key, class, label."""
    mixed = written(mixed_buckets(rows), "mixed")
    # The least class of each share of a bucket: an aggregation, combined before the exchange.
    share = F.pmod(F.xxhash64("class"), F.lit(CENTRES)).alias("share")
    centres = mixed.groupBy("key", share).agg(F.min("class").alias("class"), F.min_by("label", "class").alias("label")).drop("share")
    sketches = sketches_of(sets)
    centres = side(centres.join(sketches, "class"), "y", **{"class": "c", "label": "b"})
    both = side(mixed.join(sketches, "class"), "x").join(centres, "key").where("class <> c and label <> b")
    both = both.where(can_reach(F.col("x"), F.col("y"), threshold)).select("class", "c", "label", "b")
    return reaching(both, sets, threshold).select(F.col("label").alias("a"), "b").distinct()


def joins_of(links: DataFrame) -> DataFrame:
    """(label, after): the labels that ``links`` connect, and the one that stands for them."""
    return connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("after"))


def relabelled(rows: DataFrame, joins: DataFrame) -> DataFrame:
    """``rows`` (label, ...) with the labels that ``joins`` connect made one."""
    return rows.join(joins, "label", "left").withColumn("label", F.coalesce("after", "label")).drop("after")


def linked_classes(docs: DataFrame, paragraphs: DataFrame, common: np.ndarray, threshold: float) -> DataFrame:
    """(class, label) of all classes with a link to another."""
    rows = written(buckets(band_rows(docs, threshold, common), threshold), "buckets")
    sets = sets_of(rows.select("class"), paragraphs, docs)
    labels = connected_components(first_links(rows, sets, threshold))
    labels = written(labels.select(F.col("node").alias("class"), "label"), "labels")
    # What has not been compared in full: buckets beyond SMALL classes, and those that were salted.
    large = rows.where(f"size > {SMALL} or salt > 0").select("key").distinct()
    open_ = rows.select("key", "class", "rest").join(large, "key").distinct()
    open_ = written(open_.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")), "open")
    every = labels.union(open_.select("class", "label")).distinct()
    # Most of what is still apart in a large bucket is joined over a few centres before the rest is compared in full.
    joins = joins_of(centre_links(open_.select("key", "class", "label"), sets, threshold))
    open_, every = written(relabelled(open_, joins), "open"), written(relabelled(every, joins), "labels")
    return relabelled(every, joins_of(further_links(open_.select("key", "class", "label", "rest"), sets, threshold)))


def repeated_paragraphs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(all paragraphs, those in a component over two or more documents).

    The second has component, keep_doc, keep_number and removed as well.
    """
    docs = docs.select("doc_id", "text")
    bounded_batches(docs.sparkSession, size=4 << 20)
    rows = written(paragraph_rows(docs), "paragraphs")
    paragraphs = rows.where("number > -2")
    real = paragraphs.where("number >= 0")
    labels = linked_classes(docs, real, common_shingles(rows.where("number = -2")), threshold)
    classes = real.groupBy("class", "check").agg(
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.max(F.col("doc_id").isNull()).alias("nameless"),
        F.count(F.lit(1)).alias("copies"),
    )
    # Documents without an id are one document.
    spans = (F.col("first_doc") != F.col("last_doc")) | (F.col("nameless") & F.col("last_doc").isNotNull())
    named = classes.join(labels, "class", "left").where(F.col("label").isNotNull() | F.col("nameless") | spans)
    named = written(named.withColumn("component", F.coalesce("label", "class")), "named")
    groups = named.groupBy("component").agg(
        F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.max("nameless").alias("nameless")
    )
    hits = named.select("class", "check", "component", "copies").join(groups.where(spans).select("component"), "component")
    found = back_to_rows(real, written(hits, "hits"), ["class", "check"], "copies")
    found = written(found.select("doc_id", "number", "first", "length", "component"), "found")
    keeps = found.groupBy("component").agg(
        F.min(F.struct("doc_id", "number", "first", "length")).alias("keep"), F.count(F.lit(1)).alias("rows")
    )
    found = back_to_rows(found, written(keeps, "keeps"), ["component"], "rows").select(
        "doc_id",
        "number",
        "first",
        "length",
        "component",
        F.col("keep.doc_id").alias("keep_doc"),
        F.col("keep.number").alias("keep_number"),
        (F.col("first") < F.col("keep.first") + F.col("keep.length")).alias("before_end"),
        (F.col("first") + F.col("length") > F.col("keep.first")).alias("after_start"),
    )
    # What overlaps the paragraph that is kept stays with it.
    stays = F.col("doc_id").eqNullSafe(F.col("keep_doc")) & F.col("before_end") & F.col("after_start")
    return paragraphs, found.withColumn("removed", ~stays).drop("before_end", "after_start")


def united(found: DataFrame) -> DataFrame:
    """(doc_id, first, length) of runs of paragraphs that overlap; runs that only meet stay apart."""
    ordered = Window.partitionBy("doc_id").orderBy("first", "length")
    before = F.max(F.col("first") + F.col("length")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("first") >= before, F.lit(True)).cast("int")
    run = found.select("doc_id", "first", "length", fresh.alias("fresh")).withColumn("run", F.sum("fresh").over(ordered))
    ends = run.groupBy("doc_id", "run").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("length")).alias("end"))
    return ends.select("doc_id", "first", (F.col("end") - F.col("first")).alias("length"))


def substring_dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Paragraphs of each document that repeat across documents, and which of them go.

    Returns one row per doc_id: n_words, n_paragraphs (of 8 words or more),
    n_repeated (in a component that spans documents), n_removed,
    removed_words, longest_repeat (words of the longest run of repeated
    paragraphs), ``spans`` (first word and number of words of each run of
    removed paragraphs that overlap), ``class_docs`` (a component is named by
    the document that keeps its paragraph: all components found here) and
    ``kept_in`` (those of the removed).  The first paragraph of a component, by
    doc_id and position, stays, and what overlaps it in its component.  Null,
    empty and short texts have no paragraphs.  Rows that repeat a doc_id are
    one document; null ids are one document that can keep a paragraph but
    names none, and is found by equal words only.  An empty table gives an
    empty result.
    """
    paragraphs, found = repeated_paragraphs(docs, threshold)
    found = written(found, "found")
    totals = paragraphs.groupBy("doc_id").agg(
        F.sum("n_words").alias("n_words"), F.count_if(F.col("number") >= 0).alias("n_paragraphs")
    )
    gone = F.col("removed")
    marks = found.groupBy(F.col("doc_id").alias("__doc")).agg(  # bounded by one document
        F.count(F.lit(1)).alias("n_repeated"),
        F.count_if(gone).alias("n_removed"),
        F.array_sort(F.collect_set("keep_doc")).alias("class_docs"),
        F.array_sort(F.collect_set(F.when(gone, F.col("keep_doc")))).alias("kept_in"),
    )
    spans = united(found.where(gone)).groupBy(F.col("doc_id").alias("__spans_of")).agg(
        F.array_sort(F.collect_list(F.struct("first", "length"))).alias("spans"), F.sum("length").alias("removed_words")
    )
    longest = united(found).groupBy(F.col("doc_id").alias("__runs_of")).agg(F.max("length").alias("longest_repeat"))
    marks = marks.join(spans, F.col("__doc").eqNullSafe(F.col("__spans_of")), "left")
    marks = marks.join(longest, F.col("__doc").eqNullSafe(F.col("__runs_of")), "left")
    numbers = ("n_repeated", "n_removed", "removed_words", "longest_repeat")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers]
    lists = [F.coalesce(F.col(c), F.array()).alias(c) for c in ("spans", "class_docs", "kept_in")]
    return totals.join(marks, totals["doc_id"].eqNullSafe(marks["__doc"]), "left").select(
        "doc_id", "n_words", "n_paragraphs", *zero, *lists
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given runs of words and the white space before each."""
    import re

    at = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
    out, last = [], 0
    for first, n in sorted(spans):
        out.append(text[last : at[first][0]].rstrip(" \t"))
        last = at[first + n - 1][1]
    return "".join([*out, text[last:]])
