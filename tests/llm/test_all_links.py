"""No pair that reaches the threshold is left out, however large its bucket."""

import random

import numpy as np

from siteatlas.llm import substring_dedup as sd
from siteatlas.llm import word_hashes as wh
from siteatlas.llm.common import bucketed_table
from siteatlas.llm.components import connected_components
from siteatlas.llm.substring_dedup import Paragraphs
from siteatlas.llm.word_hashes import Words, mix, runs
from siteatlas.sources.tables import setting

EDGE = 0.8


def jaccard(x, y):
    return len(x & y) / len(x | y)


def pairs_in_one_bucket(rng, n):
    """(class, shingles): ``n`` pairs of one common shingle, each with a similarity of exactly 0.8."""
    rows = []
    for k in range(n):
        own = [rng.randrange(-(2**63), 2**63) for _ in range(9)]
        rows += [(2 * k, [1, *own[:7], own[7]]), (2 * k + 1, [1, *own[:7], own[8]])]
    assert all(jaccard(set(x[1]), set(y[1])) == EDGE for x, y in zip(rows[::2], rows[1::2], strict=True))
    return rows


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(sd, "FULL", 5)
    data = pairs_in_one_bucket(random.Random(2), 400)
    sets = spark.createDataFrame([(c, s, 0, 0, 0, 0) for c, s in data], "class long, shingles array<long>, s0 long, s1 long, s2 long, s3 long")
    rows = spark.createDataFrame([(7, c, c) for c, _ in data], "key long, class long, label long")
    found = {tuple(sorted(r)) for r in sd.further_links(rows, sets, EDGE).collect()}
    assert found == {(2 * k, 2 * k + 1) for k in range(400)}


def test_parts_beyond_the_bound_are_compared_in_full(spark, monkeypatch):
    """Sets over few shingles, some under one label before: components as by all pairs."""
    monkeypatch.setattr(sd, "FULL", 5)
    rng = random.Random(3)
    data = [(c, sorted({1, *rng.sample(range(2, 16), rng.randrange(8, 13))})) for c in range(120)]
    label = {c: 0 if c < 40 else c for c, _ in data}
    sets = spark.createDataFrame([(c, s, 0, 0, 0, 0) for c, s in data], "class long, shingles array<long>, s0 long, s1 long, s2 long, s3 long")
    rows = spark.createDataFrame([(7, c, label[c]) for c, _ in data], "key long, class long, label long")
    want = {tuple(sorted((label[c], label[d]))) for c, x in data for d, y in data if label[c] != label[d] and jaccard(set(x), set(y)) >= EDGE}
    found = {tuple(sorted(r)) for r in sd.further_links(rows, sets, EDGE).collect()}
    assert found == want and want
    assert connected_components(spark.createDataFrame(list(want), "a long, b long")).count() > 2


def test_bands_meet_at_the_threshold():
    rng, met = random.Random(4), 0
    for _ in range(3000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 60))]
        other = words[: len(words) - rng.randrange(0, 3)] + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 4))]
        p = Paragraphs([" ".join(words).encode(), " ".join(other).encode()])
        whole = [np.flatnonzero((p.text == k) & (p.length == len(w)))[0] for k, w in enumerate((words, other))]
        every = runs(p.words.hash, sd.SHINGLE)
        x, y = (set(every[p.start[k] : p.start[k] + p.length[k] - sd.SHINGLE + 1].tolist()) for k in whole)
        if jaccard(x, y) >= EDGE:
            of, key, _ = p.bands(np.array(whole), EDGE)
            assert set(key[of == whole[0]].tolist()) & set(key[of == whole[1]].tolist())
            met += 1
    assert met > 500


def test_a_size_of_its_own_stays_in_a_salted_bucket(spark):
    rows = [(1, 0, 11, 10, True), (1, 0, 12, 10, True), (1, 0, 15, 100, True), (1, 5, 11, 10, True), (1, 5, 19, 99, True), (2, 0, 21, 10, False), (2, 0, 22, 100, False)]
    found = sd.buckets(spark.createDataFrame(rows, "key long, salt long, class long, n int, many boolean"), EDGE)
    assert {r["class"] for r in found.collect()} == {11, 12, 15, 19}


def test_whole_sets_do_not_go_into_the_buckets(spark):
    """600 sets of 400 shingles in one bucket, one pair of them at the threshold: fewer bytes are dealt than the sets have."""
    rng = random.Random(5)
    data = [[1, *(rng.randrange(-(2**63), 2**63) for _ in range(399))] for _ in range(600)]
    data[7] = data[6][:356] + data[7][:44]  # 356 of 444 in common
    data[7][356] = rng.randrange(-(2**63), 2**63)
    assert jaccard(set(data[6]), set(data[7])) >= EDGE
    sets = spark.createDataFrame([(c, sorted(s), 0, 0, 0, 0) for c, s in enumerate(data)], "class long, shingles array<long>, s0 long, s1 long, s2 long, s3 long")
    sets = bucketed_table(sets, "sets", ["class"])
    rows = spark.createDataFrame([(7, c, c) for c in range(600)], "key long, class long, label long")
    dealt = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(k) for k in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        before = dealt()
        found = {tuple(sorted(r)) for r in sd.further_links(rows, sets, EDGE).collect()}
    assert found == {(6, 7)}
    assert dealt() - before < 8 * 400 * 600


def test_outlines_leave_out_no_pair(spark):
    """Shingles that share their 16 bits, in one set or across both: what reaches the threshold stays."""
    rng = random.Random(6)
    draw = lambda: (rng.randrange(-8, 8) << 48) + rng.randrange(40)
    data = []
    while len(data) < 300:
        x = {draw() for _ in range(40)}
        y = set(rng.sample(sorted(x), len(x) - rng.randrange(9))) | {draw() for _ in range(rng.randrange(9))}
        data.append((sorted(x), sorted(y)))
    want = [jaccard(set(x), set(y)) >= EDGE for x, y in data]
    schema = "class long, shingles array<long>, s0 long, s1 long, s2 long, s3 long"
    frame = lambda k: sd.outlines_of(spark.createDataFrame([(n, d[k], 0, 0, 0, 0) for n, d in enumerate(data)], schema))
    both = sd.side(frame(0), "x", n="xn").join(sd.side(frame(1), "y", n="yn"), "class")
    kept = {r["class"] for r in both.where(sd.outlines_reach(EDGE)).collect()}
    assert {n for n, w in enumerate(want) if w} <= kept and 0 < sum(want) < 300


def test_a_pair_stays_where_its_least_common_shingle_is(spark):
    """Of the buckets of a pair at the threshold the first keeps both, and one whose rest is too small for the pair keeps none."""
    rng, met = random.Random(8), 0
    rows, want = [], set()
    for k in range(600):
        common = [rng.randrange(2**64) for _ in range(rng.randrange(6, 60))]
        sets = [sorted({*common, *(rng.randrange(2**64) for _ in range(rng.randrange(0, 8)))}) for _ in range(2)]
        for c, x in zip((2 * k, 2 * k + 1), sets, strict=True):
            least = x[: len(x) - int(np.ceil(EDGE * len(x) - 1e-6)) + 1]
            rows += [(int(np.uint64(v).view(np.int64)), 0, c, len(x), len(x) - at, False) for at, v in enumerate(least)]
        if jaccard(*map(set, sets)) >= EDGE:
            want.add((2 * k, 2 * k + 1, int(np.uint64(min(common)).view(np.int64))))
    found = sd.buckets(spark.createDataFrame(rows, "key long, salt long, class long, n int, rest int, many boolean"), EDGE).collect()
    kept = {(r["class"], r["key"]) for r in found}
    for x, y, key in want:
        assert (x, key) in kept and (y, key) in kept
        met += 1
    everywhere = {(key, c) for key, _, c, *_ in rows}
    dropped = sum((key, c ^ 1) in everywhere and (c, key) not in kept for key, c in everywhere)
    assert met > 100 and dropped > 100


def test_values_that_differ_in_their_last_bits_are_sorted():
    of = np.repeat(np.arange(5), 4)
    values = np.array([3, 1, 2, 0] * 5, np.uint64) + np.uint64(1 << 63)
    assert sd.sorted_within(values, of).tolist() == [k + (1 << 63) for k in range(4)] * 5
    rng = np.random.default_rng(9)
    of, values = np.sort(rng.integers(0, 50, 3000)), rng.integers(0, 2**64, 3000, dtype=np.uint64)
    assert sd.sorted_within(values, of).tolist() == values[np.lexsort((values, of))].tolist()


def test_a_condition_looks_at_two_sets_once():
    """What is written into a condition several times is computed as often for a pair."""
    assert str(sd.outlines_reach(EDGE)).count("array_intersect") == 1
    assert str(sd.similar(EDGE)).count("array_intersect") == 1
    assert str(sd.outlines_reach(EDGE)).count("bit_count") == 2 * sd.SKETCH


def test_sizes_at_the_edges_of_steps_meet(spark):
    """All pairs of sizes at the threshold are within a step, and those of 4k and 5k shingles are found, whichever has the lesser class."""
    sizes = [(n, m) for n in range(1, 900) for m in range(int(np.ceil(EDGE * n - 1e-9)), n + 1)]
    for threshold in (EDGE, 1.0):
        some = [x for x in sizes if threshold < 1 or x[0] == x[1]]
        frame = spark.createDataFrame(some, "n int, m int").coalesce(1)
        steps = frame.select((sd.size_step(frame["n"], threshold) - sd.size_step(frame["m"], threshold)).alias("d")).distinct().collect()
        assert {r["d"] for r in steps} <= {0, 1}
    rng, data, want = random.Random(11), [], set()
    for k in range(1, 80):
        long = [1, *(rng.randrange(-(2**63), 2**63) for _ in range(5 * k - 1))]
        pair = [long, long[: 4 * k]]
        data += pair if k % 2 else pair[::-1]
        want.add((2 * k - 2, 2 * k - 1))
    assert all(jaccard(set(data[a]), set(data[b])) == EDGE for a, b in want)
    sets = spark.createDataFrame([(c, s, 0, 0, 0, 0) for c, s in enumerate(data)], "class long, shingles array<long>, s0 long, s1 long, s2 long, s3 long")
    rows = spark.createDataFrame([(7, c, c) for c in range(len(data))], "key long, class long, label long")
    assert {tuple(sorted(r)) for r in sd.further_links(rows, sets, EDGE).collect()} >= want


def test_sets_are_those_of_the_paragraphs(spark):
    """Sets and sketches of all classes, also where rows share a doc_id and where a document has its paragraph elsewhere."""
    rng = random.Random(12)
    line = lambda: " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(8, 40)))
    lines = [line() for _ in range(60)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(0, 5))) for _ in range(80)]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)] + [(50, None), (50, "")], "doc_id long, text string")
    p = Paragraphs([t.encode() for t in texts])
    every, want = runs(p.words.hash, sd.SHINGLE), {}
    for h, a, n in zip(p.classes().tolist(), p.start, p.length, strict=True):
        want[h] = set(every[a : a + n - sd.SHINGLE + 1].view(np.int64).tolist())
    rows = sd.paragraph_rows(docs).where("number >= 0")
    found = sd.sets_of(rows.select("class"), rows, docs).collect()
    assert {r["class"]: set(r["shingles"]) for r in found} == want and len(found) == len(want)
    for r in found:
        assert len(set(r["shingles"])) == len(r["shingles"])
        bits = sum((r[c] & (2**64 - 1)) << (64 * k) for k, c in enumerate(sd.SKETCHES))
        assert bits == sum(1 << b for b in {x & 255 for x in r["shingles"]})


def test_hashes_of_words_are_sums_over_their_bytes():
    texts = [b"One  two\n\nthree\tFOUR", b"", b" x ", bytes(range(1, 256)) * 30, b"y" * 5000]
    want = []
    for t in texts:
        for word in t.lower().split(None) if t.isascii() else b"".join(bytes([wh.FOLD[b]]) for b in t).translate(bytes(32 if wh.WHITE[b] else b for b in range(256))).split(b" "):
            if word:
                total = sum(int(wh.BYTE_VALUE[b]) * pow(int(wh.STEP), k + 1, 2**64) for k, b in enumerate(word)) + len(word)
                want.append(int(mix(np.array([total % 2**64], np.uint64))[0]))
    assert Words(texts).hash.tolist() == want


def test_classes_that_share_a_common_phrase_alone_do_not_meet(spark, monkeypatch):
    """400 paragraphs that share one of two phrases, and a pair at the threshold among them: it is found, and few others meet in a bucket."""
    rng, tables = random.Random(13), {}
    draw = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    phrases = [draw(14) for _ in range(2)]
    lines = [draw(12) + phrases[k % 2] + draw(12) for k in range(400)]
    lines.append([*lines[7][:-1], "other"])
    docs = spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(lines)], "doc_id long, text string").coalesce(1)
    write = sd.written
    monkeypatch.setattr(sd, "written", lambda df, name, **more: tables.setdefault(name, write(df, name, **more)) if name == "buckets" else write(df, name, **more))
    _, found = sd.repeated_paragraphs(docs, EDGE)
    # The pieces that lie in a phrase repeat as they are.
    assert {r["doc_id"] for r in found.where("length > 30").collect()} == {7, 400}
    sizes = [r["count"] for r in tables["buckets"].select("key", "class").distinct().groupBy("key").count().collect()]
    assert sizes and sum(n * (n - 1) // 2 for n in sizes) < 400


def test_bands_meet_whatever_is_common():
    """Pairs at the threshold have a common bucket in any order of shingles, and the rest is counted in that order."""
    rng, met = random.Random(14), 0
    for _ in range(300):
        levels = np.random.default_rng(rng.randrange(10**9)).integers(0, 1 << sd.LEVEL_BITS, 1 << sd.SLOT_BITS, dtype=np.uint8)
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 60))]
        other = words[: len(words) - rng.randrange(0, 3)] + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 4))]
        p = Paragraphs([" ".join(words).encode(), " ".join(other).encode()])
        whole = [np.flatnonzero((p.text == k) & (p.length == len(w)))[0] for k, w in enumerate((words, other))]
        every = runs(p.words.hash, sd.SHINGLE)
        x, y = ({int(v) for v in every[p.start[k] : p.start[k] + p.length[k] - sd.SHINGLE + 1]} for k in whole)
        of, key, sizes = p.bands(np.array(whole), EDGE, levels)
        for k, s in zip(whole, (x, y), strict=True):
            order = sorted(s, key=lambda v: (levels[v & ((1 << sd.SLOT_BITS) - 1)], v))
            here = [int(v) for v in key[of == k].view(np.uint64)]
            assert here == order[: len(here)] and len(here) == len(s) - int(np.ceil(EDGE * len(s) - 1e-6)) + 1
            assert sizes[of == k].tolist() == [len(s) << 32 | len(s) - nth for nth in range(len(here))]
        if jaccard(x, y) >= EDGE:
            assert set(key[of == whole[0]].tolist()) & set(key[of == whole[1]].tolist())
            met += 1
    assert met > 50


def test_common_shingles_are_told_by_steps(spark, monkeypatch):
    counts = [(5, 2), (5, 3), (6, 1), (6, 2), (-1, 40), (1 << 30, 5000), (9, 4)]
    frame = spark.createDataFrame(counts, "class long, n_words long")
    mask = (1 << sd.SLOT_BITS) - 1
    levels = sd.levels_of(sd.common_shingles(frame))
    assert len(levels) == 1 << sd.SLOT_BITS
    assert {int(k): int(levels[k]) for k in np.flatnonzero(levels)} == {5: 1, 9: 1, -1 & mask: 2, (1 << 30) & mask: 3}
    monkeypatch.setattr(sd, "COMMON_MOST", 2)
    levels = sd.levels_of(sd.common_shingles(frame))
    assert {int(k): int(levels[k]) for k in np.flatnonzero(levels)} == {-1 & mask: 1, (1 << 30) & mask: 3}
    monkeypatch.setattr(sd, "COMMON_MOST", 0)
    assert not sd.common_shingles(frame).any()
