import random
from collections import defaultdict

import xxhash

from siteatlas.llm.components import connected_components
from siteatlas.llm.simhash import active, drop_near_duplicates, links, near_duplicates, signed
from tests.llm.corpora import SCHEMA, documents, frame, lower


def fingerprint(text):
    words = [w for w in lower(text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def within(fps, radius=3):
    return [(a, b) for i, a in enumerate(fps) for b in fps[: i + 1] if (a ^ b).bit_count() <= radius]


def test_matches_brute_force(spark):
    rows = documents()
    fps = {r: fingerprint(r[1]) for r in set(rows)}
    label = components(within(sorted(set(fps.values()))))
    least = defaultdict(list)
    for (i, _), f in fps.items():
        if i is not None:
            least[label[f]].append(i)
    expected = sorted((str(r[0]), f"{fps[r]:016x}", str(min(least[label[fps[r]]], default=None))) for r in rows)
    found = near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected


def test_links_connect_all_within_three_bits(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.choice([0, 2, 9])):
            y = x
            for _ in range(rng.randrange(1, 6)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
            x = rng.choice([x, y])
    fps = sorted(fps)
    expected = components(within(fps))
    found = links(active(spark.createDataFrame([(signed(x),) for x in fps], "fp long")))
    got = components([(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()])
    same = lambda m: {frozenset(x for x in fps if m.get(x, x) == m.get(y, y)) for y in fps}
    assert same(got) == same(expected)
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in found.collect())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_components_of_random_edges(spark, monkeypatch):
    monkeypatch.setattr("siteatlas.llm.components.FILE_ROWS", 20)
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(900 - i, 899 - i) for i in range(60)]
    edges += [(b, a) for a, b in edges[:40]] + edges[:40]
    expected = components([(a, b) for a, b in edges if a != b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    members = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node for r in found} == members
    groups = {}
    for x in members:
        groups.setdefault(expected.get(x, x), []).append(x)
    assert {r.node: r.label for r in found} == {x: min(g) for g in groups.values() for x in g}


def test_components_of_no_edges(spark):
    for edges in ([], [(3, 3)]):
        assert connected_components(spark.createDataFrame(edges, "a long, b long")).collect() == []


def test_drop_keeps_one_of_each_component(spark):
    rows = documents()
    docs = frame(spark, rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in near_duplicates(docs).collect() if r.component_id is not None})


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == [] and drop_near_duplicates(none).collect() == []


def test_drop_decides_by_row_where_ids_are_null_or_repeat(spark):
    texts = ["alpha beta gamma delta", "one two three four five", "red green blue black white grey", "sun moon star"]
    assert not [p for p in within([fingerprint(t) for t in texts]) if p[0] != p[1]]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[0]), (7, texts[3])]
    kept = drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("8", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3])]
    )
