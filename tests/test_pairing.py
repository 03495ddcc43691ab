"""Patterns of buckets that vary in many segments: pairs by an index of segments against sets of slots and brute force."""

import random
import time

import pytest

from siteatlas.operators import patterns
from tests.test_operators import paired_members


def varied(size, seed=5):
    """Paths that each differ from one of eleven segments in four of them, with few values."""
    rng, urls = random.Random(seed), set()
    while len(urls) < size:
        segs = [f"f{k}" for k in range(12)]
        for k in rng.sample(range(1, 12), 4):
            segs[k] = str(rng.randrange(6))
        urls.add("https://deep.example/" + "/".join(segs))
    return sorted(urls)


def members(spark, urls):
    rows = patterns.masked(patterns.canonical_urls(spark.createDataFrame([(u,) for u in urls], "url string")))
    found = [(tuple(r["mask"]), r["canonical"]) for r in rows.select("mask", "canonical").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_few_urls_of_many_positions_end_soon(spark):
    urls = varied(330)
    started = time.time()
    found = members(spark, urls)
    assert time.time() - started < 60
    assert found == paired_members(urls)


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_of_a_common_segment(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_ROWS", block)
    urls = varied(90, seed=6) + ["https://deep.example/f0/" + "/".join(f"u{j}-{k}" for k in range(11)) for j in range(3)]
    assert members(spark, urls) == paired_members(urls)


@pytest.mark.parametrize("pairs", [True, False])
def test_both_ways_give_the_same_rows(spark, monkeypatch, pairs):
    """All deep buckets one way, then the other; two schemes of one path are one another's partners nowhere."""
    choose = lambda rows: rows.select(*patterns.BUCKET).distinct().where(str(pairs).lower())
    monkeypatch.setattr(patterns, "cheaper_in_pairs", choose)
    rng = random.Random(8)
    urls = ["https://h.example/a/" + "/".join(rng.choice("12") for _ in range(6)) for _ in range(25)]
    twin = urls[0].replace("https", "http")
    expected = paired_members(sorted(set(urls)))
    found = members(spark, urls + [twin])
    assert {m for m in found if m[1] != twin} == expected
    assert {m for m, u in found if u == twin} == {m for m, u in expected if u == urls[0]}


def test_the_choice_is_by_cost(spark):
    """Many URLs with common segments go by sets, few by pairs; a bucket of few positions has no choice."""
    def chosen(urls):
        rows = patterns.canonical_urls(spark.createDataFrame([(u,) for u in urls], "url string"))
        rows = rows.withColumn("vary", patterns.F.expr("sequence(1, n - 1)"))
        return patterns.cheaper_in_pairs(rows).count()

    common = [f"https://h.example/a/{i}/x/x/x/x" for i in range(400)]
    assert chosen(common) == 0 and chosen(common[:8]) == 1 and chosen(["https://h.example/a/1/2", "https://h.example/a/2/2"]) == 0


def test_slot_ranges_match_lists(spark):
    """Ends and counts against the lists of all patterns; numbers in two ways, gaps, runs and mixed values."""
    urls = [f"https://h.example/{a}/{i}/{b}" for a in ("p", "q") for i in ("7", "07", "8", "9") for b in ("x", "y")]
    urls += [f"https://h.example/r/{i}" for i in (1, 5, 99999999999999999999)] + [f"https://h.example/s/w{i}" for i in range(3)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = patterns.masked(patterns.canonical_urls(pages))
    found = patterns.slot_ranges(rows, patterns.shapes(rows, group_strings=True)).collect()
    listed = {}
    for p in patterns.described_patterns(patterns.find_patterns(pages, group_strings=True)).collect():
        for k, v in enumerate(p["vars"]):
            listed.setdefault((p.annotation, k), set()).update(v["values"])
    assert {(r.annotation, r.slot): r.n_values for r in found} == {k: len(v) for k, v in listed.items()}
    for r in found:
        values = listed[r.annotation, r.slot]
        numbers = {int(v) for v in values if v.isdigit()}
        whole = r.kind == "int" and all(v.isdigit() and int(v) < 2**63 for v in values)
        assert (r.low, r.high) == ((min(numbers), max(numbers)) if whole else (None, None))
        assert r.consecutive == (whole and len(numbers) > 1 and max(numbers) - min(numbers) + 1 == len(numbers))
    assert {r.kind for r in found} == {"int", "string"} and any(not r.consecutive for r in found if r.kind == "int")
    none = patterns.masked(patterns.canonical_urls(pages.limit(0)))
    assert patterns.slot_ranges(none, patterns.shapes(none)).isEmpty()
