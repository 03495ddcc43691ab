"""Trees, scopes and fragments against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from siteatlas.operators import scope, tree


def walk(edges, roots):
    """(key, parent, depth) breadth first, as the operator says it, then order and counts by a stack."""
    children = {}
    for a, b in set(edges):
        if a != b:
            children.setdefault(a, set()).add(b)
    keys = {k for e in edges for k in e} | set(roots)
    linked = {b for a, b in edges if a != b}
    found = {}

    def reach(starts):
        level = {k: None for k in starts if k not in found}
        depth = 0
        while level:
            found.update({k: (p, depth) for k, p in level.items()})
            depth += 1
            nxt = {}
            for k in sorted(level):
                for c in children.get(k, ()):
                    if c not in found and c not in nxt:
                        nxt[c] = k
            level = nxt

    reach(set(roots) | (keys - linked))
    while keys - set(found):
        left = keys - set(found)
        reach({k for k in left if all(k < a for a in left if k in children.get(a, ()))})
    below = {}
    for k in found:
        p = found[k][0]
        while p is not None:
            below[p] = below.get(p, 0) + 1
            p = found[p][0]
    order, stack = [], sorted((k for k in found if found[k][0] is None), reverse=True)
    while stack:
        k = stack.pop()
        order.append(k)
        stack += sorted((c for c in found if found[c][0] == k), reverse=True)
    return {k: (*found[k], below.get(k, 0), order.index(k)) for k in found}


def graphs():
    rng = random.Random(8)
    name = lambda n: f"k{n:03}"
    yield [(name(n), name(n + 1)) for n in range(40)], [name(0)]  # one branch, deeper than any fixed bound
    yield [("r", name(n)) for n in range(60)] + [(name(5), "x"), ("x", "r"), ("x", "x")], ["r"]
    yield [(name(rng.randrange(40)), name(rng.randrange(40))) for _ in range(45)], [name(7)]
    yield [("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("f", "g"), ("g", "f")], ["a"]


@pytest.mark.parametrize("n", range(4))
def test_forest_matches_a_walk(spark, n):
    edges, roots = list(graphs())[n]
    found = tree.forest(spark.createDataFrame(edges, "from_key string, to_key string"), spark.createDataFrame([(r,) for r in roots], "key string"))
    rows = tree.depth_first(found).collect()
    want = walk(edges, roots)
    assert {r["key"]: (r["parent"], r["depth"], r["below"], r["place"]) for r in rows} == want and len(rows) == len(want)


def test_cut_says_what_it_hides(spark):
    edges, roots = next(graphs())
    found = tree.forest(spark.createDataFrame(edges, "from_key string, to_key string"), spark.createDataFrame([(r,) for r in roots], "key string"))
    assert found.count() == 41
    rows = tree.shown_tree(found, 3).collect()
    assert len(rows) == 4 and sum(r["hidden"] for r in rows) == 37
    assert sum(r["hidden"] for r in tree.shown_tree(found).collect()) == 0


def test_empty_forest(spark):
    none = spark.createDataFrame([], "from_key string, to_key string")
    assert tree.depth_first(tree.forest(none, spark.createDataFrame([], "key string"))).count() == 0


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(9), n, rng.randrange(5)) for n in range(300)]
    got = tree.running_total(spark.createDataFrame(rows, "a int, b int, v long"), ["a", "b"], "v", "t").collect()
    total, want = 0, {}
    for a, b, v in sorted(rows):
        want[a, b] = total
        total += v
    assert {(r.a, r.b): r.t for r in got} == want


HOSTS = ["a.example.com", "A.Example.com:8443", "b.a.example.com", "notexample.com", "example.com", "example.com.evil.net", "xa.example.com", "localhost", "", None]
SCOPES = ["example.com", "A.example.com", "localhost", "com.evil.net"]


def test_longest_domain(spark):
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    scopes = spark.createDataFrame([(s,) for s in SCOPES], "domain string")
    want = {}
    for h in HOSTS:
        name = (h or "").lower().split(":")[0]
        fits = [s.lower() for s in SCOPES if name == s.lower() or name.endswith("." + s.lower())]
        want[h] = max(fits, key=len, default=None)
    assert {r["host"]: r["scope"] for r in scope.with_domain(hosts, scopes).collect()} == want
    assert want["notexample.com"] is None and want["b.a.example.com"] == "a.example.com"


def test_headers_stay_in_scope(spark):
    kind = "array<struct<name: string, value: string>>"
    requests = spark.createDataFrame(
        [("https://a.example.com:8443/x", [("COOKIE", "old"), ("Accept", "*/*")]), ("https://example.com.evil.net/", [("Accept", "*/*")]), ("https://example.com/", []), ("/relative", [])],
        f"url string, headers {kind}",
    )
    given = spark.createDataFrame([("example.com", "Cookie", "s=1"), ("", "X-All", "1")], "domain string, name string, value string")
    scopes = spark.createDataFrame([("example.com",)], "domain string")
    sent = {r["url"]: [tuple(h) for h in r["headers"]] for r in scope.apply_headers(requests, given, scopes).collect()}
    assert sent == {
        "https://a.example.com:8443/x": [("Accept", "*/*"), ("Cookie", "s=1")],
        "https://example.com.evil.net/": [("Accept", "*/*")],
        "https://example.com/": [("Cookie", "s=1")],
        "/relative": [],
    }
    free = {r["url"]: [tuple(h) for h in r["headers"]] for r in scope.apply_headers(requests, given).collect()}
    assert free["https://example.com.evil.net/"] == [("Accept", "*/*"), ("X-All", "1")]


def test_covered_fragments(spark):
    rng = random.Random(6)
    words = lambda: "/" + "/".join(rng.choice(["a", "b", "é", "{id}", "cc"]) for _ in range(rng.randrange(1, 5)))
    links = [(words(), rng.choice([None, words()])) for _ in range(80)]
    fragments = [w[: rng.randrange(1, len(w) + 1)] for w in (words() for _ in range(120))] + ["", None, "/documents/"]
    links.append(("/documents/{e}/cancel/", ""))
    cover = {f for f in fragments if f and any(t and "{" in t and len(t) > len(f) and t.startswith(f) for row in links for t in row)}
    f = spark.createDataFrame([(x,) for x in fragments], "fragment string")
    found = spark.createDataFrame(links, "href string, resolved string")
    assert {r[0] for r in scope.covered(f, found).collect()} == cover and "/documents/" in cover
    assert sorted(str(r[0]) for r in scope.without_covered(f, found).collect()) == sorted(str(x) for x in fragments if x not in cover)
    assert scope.covered(f.where(F.lit(False)), found).count() == 0
