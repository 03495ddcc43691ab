"""Elements as a table: regions against a tree in memory, selectors against walks over ancestors."""

import random

import pytest
from pyspark.sql import functions as F

from siteatlas.functions.markup import attributes, elements
from siteatlas.operators import dom

TAGS = ["div", "span", "ul", "b", "section"]


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        if parent:
            parent.children.append(self)

    def above(self):
        n = self.parent
        while n and n.tag:
            yield n
            n = n.parent


def random_page(rng, size):
    root = Node("", {}, None)
    nodes = []
    for _ in range(size):
        attrs = {k: rng.choice(v) for k, v in {"class": ["x", "x y", "z"], "id": ["m", "n"], "data-k": ["abc", "ab", ""]}.items() if rng.random() < 0.5}
        nodes.append(Node(rng.choice(TAGS), attrs, rng.choice([root, *nodes[-3:]])))

    def text(n):
        inner = " t ".join(map(text, n.children))
        if not n.tag:
            return inner
        return f"<{n.tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in n.attrs.items())}>{inner}</{n.tag}>"

    def walk(n):
        for c in n.children:
            yield c
            yield from walk(c)

    return text(root), list(walk(root))


def is_compound(n, s):
    """A compound of the test's own form: (tag, id, class, attribute, operator, value)."""
    tag, id_, cls, name, op, value = s
    v = n.attrs.get(name)
    held = {"": v is not None, "=": v == value, "^=": (v or "").startswith(value), "$=": (v or "").endswith(value), "*=": value in (v or "")}
    return (
        (tag in ("", "*") or n.tag == tag)
        and (not id_ or n.attrs.get("id") == id_)
        and (not cls or cls in n.attrs.get("class", "").split())
        and (not name or (v is not None and held[op]))
    )


def written(s):
    tag, id_, cls, name, op, value = s
    return (tag + (f"#{id_}" if id_ else "") + (f".{cls}" if cls else "") + (f'[{name}{op}"{value}"]' if op else f"[{name}]" if name else "")) or "*"


def matches(n, chain, joins):
    if not is_compound(n, chain[-1]):
        return False
    if len(chain) == 1:
        return True
    above = list(n.above())[: 1 if joins[-1] == ">" else None]
    return any(matches(a, chain[:-1], joins[:-1]) for a in above)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    return {f"https://h/{i}": random_page(rng, rng.choice([1, 5, 40, 120])) for i in range(12)}


def test_regions_match_a_tree(spark, pages):
    rows = spark.createDataFrame([(u, t) for u, (t, _) in pages.items()], "url string, body string")
    got = {(r.source_url, r.pre): r for r in dom.dom_nodes(rows).collect()}
    assert len(got) == sum(len(n) for _, n in pages.values())
    for url, (_, nodes) in pages.items():
        place = {id(n): k for k, n in enumerate(nodes)}
        for k, n in enumerate(nodes):
            r = got[url, k]
            inside = [j for j, d in enumerate(nodes) if any(a is n for a in d.above())]
            assert (r.last, r.level, r.tag) == (max(inside, default=k), len(list(n.above())), n.tag)
            assert r.parent == (place[id(n.parent)] if n.parent.tag else -1) and dict(r.attrs) == n.attrs


def test_selectors_match_walks(spark, pages):
    rng = random.Random(5)
    nodes = dom.dom_nodes(spark.createDataFrame([(u, t) for u, (t, _) in pages.items()], "url string, body string")).cache()
    for _ in range(12):
        chains = []
        for _ in range(rng.choice([1, 1, 2])):
            n = rng.choice([1, 2, 3])
            pick = lambda: (rng.choice(TAGS + ["", "*"]), rng.choice(["", "", "m"]), rng.choice(["", "x"]), *rng.choice([("", "", ""), ("data-k", "", ""), ("data-k", "=", "ab"), ("data-k", "^=", "a"), ("data-k", "$=", "c"), ("data-k", "*=", "b")]))
            chains.append(([pick() for _ in range(n)], [rng.choice([" ", ">"]) for _ in range(n - 1)]))
        text = ", ".join(written(c[0]) + "".join(f" {j} {written(s)}" for j, s in zip(joins, c[1:], strict=True)) for c, joins in chains)
        want = {(u, k) for u, (_, ns) in pages.items() for k, n in enumerate(ns) if any(matches(n, c, j) for c, j in chains)}
        assert {(r.source_url, r.pre) for r in dom.select(nodes, text).collect()} == want, text
    nodes.unpersist()


def test_inside_is_strict(spark, pages):
    nodes = dom.dom_nodes(spark.createDataFrame([(u, t) for u, (t, _) in pages.items()], "url string, body string"))
    got = {(r.source_url, r.pre) for r in dom.inside(nodes, nodes.where("tag = 'div'")).collect()}
    assert got == {(u, k) for u, (_, ns) in pages.items() for k, n in enumerate(ns) if any(a.tag == "div" for a in n.above())}
    assert dom.inside(nodes, nodes.where("tag = 'div'")).columns == nodes.columns


def test_no_pairs_of_elements(spark, pages):
    """A descendant selector is one sort by document and place: no join, one exchange."""
    nodes = dom.dom_nodes(spark.createDataFrame([("u", "<p>")], "url string, body string"))
    plan = dom.select(nodes, "div ul b span")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_markup_as_found():
    tags = lambda t: [(r[3], r[1], r[2]) for r in elements(t)]
    assert tags("<p>a<p>b<ul><li>1<li>2<ul><li>3</ul></ul>") == [("p", 0, -1), ("p", 0, -1), ("ul", 0, -1), ("li", 1, 2), ("li", 1, 2), ("ul", 2, 4), ("li", 3, 5)]
    assert tags("<div><b>x</div><i>y</b></i>") == [("div", 0, -1), ("b", 1, 0), ("i", 0, -1)]
    assert tags("<script>if (a<b) '<p>'</script><!-- <p> --><br><img src=a><x/>") == [("script", 0, -1), ("br", 0, -1), ("img", 0, -1), ("x", 0, -1)]
    assert tags("") == tags("plain < text") == tags("</p></div>") == []
    assert attributes("""A=1 b='two words' c="&amp;" d a=2""") == {"a": "1", "b": "two words", "c": "&", "d": ""}


def test_resources(spark):
    html = """<img src="/a.png" srcset="/b.png 1x, /c.png 2x"><a href="/no" style="background:url('/d.png')">x</a>
    <object data="/e.swf"></object><video src=/f.mp4></video><div data="/no" style="color:red"></div><script src="/g.js"></script>"""
    rows = dom.resources(dom.dom_nodes(spark.createDataFrame([("u", html), ("v", None), (None, "")], "url string, body string")))
    assert sorted((r.url, r.type) for r in rows.collect()) == [
        ("/a.png", "image"), ("/b.png", "image"), ("/c.png", "image"), ("/d.png", "link"), ("/e.swf", "object"), ("/f.mp4", "media"), ("/g.js", "script"),
    ]
    assert {r.method for r in rows.select(F.col("method")).collect()} == {"GET"}


def test_node_limit_and_refused_selectors(spark):
    rows = spark.createDataFrame([("u", "<div>" * 30 + "</div>" * 30)], "url string, body string")
    assert [(r.pre, r.last) for r in dom.dom_nodes(rows, max_nodes=3).orderBy("pre").collect()] == [(0, 2), (1, 2), (2, 2)]
    for bad in ["", "a + b", "a ~ b", "a:hover", "a,", "> a", "a > > b", "#", "#a#b", "[", "[=x]", "*a"]:
        with pytest.raises(ValueError):
            dom.parse_selector(bad)
