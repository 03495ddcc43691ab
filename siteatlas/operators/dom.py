"""The elements of documents as a table, and selectors over it.

A document is known by its url and a hash of its text, ``doc``, since one url
may have been answered with several.  An element has the number ``pre`` of its start in document order and the number
``last`` of the last element inside it.  Regions are nested, so an element is
inside one of a set exactly if the greatest ``last`` of the set's members that
start before it is not less than its own ``pre``: a running maximum over one
sort by (document, pre), with no pairs of elements.  A child is found by an
equi-join of its parent's number.  Documents that are alike in url and text have
the same elements, so frames go by ``pre`` and not by rows, and parents are made
distinct.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import classify

NODE = "source_url string, doc long, pre long, last long, level int, parent long, tag string, attrs map<string,string>"

#: What a document is known by.
DOCUMENT = ["source_url", "doc"]

# What an element loads, by its tag; others are "other".
RESOURCE_TYPES = {
    "script": "script", "img": "image", "image": "image", "iframe": "iframe", "frame": "iframe", "link": "link",
    "video": "media", "audio": "media", "source": "media", "track": "media", "a": "link", "area": "link",
    "object": "object", "embed": "object",
}


def dom_nodes(bodies: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """One row for each element of each document; ``bodies`` has url and body.

    Returns source_url, doc (a hash of the body), pre (from 0), last, level
    (from 0), parent (-1 at the top), tag and attrs.  Bodies of one url are
    documents of their own.  ``max_nodes`` keeps that many elements of a document,
    from its start; by default all.  A null or empty body has none.  Implied
    html, head and body elements are not added, and unclosed formatting ends
    with its parent.
    """

    def run(batches):
        from siteatlas.functions.markup import elements

        for batch in batches:
            for url, doc, body in zip(*(batch.column(c).to_pylist() for c in ("url", "doc", "body")), strict=True):
                rows = elements(body or "")[:max_nodes]
                if not rows:
                    continue
                last, level, parent, tag, attrs = zip(*rows, strict=True)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([url] * n, pa.string()),
                        pa.array([doc] * n, pa.int64()),
                        pa.array(range(n), pa.int64()),
                        pa.array([min(x, n - 1) for x in last], pa.int64()),
                        pa.array(level, pa.int32()),
                        pa.array(parent, pa.int64()),
                        pa.array(tag, pa.string()),
                        pa.array([list(a.items()) for a in attrs], pa.map_(pa.string(), pa.string())),
                    ],
                    ["source_url", "doc", "pre", "last", "level", "parent", "tag", "attrs"],
                )

    return bodies.select("url", F.xxhash64("body").alias("doc"), "body").mapInArrow(run, NODE)


@dataclass
class Compound:
    """What one element has to be; ``child``: of a parent that matches the part before, not of any ancestor."""

    tag: str = ""
    id: str = ""
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str, str]] = field(default_factory=list)
    child: bool = False

    def condition(self) -> Column:
        attr = lambda name: F.col("attrs")[name]
        tests = [F.lit(True)]
        if self.tag not in ("", "*"):
            tests.append(F.col("tag") == self.tag)
        if self.id:
            tests.append(attr("id") == self.id)
        for c in self.classes:
            tests.append(F.array_contains(F.split(classify.trimmed(attr("class")), r"\s+"), c))
        for name, op, value in self.attrs:
            v = attr(name)
            tests.append(
                {
                    "": v.isNotNull(),
                    "=": v == value,
                    "^=": v.startswith(value),
                    "$=": v.endswith(value),
                    "*=": v.contains(value),
                    "~=": F.array_contains(F.split(classify.trimmed(v), r"\s+"), value),
                }[op]
            )
        return F.coalesce(reduce(and_, tests), F.lit(False))


PART = re.compile(
    r"""(?P<tag>\*|[a-zA-Z0-9_-]+)|\#(?P<id>[a-zA-Z0-9_-]+)|\.(?P<class>[a-zA-Z0-9_-]+)"""
    r"""|\[\s*(?P<name>[a-zA-Z_-][a-zA-Z0-9_-]*)\s*(?:(?P<op>[\^$*~]?=)\s*(?:"(?P<dq>[^"\]]*)"|'(?P<sq>[^'\]]*)'|(?P<bare>[^\]"']*?))\s*)?\]"""
)
BETWEEN = re.compile(r"\s*(?P<what>[,>])\s*|\s+")


def parse_selector(selector: str) -> list[list[Compound]]:
    """Chains of compounds, one for each part between commas; a selector outside the subset is refused.

    The subset: tag, ``*``, ``#id``, ``.class``, ``[name]`` and ``[name op "value"]``
    with ``= ^= $= *= ~=``, descendants (a space) and children (``>``).
    """
    groups: list[list[Compound]] = [[]]
    text, at, fresh, child = selector.strip(), 0, True, False
    while at < len(text):
        m = PART.match(text, at)
        if m:
            if fresh:
                groups[-1].append(Compound(child=child))
                fresh = child = False
            c = groups[-1][-1]
            if m["tag"]:
                if c != Compound(child=c.child):
                    raise ValueError(f"a tag comes first: {selector!r}")
                c.tag = m["tag"].lower()
            elif m["id"]:
                if c.id:
                    raise ValueError(f"two ids: {selector!r}")
                c.id = m["id"]
            elif m["class"]:
                c.classes.append(m["class"])
            else:
                value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
                c.attrs.append((m["name"].lower(), m["op"] or "", value.strip()))
        else:
            m = BETWEEN.match(text, at)
            if not m or fresh:
                raise ValueError(f"not in the subset of selectors: {selector!r} at {at}")
            fresh, child = True, m["what"] == ">"
            if m["what"] == ",":
                groups.append([])
        at = m.end()
    if fresh:
        raise ValueError(f"not in the subset of selectors: {selector!r}")
    return groups


def marked(nodes: DataFrame, selector: str, name: str) -> DataFrame:
    """``nodes`` with a boolean column: whether ``selector`` matches the element."""
    before = Window.partitionBy(*DOCUMENT).orderBy("pre").rangeBetween(Window.unboundedPreceding, -1)
    flags, rows = [], nodes
    for g, chain in enumerate(parse_selector(selector)):
        tests = {f"__{name}_{g}_{k}": c.condition() for k, c in enumerate(chain)}
        rows = rows.withColumns(tests)
        so_far = f"__{name}_{g}_0"
        for k, c in enumerate(chain[1:], 1):
            here = f"__{name}_{g}_{k}"
            if c.child:
                parents = rows.where(so_far).select(*DOCUMENT, F.col("pre").alias("parent")).distinct().withColumn("__of", F.lit(True))
                rows = rows.join(parents, [*DOCUMENT, "parent"], "left").withColumn(here, F.col(here) & F.col("__of").isNotNull()).drop("__of")
            else:
                inside = F.max(F.when(F.col(so_far), F.col("last"))).over(before) >= F.col("pre")
                rows = rows.withColumn(here, F.col(here) & F.coalesce(inside, F.lit(False)))
            so_far = here
        flags.append(so_far)
    rows = rows.withColumn(name, reduce(or_, map(F.col, flags)))
    return rows.select(*nodes.columns, name)


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The elements that ``selector`` matches."""
    return marked(nodes, selector, "__match").where("__match").drop("__match")


def inside(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The rows of ``nodes`` that lie within an element of ``outer`` (source_url, doc, pre, last), themselves excepted."""
    both = nodes.withColumn("__outer", F.lit(None).cast("long")).unionByName(
        outer.select(*DOCUMENT, "pre", F.col("last").alias("__outer")), allowMissingColumns=True
    )
    # At the same place the element itself comes before the region that starts there.
    before = Window.partitionBy(*DOCUMENT).orderBy("pre", F.col("__outer").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("__outer").over(before)
    return both.withColumn("__reach", reach).where(F.col("__outer").isNull() & (F.col("__reach") >= F.col("pre"))).drop("__outer", "__reach")


def resources(nodes: DataFrame) -> DataFrame:
    """(source_url, doc, pre, url, method, type): what a browser loads for the elements; the targets of links are not loaded.

    src, each URL of srcset, each url() of style, and data of object, embed and applet.
    """
    attr = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in RESOURCE_TYPES.items() for x in kv))[F.col("tag")], F.lit("other"))
    data = F.when(F.col("tag").isin("object", "embed", "applet"), attr("data")).otherwise("")
    found = F.concat(F.array(attr("src")), classify.srcset(attr("srcset")), classify.css_urls(attr("style")), F.array(data))
    rows = nodes.select(*DOCUMENT, "pre", F.explode(found).alias("url"), F.lit("GET").alias("method"), kind.alias("type"))
    return rows.where("url <> ''")


def collections(nodes: DataFrame) -> DataFrame:
    """(source_url, name, n): how many forms, images, links and scripts each document has."""
    names = {"form": "forms", "img": "images", "a": "links", "script": "scripts"}
    name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("tag")]
    return nodes.select("source_url", name.alias("name")).where("name is not null").groupBy("source_url", "name").agg(F.count("*").alias("n"))
