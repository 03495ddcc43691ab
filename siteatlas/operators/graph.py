"""The property graph of a capture: nodes, typed edges by key, normalisation, walks and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import url
from siteatlas.operators.extract import code_of, first_of, link_key
from siteatlas.operators.tree import running_total
from siteatlas.rules import CATEGORIES
from siteatlas.sources.tables import written

EDGE_KINDS = ["source", "crawled", "pattern", "contract", "param"]
EMPTY_LINK = {
    "domain": "''", "category": "'web-page'", "link_type": "'absolute'", "class": "'normal'", "depth": "0",
    "has_params": "false", "param_variants": "cast(array() as array<string>)", "source_url": "''", "tag": "''",
}


def edge(kind: str, a, b) -> list:
    return [F.lit(kind).alias("kind"), a.alias("from_key"), b.alias("to_key"), F.lit(1).alias("weight")]


def derive_edges(links: DataFrame, pages: DataFrame, patterns: DataFrame, endpoints: DataFrame, params: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Edges of the five kinds, each by equality of keys, with those already stated.

    The keys of links are written once: four joins read them, and extraction
    must not run four times.
    """
    keyed = written(links.select(link_key().alias("key"), "source_url").distinct(), "keys")
    nodes = keyed.select("key").distinct()
    sources = keyed.where("source_url <> ''").join(nodes.withColumnRenamed("key", "source_url"), "source_url", "left_semi")
    crawled = sources.join(pages.select(F.col("url").alias("key")).distinct(), "key", "left_semi")
    members = patterns.select("pattern", F.explode("members").alias("key")).join(nodes, "key", "left_semi")
    paths = endpoints.select(F.col("path").alias("key")).distinct()
    contracts = nodes.join(paths, "key", "left_semi")
    fed = params.select("name", "kind", F.explode("endpoints").alias("key")).join(paths, "key", "left_semi")
    tables = [
        sources.select(*edge("source", F.col("source_url"), F.col("key"))),
        crawled.select(*edge("crawled", F.col("source_url"), F.col("key"))),
        members.select(*edge("pattern", F.col("pattern"), F.col("key"))),
        contracts.select(*edge("contract", F.col("key"), F.col("key"))),
        fed.select(*edge("param", F.concat_ws("|", "name", "kind"), F.col("key"))),
    ]
    found = tables[0]
    for t in [*tables[1:], *([more] if more is not None else [])]:
        found = found.unionByName(t)
    return distinct_edges(found)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each kind, start and end; the strongest weight stays."""
    return edges.groupBy("kind", "from_key", "to_key").agg(F.max("weight").alias("weight"))


def merge_links(links: DataFrame) -> DataFrame:
    """One row per URL: the first record's values where it has any, else the next one's.

    ``seq`` gives the order of the records.
    """
    filled = lambda c, empty: F.min_by(
        F.col(c), F.struct(F.when(F.col(c).isin(*empty), 1).otherwise(0), "seq")
    ).alias(c)
    depth = F.coalesce(F.min(F.when(F.col("depth") > 0, F.col("depth"))), F.lit(0)).alias("depth")
    lists = F.array_distinct(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("param_variants").alias("v")))), lambda r: r["v"]))
    )
    return links.withColumn("key", link_key()).groupBy("key").agg(
        *(filled(c, [""]) for c in ("href", "resolved", "domain", "tag", "source_url")),
        filled("category", ["unknown"]),
        filled("link_type", ["unknown"]),
        filled("class", ["normal"]),
        depth,
        F.bool_and("synthesized").alias("synthesized"),
        F.bool_or("has_params").alias("has_params"),
        lists.alias("param_variants"),
    )


def normalize(links: DataFrame, target: str = "") -> DataFrame:
    """Links with a node for every source and the target, duplicates merged, queries recorded.

    Needs ``seq``, the order of the records.  Applying it twice changes nothing.
    """
    keys = links.select(link_key().alias("key")).distinct()
    wanted = links.where("source_url <> ''").select(F.col("source_url").alias("key"))
    if target:
        wanted = wanted.union(links.sparkSession.createDataFrame([(target,)], "key string"))
    missing = wanted.distinct().join(keys, "key", "left_anti")
    made = missing.select(
        F.col("key").alias("href"),
        F.col("key").alias("resolved"),
        *(F.expr(v).alias(k) for k, v in EMPTY_LINK.items()),
        F.lit(True).alias("synthesized"),
        F.lit(1 << 62).alias("seq"),
    )
    every = links.withColumn("synthesized", F.lit(False) if "synthesized" not in links.columns else F.col("synthesized")).unionByName(made)
    query = url.raw_query(F.col("key"))
    return merge_links(every).withColumn(
        "param_variants",
        F.when((F.size("param_variants") == 0) & (query != ""), F.array(query)).otherwise(F.col("param_variants")),
    )


def first_source(edges: DataFrame) -> DataFrame:
    """(to_key, source_url): the first source of each node, by key."""
    rows = edges.where("kind = 'source'")
    return first_of(rows, ["to_key"], ["from_key"]).select("to_key", F.col("from_key").alias("source_url"))


def out_links(edges: DataFrame, links: DataFrame, kind: str, key: str) -> DataFrame:
    """Links at the end of a node's edges of a kind."""
    ends = edges.where((F.col("kind") == kind) & (F.col("from_key") == key)).select("to_key").distinct()
    return links.join(ends, link_key() == ends["to_key"], "left_semi")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def deepest_page(pages: DataFrame) -> DataFrame:
    """(depth): how deep the crawl went; 0 without pages."""
    return pages.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


def in_file_order(links: DataFrame) -> DataFrame:
    """Links with ``nth``: their place in a capture's file, by key, category and href, so that neighbours of the site are neighbours.

    Numbered by ranges, without a sort of all links in one task.
    """
    keyed = links.withColumns({"__key": link_key(), "__category": code_of(F.col("category"), CATEGORIES), "__one": F.lit(1)})
    return running_total(keyed, ["__key", "__category", "href"], "__one", "nth").drop("__key", "__category", "__one")


def first_file_wins(a: DataFrame, b: DataFrame, keys: list) -> DataFrame:
    """Union of two tables; of rows with equal keys those of the first table stay."""
    rows = a.withColumn("__file", F.lit(0)).unionByName(b.withColumn("__file", F.lit(1)), allowMissingColumns=True)
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    rows = rows.withColumns(named)
    kept = rows.groupBy(*named).agg(F.min("__file").alias("__first"))
    same = [rows[k].eqNullSafe(kept[k]) for k in named] + [rows["__file"] == kept["__first"]]
    return rows.join(kept, same, "left_semi").drop("__file", *named)


UNION_KEYS = {
    "links": lambda: [link_key()],
    "pages": lambda: [F.col("url")],
    "endpoints": lambda: [F.col("path")],
    "patterns": lambda: [F.col("domain"), F.col("pattern")],
    "params": lambda: [F.col("name"), F.col("kind"), F.col("owner"), F.col("carrier"), F.array_sort("endpoints")],
    "archive": lambda: [F.col("name")],
}


def union_captures(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two captures as one: by key, the first wins; observations in sequence; edges distinct."""
    out = {}
    for name in {**a, **b}:
        if name not in a or name not in b:
            out[name] = a.get(name, b.get(name))
        elif name in UNION_KEYS:
            out[name] = first_file_wins(a[name], b[name], UNION_KEYS[name]())
        elif name == "edges":
            out[name] = distinct_edges(a[name].unionByName(b[name]))
        elif name == "meta":
            out[name] = first_file_wins(a[name], b[name], [F.col("key")])
        else:
            out[name] = a[name].unionByName(b[name], allowMissingColumns=True)
    return out


def crawl_tree(edges: DataFrame, root: str, max_depth: int = 20) -> DataFrame:
    """(key, parent, depth): each page once, at its least depth, under its first parent.

    Breadth first, a join for each level; stops when a level adds nothing.
    """
    spark = edges.sparkSession
    steps = edges.where("kind = 'crawled'").select("from_key", "to_key").distinct()
    seen = written(spark.createDataFrame([(root, "", 0)], "key string, parent string, depth int"), "level")
    level = seen
    for depth in range(1, max_depth + 1):
        found = level.join(steps, level["key"] == steps["from_key"]).select("to_key", "from_key")
        new = found.groupBy("to_key").agg(F.min("from_key").alias("parent"))
        new = new.join(seen, new["to_key"] == seen["key"], "left_anti")
        level = written(new.select(F.col("to_key").alias("key"), "parent", F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen
