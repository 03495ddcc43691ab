"""Connected components by alternating large and small stars, each round a written table.

An edge list goes in, (node, label) rows come out; no task sees a component as
a whole and nothing but two numbers a round reaches the driver.  The minimum of
a node's neighbours is a grouped aggregation, combined before the exchange, and
goes back to the edges by a join that adaptive execution can split, so a node
with very many edges is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import written

#: Edges to a file of a round's table, so that few edges are no crowd of small files.
FILE_ROWS = 100_000


def large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them; edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    up = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.union(least.select("a", F.col("m").alias("b"))).distinct()


def links_left(edges: DataFrame) -> tuple[int, int]:
    """The number of edges (a > b), and of nodes that keep them from being stars: two lesser neighbours, or one and a larger one.

    Without such nodes each component is one star around its least node.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    inner = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))
    n, left = nodes.agg(F.sum("down"), F.count_if(inner)).first()
    return n or 0, left


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a and b); label is the least node of its component.

    Self-loops, repeated edges and either direction are allowed; no edges give
    an empty result.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    n, left = links_left(now)
    while left:
        # A round makes no edges more, so the last count tells how many files are enough.
        now = written(small_star(large_star(now)).coalesce(-(-n // FILE_ROWS)), "edges")
        n, left = links_left(now)
    return (
        now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        .union(now.select(F.col("b").alias("node"), F.col("b").alias("label")))
        .distinct()
    )
