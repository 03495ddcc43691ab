"""The crawl as a forest: parents, depth-first order, totals below, and a cut that says what it leaves out.

Numbers along a branch are found by pointer doubling: each round a node takes
over what the node it points to has gathered, and points twice as far, so a
tree of depth d takes log2(d) rounds of joins by key, whatever its shape.
Children are put in order by offsets: what a node's earlier siblings hold is a
running sum in two passes, per range and then over the ranges, so a node with
very many children is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.sources.tables import written


def forest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, parent, depth): each page at its least depth from a root, under its first parent; parent is null for roots.

    ``edges`` has from_key and to_key.  The walk starts at ``roots`` (key) and
    at pages that nothing links to; of what it does not reach, which are cycles
    and what hangs on them, pages that come before all that link to them are
    roots of their own, until all are reached.  One join for each level, as many
    as there are.
    """
    steps = written(edges.where("from_key <> to_key").select("from_key", "to_key").distinct(), "steps")
    keys = written(steps.select(F.col("from_key").alias("key")).union(steps.select("to_key")).union(roots.select("key")).where("key is not null").distinct(), "keys")
    starts = roots.select("key").union(keys.join(steps.select(F.col("to_key").alias("key")), "key", "left_anti")).where("key is not null").distinct()
    seen = None
    while True:
        seen = walked(steps, starts, seen)
        left = written(keys.join(seen.select("key"), "key", "left_anti"), "left")
        if left.isEmpty():
            return seen
        inner = steps.join(left.withColumnRenamed("key", "from_key"), "from_key").join(left.withColumnRenamed("key", "to_key"), "to_key")
        starts = inner.groupBy("to_key").agg(F.min("from_key").alias("least")).where("to_key < least").select(F.col("to_key").alias("key"))


def walked(steps: DataFrame, starts: DataFrame, seen: DataFrame | None) -> DataFrame:
    """``seen`` with all that ``starts`` reach, breadth first."""
    level = written(starts.select("key", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")), "level")
    seen, depth = level if seen is None else seen.union(level), 0
    while not level.isEmpty():
        depth += 1
        found = level.select(F.col("key").alias("from_key")).join(steps, "from_key").groupBy(F.col("to_key").alias("key")).agg(F.min("from_key").alias("parent"))
        level = written(found.join(seen.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth)), "level")
        seen = written(seen.union(level), "seen") if depth % 8 == 0 else seen.union(level)
    return seen


def up_the_branch(nodes: DataFrame, value: str, name: str) -> DataFrame:
    """(key, <name>): the sum of ``value`` over a node and all above it; ``nodes`` has key, parent and the value."""
    now = written(nodes.select("key", F.col("parent").alias("up"), F.col(value).cast("long").alias("v")), "branch")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("v").alias("more"))
        now = written(now.join(above, "up", "left").select("key", F.col("next").alias("up"), (F.col("v") + F.coalesce("more", F.lit(0))).alias("v")), "branch")
    return now.select("key", F.col("v").alias(name))


def totals_below(nodes: DataFrame, value: str, name: str) -> DataFrame:
    """(key, <name>): the sum of ``value`` over a node and all below it.

    In each round a node adds what the nodes that point to it have gathered: at
    first its children, then those twice as far below.
    """
    now = written(nodes.select("key", F.col("parent").alias("up"), F.col(value).cast("long").alias("v")), "totals")
    while not now.where("up is not null").isEmpty():
        given = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("v").alias("more"))
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        moved = now.join(above, "up", "left").select("key", F.col("next").alias("up"), "v")
        now = written(moved.join(given, "key", "left").select("key", "up", (F.col("v") + F.coalesce("more", F.lit(0))).alias("v")), "totals")
    return now.select("key", F.col("v").alias(name))


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each in ``order``: sums per range, then over the ranges.

    Only one number for each range is in one place.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__range", "__start")


def depth_first(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, parent, depth) with ``below`` (pages under each) and ``place``: their order in a depth-first walk, from 0.

    Roots and children go by key.
    """
    sized = written(nodes.join(totals_below(nodes.withColumn("__one", F.lit(1)), "__one", "__size"), "key"), "sized")
    family = F.coalesce("parent", F.lit(""))
    summed = written(running_total(sized.withColumn("__family", family), ["__family", "key"], "__size", "__before"), "summed")
    first = summed.groupBy("__family").agg(F.min("__before").alias("__start"))
    # From a parent to a child: the parent itself, and the earlier siblings with all below them.
    step = F.col("__before") - F.col("__start") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    stepped = summed.join(first, "__family").withColumn("__step", step)
    placed = up_the_branch(stepped, "__step", "place")
    return sized.join(placed, "key").select("key", "parent", "depth", (F.col("__size") - 1).alias("below"), "place")


def shown_tree(nodes: DataFrame, max_depth: int = 0) -> DataFrame:
    """The walk cut below ``max_depth`` (0: not at all): key, parent, depth, place and ``hidden``.

    ``hidden`` is, for a page at the cut, how many pages below it are left out,
    and else 0; their sum over all rows is what the tree does not show.
    """
    walked = depth_first(nodes)
    if not max_depth:
        return walked.withColumn("hidden", F.lit(0).cast("long"))
    hidden = F.when(F.col("depth") == max_depth, F.col("below")).otherwise(0)
    return walked.where(F.col("depth") <= max_depth).withColumn("hidden", hidden)
