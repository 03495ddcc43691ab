"""Folding and counting of link rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import classify, url
from siteatlas.operators.extract import display_order, link_key
from siteatlas.rules import CATEGORIES, CLASSES, LINK_TYPES


def fold_params(links: DataFrame) -> DataFrame:
    """One row for each base URL and class; the queries it was seen with become ``param_variants``.

    The record of the bare URL gives the row its identity; without one the
    first queried record does, its query dropped.  First is by source, href and
    tag, so the result does not depend on the order of arrival.
    """
    base, query = url.split_query(link_key())
    rows = links.withColumn("base", base).withColumn("query", query)
    identity = ["href", "resolved", "source_url", "tag", "domain", "category", "link_type", "has_params"]
    bare = F.col("query") == ""
    lead = F.min_by(F.struct(*identity), F.struct((~bare).alias("q"), "source_url", "href", "tag"))
    variants = F.array_sort(F.collect_set(F.when(~bare, F.col("query"))))
    folded = rows.groupBy("base", "class").agg(lead.alias("l"), F.bool_or(bare).alias("has_bare"), variants.alias("param_variants"))
    kept = F.col("has_bare")
    return folded.select(
        F.when(kept, F.col("l.href")).otherwise(url.drop_query(F.col("l.href"))).alias("href"),
        F.when(kept, F.col("l.resolved")).otherwise(F.col("base")).alias("resolved"),
        "l.source_url",
        "l.tag",
        "l.domain",
        "l.category",
        "l.link_type",
        "class",
        (F.col("l.has_params") & kept).alias("has_params"),
        "param_variants",
    )


def merge_details(links: DataFrame) -> DataFrame:
    """One row per href; API details and query variants of its rows in union."""
    rest = [c for c in links.columns if c not in ("href", "api_details", "param_variants")]
    order = F.struct("source_url", "tag")
    details = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_url", "tag", F.col("api_details").alias("d")))), lambda r: r["d"])))
    variants = F.array_sort(F.array_distinct(F.flatten(F.collect_list("param_variants"))))
    return links.groupBy("href").agg(
        *(F.min_by(c, order).alias(c) for c in rest), details.alias("api_details"), variants.alias("param_variants")
    )


def sorted_for_display(links: DataFrame) -> DataFrame:
    return links.orderBy(*display_order())


def visible(links: DataFrame, show: set[str] | None = None) -> DataFrame:
    """Links without the hidden classes that are not asked for."""
    hidden = [c for c in CLASSES[1:] if c not in (show or set())]
    return links.where(~F.col("class").isin(hidden)) if hidden else links


def in_scope(links: DataFrame, domains: list[str], everything: bool = False) -> DataFrame:
    """Links on one of the domains or below; those without a host stay."""
    if everything:
        return links
    return links.where(url.host_in(url.host(link_key()), domains, empty=True))


def link_stats(links: DataFrame, show_tags: bool = False) -> DataFrame:
    """(dimension, key, n): counts by category, link type, class and tag, with the labels that do not occur.

    One pass over the links: each row is counted once for each dimension.
    """
    dims = {"category": CATEGORIES[1:], "link_type": LINK_TYPES[1:], "class": CLASSES}
    pairs = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in dims]
    flags = {
        "resolved": F.col("resolved") != "",
        "unresolved": F.col("href") != "",
        "with_params": F.col("has_params"),
        "total": F.lit(True),
    }
    pairs += [F.struct(F.lit("links").alias("dimension"), F.when(v, F.lit(k)).alias("key")) for k, v in flags.items()]
    if show_tags:
        pairs.append(F.struct(F.lit("tag").alias("dimension"), F.when(F.col("tag") != "", F.col("tag")).alias("key")))
    counted = links.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("key is not null")
    counted = counted.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))
    labels = [(d, k) for d, keys in dims.items() for k in keys] + [("links", k) for k in flags]
    empty = links.sparkSession.createDataFrame(labels, "dimension string, key string").withColumn("n", F.lit(0).cast("long"))
    return counted.union(empty).groupBy("dimension", "key").agg(F.sum("n").alias("n"))


def host_counts(links: DataFrame) -> DataFrame:
    """(host, n): links per host, most first."""
    own = url.host(link_key())
    h = F.when(F.col("domain") != "", F.col("domain")).when(own != "", own).otherwise("(relative)")
    return links.groupBy(h.alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host")


def tagged(links: DataFrame, rules) -> DataFrame:
    """Links whose tag is a custom one where a rule fits."""
    tag = classify.custom_tag(link_key(), rules)
    return links.withColumn("tag", F.when(tag != "", tag).otherwise(F.col("tag")))


# Owners of a recovered parameter in the order of their strength.
OWNERS = ["unassigned", "page", "request"]


def fold_fragments(params: DataFrame) -> DataFrame:
    """Recovered parameters of all documents: (name, kind) with the strongest owner, carriers, endpoints and documents."""
    owner = F.array_position(F.array(*map(F.lit, OWNERS)), F.col("owner"))
    top = F.max(owner)
    return params.groupBy("name", "kind").agg(
        F.element_at(F.array(*map(F.lit, OWNERS)), top.cast("int")).alias("owner"),
        F.coalesce(F.min_by("carrier", F.struct(F.when(F.col("carrier") != "", 0).otherwise(1), "doc", "carrier")), F.lit("")).alias("carrier"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("endpoints")))).alias("endpoints"),
        F.sum("count").alias("count"),
        F.array_sort(F.collect_set("doc")).alias("docs"),
    )


def observed_names(links: DataFrame) -> DataFrame:
    """Names that the rows' own annotation already shows."""
    shown = classify.format_variants(F.col("param_variants"))
    name = F.substring_index(F.substring_index(F.col("part"), "=", 1), "+", 1)
    parts = links.select(F.explode(F.split(shown, "; ", -1)).alias("part"))
    return parts.select(name.alias("name")).where("name <> ''").distinct()


def unseen_params(params: DataFrame, links: DataFrame) -> DataFrame:
    """Recovered parameters that no link row shows and no endpoint owns."""
    free = params.where((F.col("owner") != "request") | (F.size("endpoints") == 0))
    return free.join(observed_names(links), "name", "left_anti")


def valuable(links: DataFrame) -> DataFrame:
    """Links worth listing in a written report."""
    return links.where(~classify.is_skipped_in_report(F.col("href"), F.col("category")))


def page_log(visits: DataFrame) -> DataFrame:
    """(url, depth, content_type, links): least depth, first content type that is not empty, most links."""
    kind = F.min_by(F.col("content_type"), F.struct(F.when(F.col("content_type") != "", 0).otherwise(1), "seq"))
    return visits.groupBy("url").agg(F.min("depth").alias("depth"), kind.alias("content_type"), F.max("links").alias("links"))


def node_kind(href: Column, categories: Column, cls: Column, is_source: Column) -> Column:
    """What a node of the visual graph is: its class, a file of APIs, then API, page, asset."""
    asset = classify.asset_kind(href)
    return (
        F.when(cls != "normal", F.lower(cls))
        .when(is_source, "api-file")
        .when(F.array_contains(categories, "API"), "api")
        .when(F.array_contains(categories, "web-page"), "page")
        .when(F.array_contains(categories, "web-asset"), F.when(asset == "asset", "other").otherwise(asset))
        .otherwise("other")
    )


def visual_nodes(links: DataFrame) -> DataFrame:
    """(id, url, label, kind, queries): nodes of the visual graph, by URL without query."""
    base, query = url.split_query(link_key())
    rows = links.select(base.alias("url"), query.alias("query"), "category", "class", "source_url")
    apis = rows.where("category = 'API' and source_url <> ''").select(url.drop_query(F.col("source_url")).alias("url")).distinct()
    order = F.array_position(F.array(*map(F.lit, ["WAF", "CDN", "cache", "noise", "normal"])), F.col("class"))
    nodes = rows.groupBy("url").agg(
        F.collect_set("category").alias("categories"),
        F.min_by("class", order).alias("class"),
        F.array_sort(F.collect_set(F.when(F.col("query") != "", F.col("query")))).alias("queries"),
    )
    marked = nodes.join(apis.withColumn("source", F.lit(True)), "url", "left")
    script = F.coalesce(F.col("source"), F.lit(False)) & url.is_script(F.col("url"))
    return marked.select(
        classify.node_id(F.col("url")).alias("id"),
        "url",
        classify.short_label(F.col("url")).alias("label"),
        node_kind(F.col("url"), F.col("categories"), F.col("class"), script).alias("kind"),
        classify.format_variants(F.col("queries")).alias("params"),
    )


def visual_edges(links: DataFrame) -> DataFrame:
    """(from_id, to_id): distinct edges of the visual graph."""
    a, b = url.drop_query(F.col("source_url")), url.drop_query(link_key())
    rows = links.where("source_url <> ''").select(a.alias("a"), b.alias("b")).where("a <> b").distinct()
    return rows.select(classify.node_id(F.col("a")).alias("from_id"), classify.node_id(F.col("b")).alias("to_id"))
