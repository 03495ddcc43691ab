"""Registered queries over the supplied tables, one for each operator that they can exercise.

``pages`` stands for the captured responses; ``pages.url`` also for observed
GET requests.  Arrays are joined to strings so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.functions import classify, documents, url
from siteatlas.operators import contracts, extract, fold, graph, patterns
from siteatlas.operators.extract import link_key
from siteatlas.plans.session import glob_match, is_kind
from siteatlas.sources.tables import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", F.col("html").alias("body"))


def rows_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with a number for each, where pages of one url count apart."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_resolved(extract.extract_links(bodies(spark, sf_dir)))


def url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own URLs as links of an index page."""
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("href"), F.lit("a").alias("tag"), F.col("page_id").alias("seq"))
    rows = extract.described(rows, extract.CLI_RULES)
    return rows.withColumns(
        {"resolved": F.col("href"), "domain": url.host(F.col("href")), "source_url": F.lit("https://index.example/"), "depth": F.lit(1)}
    )


def joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, "|") for n in names})


def url_patterns(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return patterns.find_patterns(table(spark, sf_dir, "pages"), **how)


@query
def extract_links(spark, sf_dir):
    return extract.extract_links(bodies(spark, sf_dir)).drop("rank", "pos")


@query
def match_counts(spark, sf_dir):
    m = extract.matches(bodies(spark, sf_dir))
    return m.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw").alias("n_distinct"))


@query
def resolve_links(spark, sf_dir):
    return links(spark, sf_dir).select("source_url", "href", "resolved", "domain")


@query
def classify_links(spark, sf_dir):
    h = F.col("href")
    hrefs = links(spark, sf_dir).select("href").distinct()
    return hrefs.select(
        "href",
        classify.asset_kind(h).alias("asset"),
        classify.custom_tag(h).alias("custom_tag"),
        url.is_script(h).alias("is_script"),
        classify.is_noise(h).alias("is_noise"),
        classify.looks_like_url(h).alias("looks_like_url"),
        classify.looks_like_endpoint(h).alias("endpoint"),
        documents.is_document_url(h).alias("is_document"),
        classify.api_path_key(h).alias("api_key"),
    )


@query
def reference_positions(spark, sf_dir):
    found = extract.references(rows_apart(bodies(spark, sf_dir)), ["row"]).groupBy("source_url", "row")
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("line").alias("last_line")).drop("row")


@query
def reference_details(spark, sf_dir):
    return extract.references(bodies(spark, sf_dir))


@query
def inline_scripts(spark, sf_dir):
    return extract.inline_scripts(bodies(spark, sf_dir))


@query
def text_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", F.concat(F.lit("see "), F.col("url"), F.lit("), or")).alias("body"))
    return extract.text_urls(rows).select("source_url", "href", "category", "link_type")


@query
def text_urls_in_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("body"))
    return extract.text_urls(rows).select("source_url", "href", "class")


@query
def link_stats(spark, sf_dir):
    return fold.link_stats(links(spark, sf_dir), show_tags=True)


@query
def host_counts(spark, sf_dir):
    return fold.host_counts(links(spark, sf_dir))


@query
def hidden_classes(spark, sf_dir):
    return url_links(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query
def visible_in_scope(spark, sf_dir):
    rows = fold.visible(fold.in_scope(url_links(spark, sf_dir), ["example.com", "site1.example.org"]))
    return rows.select("href", "domain", "class")


@query
def display_rows(spark, sf_dir):
    rows = fold.sorted_for_display(links(spark, sf_dir).select("href", "domain", "category", "class").distinct())
    return rows.select("href", "domain", "category", "class")


@query
def fold_params(spark, sf_dir):
    return joined(fold.fold_params(url_links(spark, sf_dir)), "param_variants")


@query
def param_annotations(spark, sf_dir):
    f = fold.fold_params(url_links(spark, sf_dir))
    return f.select("resolved", classify.format_variants(F.col("param_variants")).alias("params"))


@query
def observed_names(spark, sf_dir):
    return fold.observed_names(fold.fold_params(url_links(spark, sf_dir)))


@query
def valuable_links(spark, sf_dir):
    return fold.valuable(links(spark, sf_dir)).select("source_url", "href", "category")


@query
def canonical_urls(spark, sf_dir):
    c = patterns.canonical_urls(table(spark, sf_dir, "pages"))
    return joined(c, "segs")


@query
def segment_kinds(spark, sf_dir):
    c = patterns.canonical_urls(table(spark, sf_dir, "pages")).select(F.explode("segs").alias("seg")).distinct()
    return c.select("seg", classify.segment_kind(F.col("seg")).alias("kind"))


@query
def find_patterns(spark, sf_dir):
    return joined(url_patterns(spark, sf_dir).drop("vars"), "mask", "members")


@query
def find_string_patterns(spark, sf_dir):
    return joined(url_patterns(spark, sf_dir, group_strings=True).drop("vars"), "mask", "members")


@query
def describe_patterns(spark, sf_dir):
    d = joined(patterns.described_patterns(url_patterns(spark, sf_dir)), "slots")
    return d.select("domain", "pattern", "grouped_by", "annotation", "slots")


@query
def cluster_ranges(spark, sf_dir):
    return patterns.cluster_ranges(url_patterns(spark, sf_dir))


@query
def pattern_kinds(spark, sf_dir):
    return patterns.pattern_kinds(url_patterns(spark, sf_dir), url_links(spark, sf_dir))


@query
def pattern_shapes(spark, sf_dir):
    rows = patterns.masked(patterns.canonical_urls(table(spark, sf_dir, "pages")))
    return joined(patterns.shapes(rows), "kinds", "mask")


@query
def pattern_members(spark, sf_dir):
    return patterns.pattern_members(table(spark, sf_dir, "pages"))


@query
def without_pattern_members(spark, sf_dir):
    members = patterns.pattern_members(table(spark, sf_dir, "pages"))
    return patterns.without_members(url_links(spark, sf_dir), members).select("href", "category")


@query
def best_patterns(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = patterns.shapes(patterns.masked(patterns.canonical_urls(pages)), group_strings=True)
    return patterns.best_pattern(pages.select("url"), found)


def page_observations(spark, sf_dir) -> DataFrame:
    return contracts.get_observations(table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("seq")))


@query
def contract_endpoints(spark, sf_dir):
    return joined(contracts.infer_contracts(page_observations(spark, sf_dir))["endpoints"], "methods", "raw")


@query
def contract_fields(spark, sf_dir):
    f = contracts.infer_contracts(page_observations(spark, sf_dir))["contract_fields"]
    return joined(f, "values").select("path", "section", "name", "kind", "values", "constant", "const_val", "inferred")


@query
def contract_kinds(spark, sf_dir):
    obs = page_observations(spark, sf_dir).withColumn("path", contracts.contract_path(F.col("url"))).where("path is not null")
    obs = obs.withColumn("shape", F.lit(None).cast("struct<kind: string, mime: string, sample: string, methods: array<string>, fields: array<struct<name: string, value: string>>>"))
    k = contracts.field_kinds(contracts.field_values(contracts.field_rows(obs)))
    return k.select("path", "name", "kind", "n_values", "const_val", "inferred")


@query
def pattern_contracts(spark, sf_dir):
    obs = contracts.on_patterns(page_observations(spark, sf_dir), url_patterns(spark, sf_dir), url_links(spark, sf_dir))
    e = contracts.infer_contracts(obs)["endpoints"]
    return e.select("path", "calls")


@query
def event_bodies(spark, sf_dir):
    """Bodies of events as requests to one endpoint for each event type."""
    ev = table(spark, sf_dir, "events")
    empty = F.array().cast(contracts.PAIRS)
    obs = ev.select(
        F.concat(F.lit("https://api.example/v1/"), F.col("event_type")).alias("url"),
        F.lit("POST").alias("method"),
        empty.alias("headers"),
        F.coalesce("props", F.lit("")).alias("body"),
        F.array().cast("array<struct<path: string, kind: string>>").alias("response_fields"),
        F.lit(False).alias("endpoint_only"),
        F.lit(False).alias("method_inferred"),
        empty.alias("inferred_query"),
        F.col("event_id").cast("long").alias("seq"),
    )
    f = contracts.infer_contracts(obs)["contract_fields"]
    return f.select("path", "body_kind", "name", "kind", F.size("values").alias("n_values"))


@query
def source_edges(spark, sf_dir):
    e = graph_edges(spark, sf_dir)
    return e.where("kind = 'source'").select("from_key", "to_key")


def graph_edges(spark, sf_dir) -> DataFrame:
    found = written(with_seq(links(spark, sf_dir)), "found")  # read by the nodes, and several times by the edges
    made = graph.normalize(found).where("synthesized").select("href", "resolved", "source_url")
    l = found.select("href", "resolved", "source_url").unionByName(made)
    pages = table(spark, sf_dir, "pages").select("url")
    ends = contracts.infer_contracts(page_observations(spark, sf_dir))["endpoints"]
    params = spark.createDataFrame([], "name string, kind string, endpoints array<string>")
    return graph.derive_edges(l, pages, url_patterns(spark, sf_dir), ends, params)


def with_seq(l: DataFrame) -> DataFrame:
    return l.select(
        "href", "resolved", "domain", "category", "link_type", "class", F.lit(1).alias("depth"), "has_params",
        F.array().cast("array<string>").alias("param_variants"), "source_url", "tag",
        F.xxhash64("source_url", "href").alias("seq"),
    )


@query
def edge_counts(spark, sf_dir):
    return graph.edge_counts(graph_edges(spark, sf_dir))


@query
def normalize_links(spark, sf_dir):
    n = graph.normalize(with_seq(links(spark, sf_dir)), "https://index.example/")
    return n.groupBy("synthesized").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("param_variants") > 0).alias("with_query"))


@query
def page_parents(spark, sf_dir):
    e = graph_edges(spark, sf_dir).where("kind = 'source'")
    return e.groupBy("to_key").agg(F.count(F.lit(1)).alias("n"), F.min("from_key").alias("first_parent"))


@query
def first_sources(spark, sf_dir):
    return graph.first_source(graph_edges(spark, sf_dir))


@query
def find_pages(spark, sf_dir):
    l = url_links(spark, sf_dir).withColumn("key", link_key())
    return l.where(is_kind("page") & glob_match(F.col("key"), "en/*")).select("key").distinct()


@query
def place_keys(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "url", url.path_only(u).alias("path_only"), url.place_key(u).alias("place"), url.short_source(u).alias("short"),
        url.host_path_key(u).alias("host_path"),
    )


@query
def strip_cache_busters(spark, sf_dir):
    base, fragment = url.cut_at(F.col("url"), "#"), F.regexp_extract("url", "(#.*)$", 1)
    busted = F.concat(base, F.when(base.contains("?"), F.lit("&t=1&q=x")).otherwise(F.lit("?q=x&ts=9")), fragment)
    rows = table(spark, sf_dir, "pages").select(busted.alias("url"))
    return rows.select("url", url.without_cache_busters(F.col("url")).alias("stripped"))


@query
def masked_queries(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", classify.redact_query(F.concat(url.raw_query(F.col("url")), F.lit("&token=abc"))).alias("q"))


@query
def visual_nodes(spark, sf_dir):
    return fold.visual_nodes(url_links(spark, sf_dir))


@query
def visual_edges(spark, sf_dir):
    return fold.visual_edges(links(spark, sf_dir))


@query
def union_first_wins(spark, sf_dir):
    u = url_links(spark, sf_dir).select("href", "resolved", F.col("seq").alias("n"))
    # Two captures that overlap and cover all pages between them.
    a, b = u.where("n % 3 <> 0"), u.where("n % 2 = 0 or n % 3 = 0").withColumn("n", -F.col("n"))
    return graph.first_file_wins(a, b, [link_key()])


@query
def page_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    visits = ev.select(
        F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string")).alias("url"),
        (F.col("event_id") % 5).cast("int").alias("depth"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("content_type"),
        (F.col("event_id") % 17).cast("int").alias("links"),
        F.col("event_id").alias("seq"),
    )
    return fold.page_log(visits)


@query
def document_kinds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(""))
    k = documents.kinds(F.encode("text", "UTF-8"), name, F.lit(""))
    return d.select(
        "doc_id",
        F.array_join(k, "|").alias("kinds"),
        documents.looks_like_code(F.col("text")).alias("code"),
        documents.looks_like_markup(F.col("text")).alias("markup"),
    )


@query
def crawl(spark, sf_dir):
    from siteatlas.operators.crawl import CrawlOptions
    from siteatlas.operators.crawl import crawl as run

    pages = table(spark, sf_dir, "pages")
    responses = pages.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"))
    start = pages.agg(F.min("url")).first()[0]
    return run(responses, start, CrawlOptions(max_depth=5))["links"].select("href", "resolved", "source_url", "depth", "category")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's link table: extracted, resolved, visible, folded, sorted."""
    l = fold.visible(links(spark, sf_dir))
    return joined(fold.sorted_for_display(fold.fold_params(l)), "param_variants")
