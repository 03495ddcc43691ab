"""Tables of a sandbox run: network calls that scripts made, recorded elsewhere and folded here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import classify, url

NET_CALL = (
    "url string, raw_url string, method string, initiator string, type string, body string, "
    "headers array<struct<name: string, value: string>>"
)
# Call types that carry data, and the order in which a report has types.
DATA_TYPES = ["fetch", "xhr", "beacon", "eventsource", "websocket", "form"]
TYPE_ORDER = ["fetch", "xhr", "websocket", "beacon", "image", "script", "other"]
SKIPPED_SCHEMES = ["data:", "blob:", "javascript:", "about:", "mailto:", "tel:", "#"]
MAX_ERRORS = 40


def recorded_calls(hits: DataFrame) -> DataFrame:
    """Sink hits (page_url, raw_url, method, type, initiator, body, headers) as calls with absolute URLs."""
    raw = url.trimmed(F.col("raw_url"))
    skip = (raw == "") | classify.starts_with_any(F.lower(raw), SKIPPED_SCHEMES)
    initiator = F.when(F.col("initiator") != "", F.col("initiator")).otherwise(F.col("page_url"))
    return hits.where(~skip).select(
        url.resolve(F.col("page_url"), raw).alias("url"),
        raw.alias("raw_url"),
        F.upper("method").alias("method"),
        initiator.alias("initiator"),
        "type",
        "body",
        "headers",
    )


def distinct_calls(calls: DataFrame, strip: bool = False) -> DataFrame:
    """One call for each type, method, URL and payload; ``strip`` drops cache-busting keys first."""
    rows = calls.withColumn("url", url.without_cache_busters(F.col("url"))) if strip else calls
    return rows.withColumn("payload", F.xxhash64("body", F.to_json("headers"))).dropDuplicates(
        ["type", "method", "url", "payload"]
    ).drop("payload")


def call_counts(calls: DataFrame) -> DataFrame:
    """(type, n) in the order of reports."""
    rank = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type"))
    counts = calls.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.when(rank == 0, len(TYPE_ORDER) + 1).otherwise(rank), "type")


def call_links(calls: DataFrame) -> DataFrame:
    """Calls as link rows: data calls are APIs, others what their URL says."""
    data = F.col("type").isin(DATA_TYPES)
    return calls.select(
        F.col("url").alias("href"),
        F.col("url").alias("resolved"),
        url.host(F.col("url")).alias("domain"),
        F.when(data, "API").otherwise(classify.category(F.col("url"))).alias("category"),
        url.link_type(F.col("url")).alias("link_type"),
        classify.url_class(F.col("url")).alias("class"),
        F.concat(F.lit("emu-"), F.col("type")).alias("tag"),
        F.col("initiator").alias("source_url"),
    )


def call_observations(calls: DataFrame) -> DataFrame:
    """Data calls as observations for contract inference."""
    from siteatlas.operators.contracts import PAIRS

    rows = calls.where(F.col("type").isin(DATA_TYPES))
    return rows.select(
        "url",
        "method",
        "headers",
        "body",
        F.array().cast("array<struct<path: string, kind: string>>").alias("response_fields"),
        F.lit(False).alias("endpoint_only"),
        F.lit(False).alias("method_inferred"),
        F.array().cast(PAIRS).alias("inferred_query"),
        F.xxhash64("url", "method", "body").alias("seq"),
    )


def summary(calls: DataFrame, errors: DataFrame, scripts: int = 0) -> DataFrame:
    """One row: scripts, calls, calls by type, distinct errors; at most 40 errors are listed."""
    by_type = call_counts(calls).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls"))
    distinct = errors.select(classify.emulation_error(F.col("error")).alias("error")).distinct()
    listed = distinct.agg(F.count(F.lit(1)).alias("errors"))
    first = distinct.orderBy("error").limit(MAX_ERRORS).agg(F.array_sort(F.collect_list("error")).alias("error_list"))
    return by_type.crossJoin(listed).crossJoin(first).select(F.lit(scripts).alias("scripts"), "calls", "by_type", "errors", "error_list")
