"""Incremental captures: Structured Streaming forms of the stateful steps of a crawl.

State is bounded: the page log and the de-duplication drop what the watermark
on ``fetched_at`` leaves behind, and the pattern detector keeps the last 250
URLs of a host and the shapes it confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import classify, url

SAMPLES = 250
SLOT = "\x1f"


def page_log_stream(visits: DataFrame) -> DataFrame:
    """(url, depth, content_type, links) as an updating aggregate over url, depth, content_type, links, seq."""
    from siteatlas.operators.fold import page_log

    return page_log(visits)


def pages_in_windows(visits: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, host, pages): fetched pages of a host in windows of event time; late rows beyond the watermark go."""
    w = F.window("fetched_at", window)
    counts = visits.withWatermark("fetched_at", late).groupBy(w.alias("w"), url.host(F.col("url")).alias("host"))
    return counts.agg(F.count(F.lit(1)).alias("pages")).select(F.col("w.start").alias("start"), "host", "pages")


def distinct_observations(observations: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of equal requests within the watermark."""
    keyed = observations.withWatermark("fetched_at", late).withColumn("payload", F.xxhash64("body", F.to_json("headers")))
    return keyed.dropDuplicatesWithinWatermark(["method", "url", "payload"]).drop("payload")


def kind_of_segment(seg: str) -> str:
    """The kind of a path segment, by the rules of the column expression."""
    import re

    if not seg or "{" in seg or "}" in seg:
        return ""
    if re.fullmatch("[0-9]+", seg):
        return "int"
    if re.fullmatch("(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", seg):
        return "uuid"
    if len(seg) >= 8 and re.fullmatch(r"[0-9A-Za-z+/_\-]+={0,2}", seg) and (seg.endswith("=") or set("+/") & set(seg)):
        return "base64"
    return "hash" if re.fullmatch(r"[0-9A-Za-z_\-]{16,}", seg) else "string"


def shapes(paths: list[list[str]], min_count: int, group_strings: bool) -> set[tuple[str, ...]]:
    """Confirmed shapes of one host's paths; a slot is an empty segment."""
    members: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    buckets: dict[tuple, list[tuple[str, ...]]] = {}
    for p in sorted({tuple(p) for p in paths}):
        first = "" if kind_of_segment(p[0]) in ("int", "uuid", "hash", "base64") else p[0]
        buckets.setdefault((len(p), first), []).append(p)
    for rows in buckets.values():
        for i, a in enumerate(rows):
            for b in rows[:i]:
                mask = tuple(x if x == y else "" for x, y in zip(a, b, strict=True))
                members.setdefault(mask, set()).update((a, b))
    out = set()
    for mask, rows in members.items():
        if len(rows) < max(min_count, 2) or not any(mask):
            continue
        slots = [{kind_of_segment(r[i]) for r in rows} for i, s in enumerate(mask) if not s]
        typed = all(len(k) == 1 and k not in ({""}, {"string"}) for k in slots)
        if typed or group_strings:
            out.add(mask)
    return out


def fits(mask: list[str], path: list[str]) -> bool:
    return len(mask) == len(path) and all(m in ("", p) for m, p in zip(mask, path, strict=True))


def absorbed_urls(urls: DataFrame, min_count: int = 2, group_strings: bool = False) -> DataFrame:
    """(host, canonical): URLs of each batch that a pattern confirmed so far absorbs, each once per batch.

    ``urls`` is a stream with a column url.  State by host: the last samples
    and the confirmed shapes, which stay confirmed.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    c = urls.select(url.canonical(F.col("url")).alias("canonical")).where("canonical is not null")
    rows = c.select("canonical", url.host(F.col("canonical")).alias("host"), url.segments(F.col("canonical")).alias("segs"))

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches))
        samples, masks = state.get if state.exists else ([], [])
        paths = [list(s) for s in new["segs"]]
        samples = ([*samples, *(SLOT.join(p) for p in paths)])[-SAMPLES:]
        found = shapes([s.split(SLOT) for s in samples], min_count, group_strings)
        masks = sorted({*masks, *(SLOT.join(m) for m in found)})
        state.update((samples, masks))
        split = [m.split(SLOT) for m in masks]
        hit = sorted({u for u, p in zip(new["canonical"], paths, strict=True) if any(fits(m, p) for m in split)})
        yield pd.DataFrame({"host": key[0], "canonical": hit})

    return rows.where("segs is not null").groupBy("host").applyInPandasWithState(
        feed,
        "host string, canonical string",
        "samples array<string>, masks array<string>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def classified_stream(hrefs: DataFrame) -> DataFrame:
    """A stream of hrefs with type, category and class: stateless, so any trigger will do."""
    h = F.col("href")
    return hrefs.select("*", url.link_type(h).alias("link_type"), classify.category(h).alias("category"), classify.url_class(h).alias("class"))
