"""Static analysis of scripts as a table function: one row per finding, split into links, observations and parameters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import classify, javascript, url
from siteatlas.operators.contracts import PAIRS
from siteatlas.rules import CLI_RULES, Rules

#: Observations of one script beyond this many are left out.
MAX_OBSERVATIONS = 4096
FINDING = (
    f"source_url string, what string, nth long, href string, tag string, method string, headers {PAIRS}, body string, "
    f"response_fields array<struct<path: string, kind: string>>, endpoint_only boolean, method_inferred boolean, "
    f"inferred_query {PAIRS}, name string, kind string, owner string, carrier string, endpoints array<string>, count long"
)
COLUMNS = [c.strip().split(" ")[0] for c in FINDING.replace("<struct<name: string, value: string>>", "").replace("<struct<path: string, kind: string>>", "").split(",")]


def pairs(rows) -> list[dict]:
    return [{"name": k, "value": v} for k, v in rows]


def findings(source: str, code: str) -> list[dict]:
    s = javascript.analyze(code or "", source or "")
    out = [{"what": "link", "href": x["href"], "tag": x["tag"], "method": x["method"]} for x in s.links.values()]
    out += [{"what": "link", "href": h, "tag": "url-tmpl", "method": ""} for h, _ in javascript.url_templates(code or "")]
    out += [
        {
            "what": "observation", "href": r["url"], "method": r["method"], "headers": pairs(r["headers"]), "body": r["body"],
            "response_fields": [{"path": p, "kind": k} for p, k in r["response_fields"]], "endpoint_only": r["endpoint_only"],
            "method_inferred": r["method_inferred"], "inferred_query": pairs(r["inferred_query"]),
        }
        for r in s.requests[:MAX_OBSERVATIONS]
    ]
    out += [{"what": "param", **p} for p in s.params.values()]
    return [{"source_url": source, "nth": i, **row} for i, row in enumerate(out)]


def analyze_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [r for u, c in zip(frame["url"], frame["code"], strict=True) for r in findings(u, c)]
        # Columns of objects: what a finding lacks is None, not a number.
        yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in COLUMNS})


def analyze_scripts(scripts: DataFrame) -> DataFrame:
    """All findings of a table of scripts (url, code); narrow, one pass."""
    return scripts.select("url", "code").mapInPandas(analyze_frames, FINDING)


def script_links(found: DataFrame, rules: Rules = CLI_RULES) -> DataFrame:
    """Link rows of findings: calls and literals are APIs, templates are DYNAMIC unless a rule says API."""
    rows = found.where("what = 'link'")
    api = (F.col("tag") != "url-tmpl") | classify.matches_api(F.col("href"), rules)
    return rows.select(
        "source_url",
        "href",
        "tag",
        url.link_type(F.col("href")).alias("link_type"),
        F.when(api, "API").otherwise("DYNAMIC").alias("category"),
        F.lit("normal").alias("class"),
        classify.has_params(F.col("href")).alias("has_params"),
        url.resolve_endpoint(F.col("href"), F.col("source_url")).alias("resolved"),
        F.col("method").alias("http_method"),
    )


def script_observations(found: DataFrame) -> DataFrame:
    columns = ["method", "headers", "body", "response_fields", "endpoint_only", "method_inferred", "inferred_query"]
    rows = found.where("what = 'observation'")
    return rows.select(F.col("href").alias("url"), *columns, F.xxhash64("source_url", "nth").alias("seq"))


def script_params(found: DataFrame) -> DataFrame:
    return found.where("what = 'param'").select("name", "kind", "owner", "carrier", "endpoints", "count", F.col("source_url").alias("doc"))
