"""Link extraction: typed link rows, and where each link stands, out of document bodies."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import classify, url
from siteatlas.rules import CATEGORIES, CLASSES, CLI_RULES, LINK_TYPES, Rules


def tag_regex(tag: str, attribute: str) -> str:
    return rf"""(?i)<{tag}[^>]+{attribute}=["']([^"']+)["'][^>]*>"""


# The patterns, in the order in which their findings count as first.
PATTERNS = {
    **{
        tag: tag_regex(tag, attribute)
        for tag, attribute in [
            ("a", "href"), ("script", "src"), ("link", "href"), ("img", "src"), ("source", "src"), ("video", "src"),
            ("audio", "src"), ("iframe", "src"),
        ]
    },
    "css-import": r"""(?i)@import\s+['"]([^"']+)['"]""",
    "js-import": r"""(?i)(?:^|[^a-z0-9_.$])(?:import|export|from|require)\b\s*\(?\s*["']([^"']{1,512})["']""",
}

# A URL written in running text.
TEXT_URL = (
    r"(?i)(?:https?://[a-z0-9][a-z0-9._~:/?#@!$&*+,;=%()\-]*"
    r"|//[a-z0-9\-]+(?:\.[a-z0-9\-]+)+(?:[:/?#][a-z0-9._~:/?#@!$&*+,;=%()\-]*)?"
    r"|www\.[a-z0-9\-]+(?:\.[a-z0-9\-]+)+(?:[:/?#][a-z0-9._~:/?#@!$&*+,;=%()\-]*)?)"
)


def is_accepted(tag: Column, href: Column) -> Column:
    refused = (href == "") | classify.starts_with_any(href, ["#", "javascript:", "mailto:", "tel:"])
    return ~refused & classify.has_alphanumeric(href) & ((tag != "js-import") | classify.is_module_specifier(href))


def described(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows with href, plus what follows from it: type, category, class, parameters."""
    href = F.col("href")
    return (
        rows.withColumn("link_type", url.link_type(href))
        .withColumn("category", classify.category(href, rules))
        .withColumn("class", classify.url_class(href, rules))
        .withColumn("has_params", classify.has_params(href))
    )


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def matches(bodies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(source_url, *keys, tag, rank, pos, raw) of every match; ``bodies`` has url, body and ``keys``.

    One pass per pattern over the body, inside one narrow stage.
    """
    body = F.col("body")
    per_tag = F.array(
        *(
            F.struct(
                F.lit(tag).alias("tag"), F.lit(k).alias("rank"), F.regexp_extract_all(body, F.lit(rx), F.lit(1)).alias("found")
            )
            for k, (tag, rx) in enumerate(PATTERNS.items())
        )
    )
    return (
        bodies.select(F.col("url").alias("source_url"), *keys, F.explode(per_tag).alias("t"))
        .select("source_url", *keys, "t.tag", "t.rank", F.posexplode("t.found").alias("pos", "raw"))
    )


def extract_links(bodies: DataFrame, rules: Rules = CLI_RULES, keys: Sequence[str] = ()) -> DataFrame:
    """Links of each document, the first of each href, in markup order of tags.

    All bodies of one url are one document, unless ``keys``, further columns of
    ``bodies`` that are kept, tell them apart.
    """
    found = matches(bodies, keys).withColumn("href", url.trimmed(F.col("raw"))).where(is_accepted(F.col("tag"), F.col("href")))
    first = first_of(found, ["source_url", *keys, "href"], ["rank", "pos"])
    return described(first.drop("raw"), rules)


def with_resolved(links: DataFrame) -> DataFrame:
    """Links plus the absolute URL and its host."""
    return links.withColumn("resolved", url.resolve(F.col("source_url"), F.col("href"))).withColumn(
        "domain", url.host(F.col("resolved"))
    )


def link_key() -> Column:
    return F.when(F.col("resolved") != "", F.col("resolved")).otherwise(F.col("href"))


def code_of(label: Column, labels: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), label).cast("int") - 1


def display_order() -> list[Column]:
    """By class, category, domain and href."""
    return [code_of(F.col("class"), CLASSES), code_of(F.col("category"), CATEGORIES), F.col("domain"), F.col("href")]


def link_type_code() -> Column:
    return code_of(F.col("link_type"), LINK_TYPES)


def with_content_types(refs: DataFrame, responses: DataFrame) -> DataFrame:
    """References with the content type of their document: the first by ``seq`` that is not empty, else empty.

    ``responses`` has url, content_type and seq; a document fetched twice keeps
    its first answer.
    """
    first = responses.where("content_type <> '' and url <> ''").groupBy(F.col("url").alias("source_url")).agg(F.min_by("content_type", "seq").alias("content_type"))
    return refs.join(first, "source_url", "left").withColumn("content_type", F.coalesce("content_type", F.lit("")))


def references(bodies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(source_url, target, tag, offset, line, column, snippet) of every match, refused ones too, and ``keys``, further columns of ``bodies``.

    Offsets and columns count bytes.  A pattern's text is split at its matches
    by Python's own regular expressions, since no column function gives
    positions; batches are Arrow tables.
    """
    import re

    import pyarrow as pa

    compiled = [(tag, re.compile(rx.encode())) for tag, rx in PATTERNS.items()]

    def run(batches):
        for batch in batches:
            out, of = [], []
            bodies_ = batch.column("body").cast(pa.binary()).to_pylist()
            for nth, (source, body) in enumerate(zip(batch.column("url").to_pylist(), bodies_, strict=True)):
                body = body or b""
                breaks = [m.start() for m in re.finditer(b"\n", body)]
                for tag, rx in compiled:
                    for m in rx.finditer(body):
                        out.append((source, m[1].decode("utf-8", "replace"), tag, *position(breaks, m.start(1)), snippet(body, *m.span(1))))
                        of.append(nth)
            names = ["source_url", "target", "tag", "offset", "line", "column", "snippet"]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            types = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.string()]
            kept = [batch.column(k).take(pa.array(of, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *kept], [*names, *keys])

    schema = "source_url string, target string, tag string, offset long, line long, column long, snippet string"
    rows = bodies.select("url", F.col("body").cast("string").alias("body"), *keys)
    return rows.mapInArrow(run, ", ".join([schema, *(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)]))


def position(breaks: list[int], offset: int) -> tuple[int, int, int]:
    """(offset, line, column), the last two from 1; ``breaks``: where the body has line breaks."""
    line = bisect.bisect_left(breaks, offset)
    return offset, line + 1, offset - (breaks[line - 1] if line else -1)


#: Bytes of context on either side.
AROUND = 48


def snippet(body: bytes, start: int, end: int) -> str:
    """A match in its context on one line; dots where the context was cut."""
    low, high = max(0, start - AROUND), min(len(body), end + AROUND)
    text = " ".join(body[low:high].decode("utf-8", "replace").split())
    return ("..." if low else "") + text + ("..." if high < len(body) else "")


def trim_text_url(s: str) -> str:
    """A URL found in prose without the punctuation of its sentence; balanced brackets stay."""
    s = s.rstrip(".,;:!?\"'")
    pairs = {")": "(", "]": "[", "}": "{"}
    while s and s[-1] in pairs and s.count(s[-1]) > s.count(pairs[s[-1]]):
        s = s[:-1]
    open_at, depth = -1, 0
    for i in range(len(s) - 1, -1, -1):
        depth += (s[i] == ")") - (s[i] == "(")
        if depth < 0:
            open_at = i
            break
    return s[:open_at] if open_at >= 0 else s


def trim_text_urls(found: pd.Series) -> pd.Series:
    return found.map(lambda a: [trim_text_url(x) for x in a])


def text_urls(texts: DataFrame, tag: str = "text-url", rules: Rules = CLI_RULES, keys: Sequence[str] = ()) -> DataFrame:
    """URLs written in running text (columns url and body), the first of each href in a document; ``keys`` as in :func:`extract_links`."""
    trim = F.pandas_udf(trim_text_urls, "array<string>")
    raw = texts.select(F.col("url").alias("source_url"), *keys, F.regexp_extract_all(F.col("body"), F.lit(TEXT_URL), F.lit(0)).alias("f"))
    rows = raw.where(F.size("f") > 0).select("source_url", *keys, F.posexplode(trim("f")).alias("pos", "href"))
    www = F.lower(F.col("href")).startswith("www.")
    rows = rows.withColumn("href", F.when(www, F.concat(F.lit("http://"), F.col("href"))).otherwise(F.col("href")))
    rows = rows.where(classify.has_alphanumeric(F.col("href"))).withColumn("tag", F.lit(tag)).withColumn("rank", F.lit(0))
    return described(first_of(rows, ["source_url", *keys, "href"], ["pos"]), rules)


def inline_scripts(bodies: DataFrame) -> DataFrame:
    """(url, pos, code) of inline scripts that are JavaScript, empty ones left out."""
    element = r"(?is)(<script[^>]*>)(.*?)</script>"
    open_tags = F.regexp_extract_all(F.col("body"), F.lit(element), F.lit(1))
    codes = F.regexp_extract_all(F.col("body"), F.lit(element), F.lit(2))
    rows = bodies.select("url", F.posexplode(F.arrays_zip(open_tags.alias("tag"), codes.alias("code"))).alias("pos", "s"))
    rows = rows.select("url", "pos", "s.tag", url.trimmed(F.col("s.code")).alias("code"))
    kind = F.lower(F.regexp_extract(F.col("tag"), r"""(?i)\stype\s*=\s*["']?([^"'\s>]*)""", 1))
    script = kind.isin("", "module", "text/javascript", "application/javascript", "text/ecmascript", "application/x-javascript")
    return rows.where(script & ~F.col("tag").rlike(r"(?i)\ssrc\s*=") & (F.col("code") != "")).select("url", "pos", "code")


def page_scripts(bodies: DataFrame, responses: DataFrame) -> DataFrame:
    """(url, pos, src, code) of all scripts of a page in document order; external ones from captured responses.

    Each script is looked up once: the addresses are made distinct before the join.
    """
    element = r"(?is)(<script[^>]*>)(.*?)</script>"
    pairs = F.arrays_zip(
        F.regexp_extract_all(F.col("body"), F.lit(element), F.lit(1)).alias("tag"),
        F.regexp_extract_all(F.col("body"), F.lit(element), F.lit(2)).alias("code"),
    )
    rows = bodies.select("url", F.posexplode(pairs).alias("pos", "s")).select("url", "pos", "s.tag", url.trimmed(F.col("s.code")).alias("inline"))
    src = F.regexp_extract(F.col("tag"), r"""(?i)\ssrc\s*=\s*["']([^"']+)["']""", 1)
    rows = rows.withColumn("src", F.when(src == "", F.lit("")).otherwise(url.resolve(F.col("url"), src)))
    wanted = rows.where("src <> ''").select("src").distinct()
    fetched = wanted.join(responses.select(F.col("url").alias("src"), F.col("body").cast("string").alias("fetched")), "src")
    both = rows.join(fetched, "src", "left").withColumn("code", F.when(F.col("src") == "", F.col("inline")).otherwise(F.col("fetched")))
    return both.where("code is not null and code <> ''").select("url", "pos", "src", "code")


def css_links(bodies: DataFrame) -> DataFrame:
    """(source_url, pos, href) of url() in style sheets."""
    return bodies.select(F.col("url").alias("source_url"), F.posexplode(classify.css_urls(F.col("body"))).alias("pos", "href"))
