"""API contracts: what an endpoint is called with, inferred from the requests seen.

Observations have url, method, headers (array of struct<name, value>), body,
response_fields (array of struct<path, kind>), endpoint_only, method_inferred,
inferred_query (array of struct<name, value>) and seq, their order.  Values of
a field are one row each until the last step, so a hot endpoint is combined
before its exchange; the result is a set of tables keyed by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import bodies, classify, url
from siteatlas.operators.patterns import best_pattern
from siteatlas.sources.tables import written

MAX_RAW = 12
PAIRS = "array<struct<name: string, value: string>>"
OBSERVATION = (
    f"url string, method string, headers {PAIRS}, body string, response_fields array<struct<path: string, kind: string>>, "
    f"endpoint_only boolean, method_inferred boolean, inferred_query {PAIRS}, seq long"
)


def get_observations(urls: DataFrame) -> DataFrame:
    """Plain GET requests of a table of URLs (columns url and seq)."""
    empty = F.array().cast(PAIRS)
    return urls.select(
        "url",
        F.lit("GET").alias("method"),
        empty.alias("headers"),
        F.lit("").alias("body"),
        F.array().cast("array<struct<path: string, kind: string>>").alias("response_fields"),
        F.lit(False).alias("endpoint_only"),
        F.lit(False).alias("method_inferred"),
        empty.alias("inferred_query"),
        F.col("seq").cast("long").alias("seq"),
    )


def content_type(headers: Column) -> Column:
    own = F.filter(headers, lambda h: F.lower(h["name"]) == "content-type")
    return F.coalesce(F.lower(url.trimmed(F.get(own, F.lit(0))["value"])), F.lit(""))


def contract_path(u: Column) -> Column:
    """scheme://host and the decoded path without trailing slashes; null without a path."""
    path = url.decoded(url.raw_path(u))
    whole = F.regexp_replace(F.concat(url.scheme(u), F.lit("://"), url.host(u), path), "/+$", "")
    return F.when((path != "") & (whole != ""), whole)


def is_placeholder(name: Column, value: Column) -> Column:
    marked = (F.octet_length(value) > 2) & value.startswith("<") & value.endswith(">") & ~value.rlike("[ \t]")
    return (name != "") & marked


BOOLEANS = ["true", "false", "0", "1", "on", "off", "yes", "no"]


def value_flags(name: Column, value: Column) -> dict[str, Column]:
    """What one distinct value says about its field; flags of all values are combined by aggregates."""
    t = url.trimmed(value)
    clean = ~value.isin("null", "")
    bare = F.btrim(t, F.lit("\"'"))
    every = lambda test: F.coalesce(test | ~clean, F.lit(False))
    return {
        "n_clean": clean.cast("long"),
        "blank": value == "",
        "bools": every(F.lower(t).isin(BOOLEANS)),
        "ints": every(t.rlike(r"^[+\-]?[0-9]+$") & t.try_cast("long").isNotNull()),
        "negative": clean & t.startswith("-"),
        "reals": every(t.rlike(r"(?i)^[+\-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+\-]?[0-9]+)?|inf(?:inity)?|nan)$")),
        "dates": every(is_date(value)),
        # A secret is looked for in the values as one string: its length, alphabet and digits add up.
        "length": F.octet_length(bare).cast("long"),
        "hex": bare.rlike("^[0-9a-fA-F]*$"),
        "b64": bare.rlike(r"^[A-Za-z0-9_\-]*$"),
        "digit": bare.rlike("[0-9]"),
    }


#: How the flags of the values of a field combine.
COMBINE = {
    "n_clean": F.sum, "blank": F.bool_or, "bools": F.bool_and, "ints": F.bool_and, "negative": F.bool_or, "reals": F.bool_and,
    "dates": F.bool_and, "length": F.sum, "hex": F.bool_and, "b64": F.bool_and, "digit": F.bool_or,
}


def kind_by_flags(name: Column) -> Column:
    """The kind of a field from the combined flags of its values; null flags mean that it has none."""
    secret = name.rlike(classify.SECRET_NAME) | (
        F.col("digit") & ((F.col("hex") & (F.col("length") >= 24)) | (F.col("b64") & (F.col("length") >= 32)))
    )
    return (
        F.when(F.col("n_clean").isNull(), "unknown")
        .when(secret, "token")
        .when(F.col("n_clean") == 0, F.when(F.col("blank"), "bool").otherwise("null"))
        .when(F.col("bools"), "bool")
        .when(F.col("ints"), F.when(F.col("negative"), "int").otherwise("uint"))
        .when(F.col("reals"), "float")
        .when(F.col("dates"), "date")
        .when(F.col("n_clean") == 1, "str")
        .when(F.col("n_clean") <= 8, "enum")
        .otherwise("str")
    )


# The layouts of a date or a time, the first groups of each also checked as a calendar date.
DAY, MONTH = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)", "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
CLOCK = r"(?:[01]\d|2[0-3]):[0-5]\d"
TIME_LAYOUTS = [
    rf"^{CLOCK}$",
    rf"^{DAY}, \d\d {MONTH} \d{{4}} {CLOCK}:[0-5]\d (?:[A-Z]{{3,4}}|[+\-]\d{{4}})$",
]
DATE_LAYOUTS = [
    (rf"^(\d{{4}}-\d\d-\d\d)T{CLOCK}:[0-5]\d(?:\.\d+)?(?:Z|[+\-]\d\d:\d\d)$", "yyyy-MM-dd"),
    (r"^(\d{4}-\d\d-\d\d)$", "yyyy-MM-dd"),
    (r"^(\d{4}/\d\d/\d\d)$", "yyyy/MM/dd"),
    (r"^(\d\d\.\d\d\.\d{4})$", "dd.MM.yyyy"),
    (rf"^(\d{{4}}-\d\d-\d\d) {CLOCK}:[0-5]\d$", "yyyy-MM-dd"),
]


def is_date(v: Column) -> Column:
    t = url.trimmed(v)
    tests = [t.rlike(rx) for rx in TIME_LAYOUTS]
    for rx, layout in DATE_LAYOUTS:
        tests.append(t.rlike(rx) & F.try_to_timestamp(F.regexp_extract(t, rx, 1), F.lit(layout)).isNotNull())
    return url.any_of(tests)


def field_rows(obs: DataFrame) -> DataFrame:
    """(path, section, body_kind, mime, name, value, placeholder, seq, pos): a row for each value of each field."""
    none = F.lit("")
    query = classify.query_pairs(url.raw_query(F.col("url")))

    def rows(df: DataFrame, pairs: Column, section: str, kind: Column = none, mime: Column = none, name=lambda n: n, empty=False) -> DataFrame:
        r = df.select("path", "seq", kind.alias("body_kind"), mime.alias("mime"), F.posexplode(pairs).alias("pos", "p"))
        n, v = name(F.col("p.name")), F.col("p.value")
        mark = F.lit(True) if empty else is_placeholder(n, v)
        return r.select("path", F.lit(section).alias("section"), "body_kind", "mime", n.alias("name"), v.alias("value"), mark.alias("placeholder"), "seq", "pos")

    shaped = obs.where("shape.kind is not null")
    return (
        rows(obs, query, "query")
        .union(rows(obs, F.filter("inferred_query", lambda q: q["name"] != ""), "query", empty=True))
        .union(rows(obs, F.col("headers"), "header", name=F.lower))
        .union(rows(shaped, F.col("shape.fields"), "body", F.col("shape.kind"), F.col("shape.mime")))
    )


FIELD = ["path", "section", "body_kind", "mime", "name"]


def field_values(rows: DataFrame) -> DataFrame:
    """(field, value, placeholder, first): each distinct value of each field, and where it was first seen."""
    return rows.groupBy(*FIELD, "value", "placeholder").agg(F.min(F.struct("seq", "pos")).alias("first"))


def field_kinds(values: DataFrame) -> DataFrame:
    """(field, kind, n_values, inferred, and the one value of a constant), by aggregates alone.

    A field with very many values is never gathered in one task.
    """
    seen = values.where("not placeholder")
    flags = value_flags(F.col("name"), F.col("value"))
    seen = seen.select(*FIELD, "value", *(v.alias(k) for k, v in flags.items())).groupBy(*FIELD).agg(
        F.count(F.lit(1)).alias("n_values"), F.min("value").alias("one"), *(f(k).alias(k) for k, f in COMBINE.items())
    )
    named = values.groupBy(*FIELD).agg(F.bool_or("placeholder").alias("inferred"))
    return named.join(seen, FIELD, "left").select(
        *FIELD,
        kind_by_flags(F.col("name")).alias("kind"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
        F.when(F.col("n_values") == 1, F.col("one")).otherwise("").alias("const_val"),
        "inferred",
    )


def finished(values: DataFrame) -> DataFrame:
    """Fields with their kind, and their values listed in the order in which they were first seen.

    ``values`` as of :func:`field_values`, written.  The list is for captures
    and reports; :func:`field_kinds` has all else.
    """
    order = F.array_sort(F.collect_list(F.when(~F.col("placeholder"), F.struct("first", "value"))))
    listed = values.groupBy(*FIELD).agg(F.array_distinct(F.transform(order, lambda r: r["value"])).alias("values"))
    return field_kinds(values).join(listed, FIELD).select(
        *FIELD, "kind", "values", (F.col("n_values") == 1).alias("constant"), "const_val", F.lit(False).alias("nullable"), "inferred"
    )


def sample_value(f: Column) -> Column:
    marker = F.concat(F.lit("<"), f["name"], F.lit(">"))
    return (
        F.when(f["kind"] == "int", "0")
        .when(f["kind"] == "uint", "1")
        .when(f["kind"] == "float", "0.0")
        .when(f["kind"] == "bool", "false")
        .when((f["kind"] == "enum") & (F.size(f["values"]) > 0), F.get(f["values"], F.lit(0)))
        .when(f["kind"] == "date", "<date>")
        .when(f["kind"] == "json", "{}")
        .when(f["kind"] == "array", "[]")
        .when(f["kind"] == "null", "null")
        .otherwise(marker)
    )


def body_samples(fields: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, kind, mime, methods, sample): a body for each format, built from its fields."""
    token = F.when(F.col("kind") == "token", 0).otherwise(1)
    own = fields.where("section = 'body'").groupBy("path", "body_kind", "mime").agg(
        F.array_sort(F.collect_list(F.struct(token.alias("t"), "name", "kind", "values"))).alias("fields")
    )
    joined = seen.join(own, ["path", "body_kind", "mime"], "left").withColumn("fields", F.coalesce("fields", F.array()))
    pairs = F.transform("fields", lambda f: F.concat(F.lit('"'), f["name"], F.lit('": '), sample_value(f)))
    obj = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    calls = F.when(F.size("methods") > 0, F.col("methods")).otherwise(F.array(F.lit("<method>")))
    rpc = F.array_join(
        F.transform(calls, lambda m: F.concat(F.lit('{"jsonrpc":"2.0","method":"'), m, F.lit('","params":'), obj, F.lit(',"id":1}'))),
        "  /  ",
    )
    form = F.array_join(
        F.transform(
            F.array_sort(F.transform("fields", lambda f: F.struct(f["name"].alias("n"), sample_value(f).alias("v")))),
            lambda f: F.concat(f["n"], F.lit("="), f["v"]),
        ),
        "&",
    )
    kind = F.col("body_kind")
    sample = (
        F.when(kind == "json", obj)
        .when(kind == "array", F.when(F.size("fields") == 0, "[]").otherwise(F.concat(F.lit("["), obj, F.lit("]"))))
        .when(kind == "jsonrpc", rpc)
        .when(kind == "form", form)
        .otherwise(F.col("sample"))
    )
    return joined.select("path", kind.alias("kind"), "mime", "methods", sample.alias("sample"))


def rendered_request(obs: DataFrame) -> Column:
    """One masked line for a request: method, path and query, body, headers."""
    path = url.decoded(url.raw_path(F.col("url")))
    query = url.raw_query(F.col("url"))
    shown = F.concat(path, F.when(query != "", F.concat(F.lit("?"), classify.redact_query(query))).otherwise(F.lit("")))
    body = url.trimmed(F.col("body"))
    cut = F.when(F.octet_length(body) > 200, F.concat(F.left(body, F.lit(200)), F.lit("…"))).otherwise(body)
    with_body = F.when(body != "", F.concat(F.lit(" : "), bodies.redact_body(cut))).otherwise(F.lit(""))
    headers = F.array_join(F.transform("headers", lambda h: classify.shield(h["name"], h["value"])), ", ")
    with_headers = F.when(F.size("headers") > 0, F.concat(F.lit(" ["), headers, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.col("method"), F.lit(" "), shown, with_body, with_headers)


#: How the tables of :func:`partial_contracts` are combined: their keys, and an aggregate for each other column.
MERGE = {
    "values": ([*FIELD, "value", "placeholder"], {"first": F.min}),
    "lines": (["path", "line"], {"seq": F.min}),
    "methods": (["path", "method"], {}),
    "calls": (["path"], {"calls": F.sum, "endpoint_only": F.max, "all_inferred": F.min}),
    "formats": (["path", "body_kind", "mime"], {"sample": F.min}),
    "body_methods": (["path", "body_kind", "mime", "method"], {"first": F.min}),
    "answers": (["path", "field"], {"best": F.min}),
}


def combined(name: str, rows: DataFrame, max_raw: int = MAX_RAW) -> DataFrame:
    """Rows of one table of partial contracts, of any number of parts, with one row for each key; combined before the exchange.

    Of the request lines only those of the first ``max_raw`` per path stay,
    which is enough for any later part: a line among the first of all is among
    the first of the part that saw it first.
    """
    keys, aggregates = MERGE[name]
    out = rows.groupBy(*keys).agg(*(f(c).alias(c) for c, f in aggregates.items())) if aggregates else rows.select(*keys).distinct()
    if name == "lines":
        nth = F.row_number().over(Window.partitionBy("path").orderBy("seq", "line"))
        out = out.withColumn("__nth", nth).where(F.col("__nth") <= max_raw).drop("__nth")
    return out


def partial_contracts(observations: DataFrame, max_raw: int = MAX_RAW) -> dict[str, DataFrame]:
    """What a part of the requests says of its endpoints, as tables that :func:`combined` merges with those of other parts."""
    obs = observations.withColumn("path", contract_path(F.col("url"))).where("path is not null")
    shape = F.when(F.col("body") != "", bodies.infer_body(F.col("body"), content_type(F.col("headers"))))
    obs = written(obs.withColumn("shape", shape).withColumn("line", rendered_request(obs)), "observations")
    called = ~F.col("endpoint_only")
    shaped = obs.where("shape.kind is not null").select("path", F.col("shape.kind").alias("body_kind"), F.col("shape.mime").alias("mime"), "shape.methods", "shape.sample", "seq")
    generic = F.col("f.kind").isin("any", "")
    tables = {
        "values": field_rows(obs).select(*FIELD, "value", "placeholder", F.struct("seq", "pos").alias("first")),
        "lines": obs.select("path", "line", "seq"),
        "methods": obs.where(called & (F.col("method") != "")).select("path", F.upper("method").alias("method")),
        "calls": obs.select(
            "path", called.cast("long").alias("calls"), "endpoint_only", F.when(called, F.col("method_inferred")).alias("all_inferred")
        ),
        "formats": shaped.select(
            "path", "body_kind", "mime", F.struct(F.when(F.col("sample") != "", 0).otherwise(1).alias("none"), "seq", "sample").alias("sample")
        ),
        "body_methods": shaped.select("path", "body_kind", "mime", "seq", F.posexplode("methods").alias("pos", "method")).select(
            "path", "body_kind", "mime", "method", F.struct("seq", "pos").alias("first")
        ),
        "answers": obs.select("path", "seq", F.posexplode("response_fields").alias("pos", "f")).where("f.path <> ''").select(
            "path", F.col("f.path").alias("field"), F.struct(generic.alias("g"), "seq", "pos", F.col("f.kind").alias("kind")).alias("best")
        ),
    }
    return {name: combined(name, rows, max_raw) for name, rows in tables.items()}


def whole_contracts(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """endpoints, contract_fields, contract_bodies and endpoint_response of combined partial contracts."""
    lines = parts["lines"].groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]).alias("raw"))
    methods = parts["methods"].groupBy("path").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    heads = parts["calls"].join(methods, "path", "left").select(
        "path",
        F.coalesce("methods", F.array().cast("array<string>")).alias("methods"),
        "calls",
        (F.col("endpoint_only") & (F.col("calls") == 0)).alias("unobserved"),
        F.coalesce("all_inferred", F.lit(False)).alias("method_inferred"),
    )
    fields = finished(written(parts["values"], "values"))
    order = F.array_sort(F.collect_list(F.struct("first", "method")))
    names = parts["body_methods"].groupBy("path", "body_kind", "mime").agg(F.transform(order, lambda r: r["method"]).alias("methods"))
    seen = parts["formats"].join(names, ["path", "body_kind", "mime"], "left").select(
        "path",
        "body_kind",
        "mime",
        F.coalesce("methods", F.array().cast("array<string>")).alias("methods"),
        F.coalesce("sample.sample", F.lit("")).alias("sample"),
    )
    return {
        "endpoints": heads.join(lines, "path", "left"),
        "contract_fields": fields,
        "contract_bodies": body_samples(fields, seen),
        "endpoint_response": parts["answers"].select("path", "field", F.col("best.kind").alias("kind")),
    }


def infer_contracts(observations: DataFrame, max_raw: int = MAX_RAW) -> dict[str, DataFrame]:
    """endpoints, contract_fields, contract_bodies and endpoint_response of all requests; ``max_raw`` lines are shown of an endpoint."""
    return whole_contracts(partial_contracts(observations, max_raw))


def request_samples(endpoints: DataFrame, contract_bodies: DataFrame) -> DataFrame:
    """(path, sample): a line for each method and body of an endpoint."""
    texts = contract_bodies.select("path", F.explode(F.split("sample", "  /  ", -1)).alias("body"))
    rows = endpoints.select("path", F.explode("methods").alias("method")).join(texts, "path", "left")
    line = F.concat(F.col("method"), F.lit(" "), F.col("path"))
    body = F.when(F.col("body").isNull(), F.lit("  (no body)")).otherwise(F.concat(F.lit("  body: "), F.col("body")))
    return rows.select("path", F.concat(line, body).alias("sample"))


def on_patterns(observations: DataFrame, patterns: DataFrame, links: DataFrame) -> DataFrame:
    """Observations whose URL a pattern fits get the pattern as URL, unless the URL is an API link."""
    best = best_pattern(observations.select("url"), patterns)
    apis = links.where(F.col("category").isin("API", "DYNAMIC")).select(F.col("resolved").alias("url")).distinct()
    free = best.join(apis, "url", "left_anti")
    return observations.join(free, "url", "left").withColumn("url", F.coalesce("pattern", "url")).drop("pattern")


def patterns_with_contracts(observations: DataFrame, patterns: DataFrame, links: DataFrame) -> DataFrame:
    """The patterns that some request falls under: those whose pattern is the URL of a request on patterns."""
    seen = on_patterns(observations, patterns, links).select(F.col("url").alias("pattern")).distinct()
    return patterns.join(seen, "pattern", "left_semi")


def with_fallback(observations: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Observations with ``column`` of ``found`` (keyed by url) for their URL, else for it without query."""
    base = url.drop_query(F.col("url"))
    exact = found.select("url", F.col(column).alias("__exact"))
    bare = found.select(F.col("url").alias("__base"), F.col(column).alias("__bare"))
    both = observations.join(exact, "url", "left").withColumn("__base", base).join(bare, "__base", "left")
    return both.withColumn(column, F.coalesce("__exact", "__bare", column)).drop("__exact", "__bare", "__base")
