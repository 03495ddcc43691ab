"""Cases over literal rows, for logic that the supplied tables reach only in part; their SQL is the expected rows.

Inputs and expectations are fixed values: what results must be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.functions import classify, documents, url
from siteatlas.operators import contracts, extract, fold, graph, patterns, sandbox, scripts
from siteatlas.rules import LIBRARY_RULES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def values(rows: list[tuple], names: str) -> str:
    """SQL for literal rows."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def golden(names: str, expected: list[tuple]):
    """Register a query of the session alone, and its rows."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        ORACLES[f.__name__] = values(expected, names)
        return f

    return register


def texts(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(x,) for x in rows], "x string")


def column_golden(name: str, expression: Callable, cases: dict) -> None:
    """A query of one column expression over one column x."""
    QUERIES[name] = lambda spark, sf_dir: texts(spark, cases).select("x", expression(F.col("x")).alias("y"))
    ORACLES[name] = values(list(cases.items()), "x, y")


column_golden(
    "golden_category",
    lambda x: classify.category(x, LIBRARY_RULES),
    {
        "/apartments/ajax.php": "API", "/graphql": "API", "/js/api.js": "web-asset", "/data/manifest.json": "web-asset",
        "/about/team": "web-page", "/": "web-page", "/a.PNG?v=1": "web-asset", "/x/login.php": "API", "/wp-json/x": "API",
    },
)
column_golden(
    "golden_class",
    classify.url_class,
    {"/cdn-cgi/x": "WAF", "https://unpkg.com/x": "CDN", "/a.js?v=3": "cache", "a;b/c": "noise", "word": "noise", "/ok": "normal"},
)
column_golden(
    "golden_segment_kind",
    classify.segment_kind,
    {
        "9223": "int", "123e4567-e89b-12d3-a456-426614174000": "uuid", "d41d8cd98f00b204e9800998ecf8427e": "hash",
        "aGVsbG8gd29ybGQIL==": "base64", "my-awesome-post": "string", "{id}": "", "": "",
    },
)
column_golden(
    "golden_resolve",
    lambda x: url.resolve(F.lit("https://h.example:8443/a/b/page.html?q=1"), x),
    {
        "/x": "https://h.example:8443/x", "../c": "https://h.example:8443/a/c", "./c/../d/": "https://h.example:8443/a/b/d/",
        "//o.example/p": "https://o.example/p", "?z=2": "https://h.example:8443/a/b/page.html?z=2", "mailto:a@b": "mailto:a@b",
        "#f": "https://h.example:8443/a/b/page.html?q=1#f",
    },
)
column_golden(
    "golden_scope",
    lambda x: url.host_in(x, ["example.com"]),
    {"example.com": True, "api.example.com:8080": True, "notexample.com": False, "example.com.evil.io": False},
)
column_golden("golden_is_script", url.is_script, {"/a.js?v=1": True, "/b.mjs": True, "/c.json": False, "/js": False})
column_golden(
    "golden_cache_busters",
    url.without_cache_busters,
    {"https://h/a?t=1&b=2&a=x%20y": "https://h/a?a=x+y&b=2", "https://h/a?_=3": "https://h/a", "https://h/a": "https://h/a"},
)
column_golden("golden_masked_query", classify.redact_query, {"a=1&sessid=xyz": "a=1&sessid=<sessid>", "w=word": "w=word", "bare": "bare"})
column_golden(
    "golden_endpoint",
    classify.looks_like_endpoint,
    {"/api/x": True, "/about": False, "/a.php?x=1": True, "/static/app.css": False, "/api/{id}": False, "api/x": False},
)
column_golden("golden_srcset", lambda x: F.array_join(classify.srcset(x), "|"), {"a.png 1x, b.png  2x": "a.png|b.png", "": ""})
column_golden("golden_css_urls", lambda x: F.array_join(classify.css_urls(x), "|"), {"x{b:url( 'a b.png' )} url(c.png)": "a b.png|c.png"})
column_golden("golden_args", classify.clean_args, {"[]": "[]", "{a:1}\n  x": "{a:1} x", "(": ""})
column_golden("golden_error", classify.emulation_error, {"https://h/x.js: TypeError: a is b at f (x:1)": "TypeError: a is b", "plain": "plain"})
column_golden("golden_place_key", url.place_key, {"https://h/%7Bt%7D/x/?q": "/{t}/x", "http://h": "/", "/p#f": "/p"})
column_golden(
    "golden_document_kind", documents.kind_by_extension, {"/a.pdf?x": "pdf", "/a.docx": "zip", "/a.doc": "legacy", "/a.CSV": "text", "/a.png": "", "/a.": ""}
)
column_golden("golden_module", classify.is_module_specifier, {"lodash": True, "getAll": False, "@vue/x": True, "a b": False, "./m": True})

MARKUP = """<a href="/p">x</a><IMG src='/i.png'><script src="/s.js"></script><a class=x href="/p">again</a><a href="#t">n</a>
<style>@import "/c.css"</style><link rel=x href="/l.css"><source src="/o.webm"><video src="/v.mp4"></video><audio src="/a.mp3">
</audio><iframe src="/f"></iframe><script>import v from '@vue/core'; le.from("not")</script>"""


@golden(
    "tag, href",
    [("a", "/p"), ("script", "/s.js"), ("link", "/l.css"), ("img", "/i.png"), ("source", "/o.webm"), ("video", "/v.mp4"), ("audio", "/a.mp3"), ("iframe", "/f"), ("css-import", "/c.css"), ("js-import", "@vue/core")],
)
def golden_tags(spark):
    return extract.extract_links(spark.createDataFrame([("https://h/", MARKUP)], "url string, body string")).select("tag", "href")


@golden("href", [("https://a.example/Foo_(bar)",), ("http://www.b.example",), ("//c.example/x",), ("http://d.example/y",)])
def golden_text_urls(spark):
    text = "See https://a.example/Foo_(bar), (www.b.example). //c.example/x; //nohost and http://d.example/y(also ok"
    return extract.text_urls(spark.createDataFrame([("d", text)], "url string, body string")).select("href")


@golden("target, line, column_no", [("/x", 3, 8), ("/y.png", 3, 124)])
def golden_references(spark):
    html = '<p>é</p>\n<a\n href="/x">t</a>' + " " * 97 + '<img src="/y.png">'
    found = extract.references(spark.createDataFrame([("https://h/", html)], "url string, body string"))
    return found.select("target", "line", F.col("column").alias("column_no"))


@golden(
    "url, method, guess, only_endpoint",
    [
        ("https://h/api/a", "GET", True, False), ("https://h/api/b", "POST", False, False), ("https://h/api/e", "PUT", False, False),
        ("https://h/api/h?page=2", "GET", False, False), ("https://h/api/x", "GET", False, False), ("https://h/api/lit", "", False, True),
        ("https://h/api/v1/users", "GET", False, False), ("https://h/api/users/{uid}", "GET", False, False),
    ],
)
def golden_script_requests(spark):
    code = [
        'q("/api/a",{f:1});', 'myHttp.post("/api/b",{id:1});', 'request({url:"/api/e", method:"PUT", data:{x:1}});',
        'client.load("/api/h",{page:2});', "var x=new XMLHttpRequest(); x.open('GET','/api/x');", "var u='/api/lit';",
        "const B='/api/v1'; const U=B+'/users'; fetch(U);", "fetch(`/api/users/${uid}`); // fetch('/api/comment')",
    ]
    found = scripts.analyze_scripts(spark.createDataFrame([("https://h/p", c) for c in code], "url string, code string"))
    return scripts.script_observations(found).select("url", "method", F.col("method_inferred").alias("guess"), F.col("endpoint_only").alias("only_endpoint"))


@golden("name, kind, owner", [("geo", "query", "page"), ("avatar", "form", "unassigned"), ("sort", "query", "request")])
def golden_script_params(spark):
    code = """const qs = new URLSearchParams(location.search); qs.set('geo', 'x'); const fd = new FormData(); fd.append('avatar', f);
      const sp = new URLSearchParams(); sp.set('sort', 'price'); fetch('/api/search', {method: 'POST', body: sp});"""
    found = scripts.analyze_scripts(spark.createDataFrame([("https://h/p", code)], "url string, code string"))
    return fold.fold_fragments(scripts.script_params(found)).select("name", "kind", "owner")


@golden("field", [("items",), ("items[]",), ("meta",), ("meta.total",)])
def golden_response_fields(spark):
    code = "fetch('/api/a').then(r => r.json()).then(d => { d.items.map(x => x); d.meta.total; });"
    found = scripts.analyze_scripts(spark.createDataFrame([("https://h/p", code)], "url string, code string"))
    return contracts.infer_contracts(scripts.script_observations(found))["endpoint_response"].select("field")


BODIES = [
    ("https://h/j", '{"number": 3, "o": {"k": [1], "d": {"x": 1}}, "n": null}', ""),
    ("https://h/r", '{"jsonrpc":"2.0","method":"m1","params":{"a":1},"id":1}', ""),
    ("https://h/r", '{"jsonrpc":"2.0","method":"m2","params":{"a":2},"id":1}', ""),
    ("https://h/s", "{cameraId:n, t:'x'}", ""),
    ("https://h/f", "a=5&b=%20x", "application/x-www-form-urlencoded; charset=x"),
    ("https://h/x", "<a/>", "text/xml"),
]


def body_contracts(spark) -> dict[str, DataFrame]:
    rows = [
        (u, "POST", [("Content-Type", ct)] if ct else [], b, [], False, False, [], i) for i, (u, b, ct) in enumerate(BODIES)
    ]
    return contracts.infer_contracts(spark.createDataFrame(rows, contracts.OBSERVATION))


@golden(
    "path, kind, mime, methods",
    [
        ("https://h/j", "json", "", ""), ("https://h/r", "jsonrpc", "", "m1|m2"), ("https://h/s", "json", "", ""),
        ("https://h/f", "form", "application/x-www-form-urlencoded", ""), ("https://h/x", "xml", "text/xml", ""),
    ],
)
def golden_bodies(spark):
    return body_contracts(spark)["contract_bodies"].select("path", "kind", "mime", F.array_join("methods", "|").alias("methods"))


@golden(
    "path, name, kind",
    [
        ("https://h/j", "number", "uint"), ("https://h/j", "o.k", "str"), ("https://h/j", "n", "null"), ("https://h/r", "a", "uint"),
        ("https://h/s", "cameraId", "str"), ("https://h/s", "t", "str"), ("https://h/f", "a", "uint"), ("https://h/f", "b", "str"),
    ],
)
def golden_body_fields(spark):
    return body_contracts(spark)["contract_fields"].where("section = 'body'").select("path", "name", "kind")


@golden("sample", [("POST https://h/f  body: a=1&b=<b>",), ("POST https://h/x  body: <xml>",)])
def golden_samples(spark):
    c = body_contracts(spark)
    return contracts.request_samples(c["endpoints"], c["contract_bodies"]).where("path in ('https://h/f', 'https://h/x')").select("sample")


@golden("url, method, n", [("https://h/a?x=2", "GET", 2)])
def golden_sandbox_calls(spark):
    rows = [("https://h/p", u, "get", "fetch", "", b, []) for u, b in (("/a?t=1&x=2", ""), ("/a?t=9&x=2", ""), ("data:x", ""), ("/a?x=2", "body"))]
    hits = spark.createDataFrame(rows, "page_url string, raw_url string, method string, type string, initiator string, body string, headers array<struct<name: string, value: string>>")
    calls = sandbox.distinct_calls(sandbox.recorded_calls(hits), strip=True)
    return calls.groupBy("url", "method").agg(F.count(F.lit(1)).alias("n"))


@golden("pattern, slots", [("https://h/admin/complex/{id: int}/contacts", "id(int): 9222..9224")])
def golden_patterns(spark):
    urls = [f"https://h/admin/complex/{i}/contacts" for i in (9222, 9223, 9224)] + ["https://h/about"]
    p = patterns.find_patterns(spark.createDataFrame([(u,) for u in urls], "url string"))
    return patterns.described_patterns(p).select("pattern", F.array_join("slots", "; ").alias("slots"))


@golden("pattern, n", [("https://h/report/{id1: int}/{id2: string}", 4), ("https://h/report/2023/{id: string}", 2), ("https://h/report/2024/{id: string}", 2), ("https://h/report/{id: int}/q1", 2), ("https://h/report/{id: int}/q2", 2)])
def golden_two_slots(spark):
    urls = [f"https://h/report/{y}/{q}" for y in (2023, 2024) for q in ("q1", "q2")]
    p = patterns.find_patterns(spark.createDataFrame([(u,) for u in urls], "url string"), group_strings=True)
    return p.select("pattern", F.col("count").cast("long").alias("n"))


@golden("node, parent, depth", [("r", "", 0), ("a", "r", 1), ("b", "r", 1), ("c", "a", 2)])
def golden_crawl_tree(spark):
    edges = spark.createDataFrame([("crawled", a, b, 1) for a, b in (("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "r"))], "kind string, from_key string, to_key string, weight int")
    return graph.crawl_tree(edges, "r").select(F.col("key").alias("node"), "parent", F.col("depth").cast("long").alias("depth"))


@golden("kind, from_key, to_key, weight", [("source", "a", "b", 3), ("source", "a", "c", 1)])
def golden_distinct_edges(spark):
    rows = [("source", "a", "b", 1), ("source", "a", "b", 3), ("source", "a", "c", 1)]
    return graph.distinct_edges(spark.createDataFrame(rows, "kind string, from_key string, to_key string, weight long"))
