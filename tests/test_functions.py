import pytest
from pyspark.sql import functions as F

from siteatlas.functions import classify, url
from siteatlas.rules import CLI_RULES, LIBRARY_RULES, PRESETS, load_rules, merge_rules, overriding


def values(spark, rows, *columns):
    """Results of column expressions over one column x."""
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(*columns).collect()]


X = None


@pytest.fixture(autouse=True)
def column(spark):
    """A column needs a session, so it is made here."""
    global X
    X = F.col("x")


def test_categories(spark):
    cases = {
        "/apartments/ajax.php": "API", "/graphql": "API", "/js/api.js": "web-asset", "/data/manifest.json": "web-asset",
        "/about/team": "web-page", "/": "web-page", "/a.PNG?v=1": "web-asset", "/x/login.php": "API", "/x/login.php?a=1": "web-page",
        "/static/page": "web-asset", "https://static.h/x": "web-asset", "/wp-json/x": "API",
    }
    assert values(spark, cases, classify.category(X, LIBRARY_RULES)) == list(cases.values())
    assert values(spark, ["/wp-json/x"], classify.category(X, CLI_RULES)) == ["web-page"]


def test_classes(spark):
    cases = {
        "/cdn-cgi/x": "WAF", "https://unpkg.com/x": "CDN", "/a.js?v=3": "cache", "a;b/c": "noise", "word": "noise", "/ok": "normal",
        "example.com": "normal", "x => y/z": "noise", "${a}/b": "noise", " /trim ": "normal",
    }
    assert values(spark, cases, classify.url_class(X)) == list(cases.values())


def test_segment_kinds(spark):
    cases = {
        "9223": "int", "123e4567-e89b-12d3-a456-426614174000": "uuid", "d41d8cd98f00b204e9800998ecf8427e": "hash",
        "aGVsbG8gd29ybGQIL==": "base64", "my-awesome-post": "string", "{id}": "", "": "",
    }
    assert values(spark, cases, classify.segment_kind(X)) == list(cases.values())


def test_resolution(spark):
    page = F.lit("https://h.example:8443/a/b/page.html?q=1")
    cases = {
        "/x": "https://h.example:8443/x", "c": "https://h.example:8443/a/b/c", "../c": "https://h.example:8443/a/c",
        "./c/../d/": "https://h.example:8443/a/b/d/", "//o.example/p": "https://o.example/p", "?z=2": "https://h.example:8443/a/b/page.html?z=2",
        "#f": "https://h.example:8443/a/b/page.html?q=1#f", "http://o/x/./y": "http://o/x/y", "mailto:a@b": "mailto:a@b", "": "",
        "é ü": "https://h.example:8443/a/b/%C3%A9%20%C3%BC", "../../../up": "https://h.example:8443/up", "%7Bt%7D": "https://h.example:8443/a/b/%7Bt%7D",
    }
    assert values(spark, cases, url.resolve(page, X)) == list(cases.values())


def test_url_parts(spark):
    rows = ["https://u:p@H.example:80/a%20b//c/?x=1#f", "relative/p?", "http://h", "//h/p"]
    assert values(spark, rows, url.host(X)) == ["H.example:80", "", "h", "h"]
    assert values(spark, rows, url.canonical(X)) == ["https://H.example:80/a%20b//c", None, "http://h", None]
    assert values(spark, rows, url.segments(X)) == [["a b", "", "c"], None, None, None]
    assert values(spark, rows, *url.split_query(X)) == [("https://u:p@H.example:80/a%20b//c/", "?x=1#f"), ("relative/p?", ""), ("http://h", ""), ("//h/p", "")]
    assert values(spark, ["https://h/%7Bt%7D/x/?q", "http://h", "/p#f", "http://h/"], url.place_key(X)) == ["/{t}/x", "/", "/p", "/"]


def test_scope(spark):
    hosts = ["example.com", "api.example.com:8080", "notexample.com", "example.com.evil.io", ""]
    assert values(spark, hosts, url.host_in(X, ["example.com"])) == [True, True, False, False, False]
    assert values(spark, hosts, classify.domain_kind(X, F.lit("example.com"))) == ["target", "other", "other", "other", "other"]


def test_scripts_and_cache_busters(spark):
    assert values(spark, ["/a.js?v=1", "/b.mjs", "/c.json", "/js"], url.is_script(X)) == [True, True, False, False]
    rows = {"https://h/a?t=1&b=2&a=x%20y": "https://h/a?a=x+y&b=2", "https://h/a?_=3": "https://h/a", "https://h/a": "https://h/a"}
    assert values(spark, rows, url.without_cache_busters(X)) == list(rows.values())


def test_param_annotation(spark):
    df = spark.createDataFrame([(["?page=2&q=b", "?q=a&debug", "?q=a", "?e="],), ([],), (["?n=" + str(i) for i in range(7)],)], "q array<string>")
    shown = [r[0] for r in df.select(classify.format_variants(F.col("q"))).collect()]
    assert shown == ["e; page=2; q=a,b", "", "n=0,1,2,3,4+..."]


def test_secrets_are_masked(spark):
    rows = {
        "a=1&sessid=xyz&csrf_token=q": "a=1&sessid=<sessid>&csrf_token=<csrf_token>",
        "id=0123456789abcdef01234567&w=applicationxwwwformurlencodedlong": "id=<id>&w=applicationxwwwformurlencodedlong",
        "bare&=x": "bare&=x",
    }
    assert values(spark, rows, classify.redact_query(X)) == list(rows.values())


def test_endpoints(spark):
    cases = {"/api/x": True, "/about": False, "/a.php?x=1": True, "/static/app.css": False, "/api/{id}": False, "api/x": False, "/api/x y": False}
    assert values(spark, cases, classify.looks_like_endpoint(X)) == list(cases.values())
    assert values(spark, ["/api/{id}/y"], classify.endpoint_shape(X)) == [True]


def test_small_functions(spark):
    assert values(spark, ["a.png 1x, b.png  2x", ""], classify.srcset(X)) == [["a.png", "b.png"], []]
    assert values(spark, ["x{background:url( 'a b.png' )} url(c.png)"], classify.css_urls(X)) == [["a b.png", "c.png"]]
    assert values(spark, ["[]", "(", "{a:1}\n  x", "y" * 80], classify.clean_args(X)) == ["[]", "", "{a:1} x", "y" * 67 + "..."]
    assert values(spark, ["https://h/x.js: TypeError: a is b at f (x:1)\nmore"], classify.emulation_error(X)) == ["TypeError: a is b"]
    assert values(spark, ["/x/api/y/z", "/a/b", ""], classify.api_path_key(X)) == ["/api/y", "/b", "/."]
    assert values(spark, ["lodash", "getAll", "@vue/x", "a b", ":case", "./m"], classify.is_module_specifier(X)) == [True, False, True, False, False, True]
    assert values(spark, ["https://a-b.c/d?e=1"], classify.node_id(X)) == ["nhttps_a_b_c_d_e_1"]


def test_rules(tmp_path):
    both = merge_rules(CLI_RULES, PRESETS["wp"], PRESETS["bitrix"])
    assert both.api[-1] == "/oauth/" and "wp-api" in both.tags and list(both.tags)[0] == "auth"
    f = tmp_path / "r.json"
    f.write_text('{"api_patterns": ["/mine/"], "unknown": 1, "tags": {"m": ["/m/"]}}')
    assert merge_rules(CLI_RULES, load_rules(str(f))).api[-1] == "/mine/"
    assert overriding(CLI_RULES, api=["/only/"], waf=[]).api == ["/only/"] and overriding(CLI_RULES, waf=[]).waf == CLI_RULES.waf
    f.write_text('{"api_patterns": "x"}')
    with pytest.raises(ValueError):
        load_rules(str(f))
