import io
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from siteatlas.functions import bodies, documents, javascript
from siteatlas.operators import contracts, crawl, extract, fold, graph, patterns, sandbox, scripts
from siteatlas.plans.session import Report, Session, UnavailableError
from siteatlas.sources import snapshot
from siteatlas.sources.snapshot import Snapshot
from siteatlas.streaming import incremental


def pages(spark, rows):
    return spark.createDataFrame(rows, "url string, body string")


def test_extraction_in_order_of_tags(spark):
    html = """<a href="/p">x</a><IMG src='/i.png'><script src="/s.js"></script><a class=x href="/p">again</a>
      <a href="#top">n</a><a href="javascript:x()">n</a><a href="!!!">n</a><style>@import "/c.css"</style>
      <script>import v from '@vue/core'; le.from("not"); export {x} from "getAll"</script><link rel=x href="/l.css">
      <source src="/o.webm"><video src="/v.mp4"></video><audio src="/a.mp3"></audio><iframe src="/f"></iframe>"""
    rows = extract.extract_links(pages(spark, [("https://h/a/", html)])).orderBy("rank", "pos").collect()
    assert [(r.tag, r.href) for r in rows] == [
        ("a", "/p"), ("script", "/s.js"), ("link", "/l.css"), ("img", "/i.png"), ("source", "/o.webm"), ("video", "/v.mp4"),
        ("audio", "/a.mp3"), ("iframe", "/f"), ("css-import", "/c.css"), ("js-import", "@vue/core"),
    ]


def test_references_point_at_the_url(spark):
    html = "<p>é</p>\n<a\n href=\"/x\">t</a>" + " " * 100 + '<img src="/y.png">'
    found = extract.references(pages(spark, [("https://h/", html)])).collect()
    raw = html.encode()
    for r in found:
        assert raw[r.offset : r.offset + len(r.target)] == r.target.encode()
        assert r.line == raw[: r.offset].count(b"\n") + 1 and r.column == r.offset - raw[: r.offset].rfind(b"\n")
    assert {r.target: r.line for r in found} == {"/x": 3, "/y.png": 3}
    assert all("\n" not in r.snippet for r in found)


def test_text_urls(spark):
    text = "See https://a.example/Foo_(bar), (www.b.example). //c.example/x; //nohost and http://d.example/y(also ok"
    rows = extract.text_urls(pages(spark, [("d", text)])).orderBy("pos").collect()
    assert [r.href for r in rows] == ["https://a.example/Foo_(bar)", "http://www.b.example", "//c.example/x", "http://d.example/y"]


def test_scripts_of_a_page(spark):
    html = '<script>a()</script><script src="/s.js?v=1"></script><script type="text/x-tmpl">t</script><script type=module> b() </script>'
    p = pages(spark, [("https://h/p", html)])
    assert [r.code for r in extract.inline_scripts(p).orderBy("pos").collect()] == ["a()", "b()"]
    responses = spark.createDataFrame([("https://h/s.js?v=1", b"ext()")], "url string, body binary")
    assert [r.code for r in extract.page_scripts(p, responses).orderBy("pos").collect()] == ["a()", "ext()", "t", "b()"]


def brute_patterns(urls, strings):
    from collections import defaultdict

    by_host = defaultdict(list)
    for u in urls:
        host, _, path = u.split("://")[1].partition("/")
        by_host[host].append(path.split("/"))
    return {(h, m) for h, paths in by_host.items() for m in incremental.shapes(paths, 2, strings)}


@pytest.mark.parametrize("strings", [False, True])
def test_patterns_match_pairing(spark, strings):
    rng = random.Random(4)
    seg = lambda: rng.choice(["7", "12", "x", "y", "en", "0123456789abcdef0", "a-b", "9"])
    urls = sorted({f"https://h{rng.randrange(3)}.example/" + "/".join(seg() for _ in range(rng.randrange(1, 6))) for _ in range(160)})
    urls += ["https://deep.example/" + "/".join(["a"] * 8 + [str(i), "z"]) for i in range(3)]
    found = patterns.find_patterns(spark.createDataFrame([(u,) for u in urls], "url string"), group_strings=strings).collect()
    assert {(r.domain, tuple(r["mask"])) for r in found} == brute_patterns(urls, strings)
    for r in found:
        assert len(r.members) == r["count"] >= 2


def test_pattern_texts(spark):
    urls = [f"https://h/admin/complex/{i}/contacts" for i in (9222, 9223, 9224)] + ["https://h/about"]
    p = patterns.find_patterns(spark.createDataFrame([(u,) for u in urls], "url string"))
    r = patterns.described_patterns(p).collect()
    assert len(r) == 1 and r[0].pattern == "https://h/admin/complex/{id: int}/contacts" and list(r[0].slots) == ["id(int): 9222..9224"]
    best = patterns.best_pattern(spark.createDataFrame([("https://h/admin/complex/1/contacts?x=1",), ("https://h/other",)], "url string"), p)
    assert [(b.url, b.pattern) for b in best.collect()] == [("https://h/admin/complex/1/contacts?x=1", r[0].pattern)]


def test_a_large_bucket_does_not_starve_its_siblings(spark):
    urls = [f"https://h/static/asset{i}.png" for i in range(2500)] + [f"https://h/complex/{i}" for i in range(62)]
    p = patterns.find_patterns(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [(r.pattern, r["count"]) for r in p] == [("https://h/complex/{id: int}", 62)]


def links(spark, rows):
    base = spark.createDataFrame(rows, "href string, source_url string, seq long")
    l = extract.with_resolved(extract.described(base.withColumn("tag", F.lit("a")), extract.CLI_RULES))
    return l.withColumn("depth", F.lit(1)).withColumn("param_variants", F.array().cast("array<string>"))


def test_folding_does_not_depend_on_order(spark):
    rows = [("/l?page=2", "https://h/a", 1), ("/l", "https://h/b", 2), ("/l?page=1&q=x", "https://h/a", 3), ("/m?z=1", "https://h/a", 4)]
    results = []
    for order in (rows, rows[::-1]):
        f = fold.fold_params(links(spark, order)).orderBy("resolved").collect()
        results.append([(r.href, r.source_url, list(r.param_variants), r.has_params) for r in f])
    assert results[0] == results[1] == [("/l", "https://h/b", ["?page=1&q=x", "?page=2"], False), ("/m", "https://h/a", ["?z=1"], False)]


def test_stats_have_empty_labels(spark):
    stats = {(r.dimension, r.key): r.n for r in fold.link_stats(links(spark, [("/a", "https://h/", 1), ("/b.js?v=1", "https://h/", 2)])).collect()}
    assert stats["category", "web-asset"] == 1 and stats["category", "API"] == 0 and stats["class", "cache"] == 1 and stats["links", "total"] == 2


def test_normalize_is_idempotent_and_gives_every_source_a_node(spark):
    l = links(spark, [("/x", "https://h/p", 1), ("/x", "https://h/q", 2), ("/y?a=1", "https://h/p", 3)])
    once = graph.normalize(l, "https://h/")
    rows = {r.key: r for r in once.collect()}
    assert set(rows) == {"https://h/x", "https://h/y?a=1", "https://h/p", "https://h/q", "https://h/"}
    assert rows["https://h/p"].synthesized and not rows["https://h/x"].synthesized and list(rows["https://h/y?a=1"].param_variants) == ["a=1"]
    again = graph.normalize(once.drop("key").withColumn("seq", F.lit(0)), "https://h/")
    key = lambda df: sorted((r.key, r.synthesized, list(r.param_variants), r.category) for r in df.collect())
    assert key(again) == key(once)


def observation(url, method="GET", headers=(), body="", fields=(), only=False, inferred=False, names=(), seq=0):
    return (url, method, list(headers), body, list(fields), only, inferred, list(names), seq)


def inferred(spark, rows):
    rows = [(*r[:-1], i) for i, r in enumerate(rows)]
    return {k: v.collect() for k, v in contracts.infer_contracts(spark.createDataFrame(rows, contracts.OBSERVATION)).items()}


def test_query_kinds(spark):
    rows = [observation(f"https://h/d.php?ID={i}&f={i}.5&on={'yes' if i else 'no'}&day=2024-01-0{i + 1}&c=red{i}&csrf=q&flag=") for i in range(3)]
    found = inferred(spark, rows)
    kinds = {f.name: f.kind for f in found["contract_fields"]}
    assert kinds == {"ID": "uint", "f": "float", "on": "bool", "day": "date", "c": "enum", "csrf": "token", "flag": "bool"}
    assert found["endpoints"][0].calls == 3 and list(found["endpoints"][0].methods) == ["GET"]
    assert "csrf=<csrf>" in found["endpoints"][0].raw[0]


def test_placeholders_are_no_values(spark):
    rows = [observation("https://h/a", "POST", body="x=<x>&y=1"), observation("https://h/a", "POST", body="x=5&y=2", names=[("z", "")])]
    f = {r.name: r for r in inferred(spark, rows)["contract_fields"]}
    assert list(f["x"]["values"]) == ["5"] and f["x"].inferred and f["z"].kind == "unknown"


def test_bodies(spark):
    rows = [
        observation("https://h/j", "POST", body='{"number": 3, "o": {"k": [1], "d": {"x": 1}}, "n": null}'),
        observation("https://h/r", "POST", body='{"jsonrpc":"2.0","method":"m1","params":{"a":1},"id":1}'),
        observation("https://h/r", "POST", body='{"jsonrpc":"2.0","method":"m2","params":{"a":2},"id":1}'),
        observation("https://h/s", "POST", body="{cameraId:n, t:'x'}"),
        observation("https://h/f", "POST", body="a=1&b=%20x", headers=[("Content-Type", "application/x-www-form-urlencoded; charset=x")]),
        observation("https://h/x", "POST", body="<a/>"),
    ]
    found = inferred(spark, rows)
    by = {r.path: r for r in found["contract_bodies"]}
    assert by["https://h/j"].sample == '{"n": null, "number": 1, "o.k": <o.k>}'.replace("<o.k>", "<o.k>")
    assert list(by["https://h/r"].methods) == ["m1", "m2"] and '"method":"m2"' in by["https://h/r"].sample
    assert by["https://h/s"].kind == "json" and by["https://h/f"].mime == "application/x-www-form-urlencoded"
    assert by["https://h/x"].sample == "<xml>"


def test_endpoint_only_and_methods(spark):
    rows = [observation("https://h/e/", only=True), observation("https://h/e", "post", inferred=True), observation("https://h/u", only=True)]
    e = {r.path: r for r in inferred(spark, rows)["endpoints"]}
    assert not e["https://h/e"].unobserved and list(e["https://h/e"].methods) == ["POST"] and e["https://h/e"].method_inferred
    assert e["https://h/u"].unobserved and e["https://h/u"].calls == 0


def test_redacted_bodies():
    assert bodies.redacted('{"token":"x","b":2}') == '{"b":2,"token":"\\u003ctoken\\u003e"}'
    assert bodies.redacted("sid=1&a=2&bare") == "sid=<sid>&a=2&bare"


CALLS = {
    "fetch('https://api.example.com/data')": 1, "$.ajax({url: '/api/items', type: 'POST'})": 1, "fetch('/assets/logo.png')": 0,
    "const B = '/api/v1';\nconst U = B + '/users';\nfetch(U);": 1, "// fetch('/api/commented')": 0, "{endpoint: '/api/data'}": 1,
    "let url = '/api/init'; url = '/api/updated'; fetch(url);": 2, "var u = '/about/team';": 0,
    "var url='/api/d'; var xhr = new XMLHttpRequest(); xhr.open('GET', url);": 1, "const id=1; fetch(`/api/users/${id}`)": 1,
}


@pytest.mark.parametrize("code", CALLS)
def test_script_links(code):
    assert len(javascript.analyze(code, "https://h/").links) == CALLS[code]


@pytest.mark.parametrize(
    "code,address,method,guess",
    [
        ('q("/api/a",{f:1});', "/api/a", "GET", True),
        ('myHttp.post("/api/b",{id:1});', "/api/b", "POST", False),
        ('api["post"]("/api/c",{id:1});', "/api/c", "POST", False),
        ('request({url:"/api/e", method:"PUT", data:{x:1}});', "/api/e", "PUT", False),
        ('client.load("/api/h",{page:2});', "/api/h?page=2", "GET", False),
        ('if(x){if(y){if(z){}}}post("/api/l",{c:3});', "/api/l", "POST", False),
    ],
)
def test_script_requests(code, address, method, guess):
    hit = next(r for r in javascript.analyze(code, "https://h/").requests if address in r["url"])
    assert (hit["method"], hit["method_inferred"], hit["endpoint_only"]) == (method, guess, False)


def test_response_fields_and_params(spark):
    code = """
      const qs = new URLSearchParams(location.search); qs.set('geo', 'x');
      const fd = new FormData(); fd.append('avatar', f);
      const sp = new URLSearchParams(); sp.set('sort', 'price');
      fetch('/api/search', {method: 'POST', body: sp}).then(r => r.json()).then(d => { d.items.map(x => x); d.meta.total; });"""
    found = scripts.analyze_scripts(spark.createDataFrame([("https://h/p", code), ("https://h/bad", "((({{{`${")], "url string, code string")).cache()
    params = {(r.name, r.kind): r.owner for r in scripts.script_params(found).collect()}
    assert params == {("geo", "query"): "page", ("avatar", "form"): "unassigned", ("sort", "query"): "request"}
    obs = scripts.script_observations(found)
    assert {f["path"] for r in obs.collect() for f in r.response_fields} >= {"items[]", "meta.total"}
    fields = contracts.infer_contracts(obs)["contract_fields"].where("section = 'query'").collect()
    assert [(r.name, r.kind) for r in fields] == [("sort", "unknown")]
    assert {r.category for r in scripts.script_links(found).collect()} == {"API"}
    assert [t for t, _ in javascript.url_templates("a=`/x/${id}/y`; b=`hi ${n}`; c=`${base}/z`")] == ["/x/{id}/y", "{base}/z"]


def test_document_kinds_and_texts(spark):
    stream = zlib.compress(b"(http://in.stream/x)")
    pdf = b"%PDF-1.4 /URI (http://a.example/\\(p\\)) stream\n" + stream + b"\nendstream"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/_rels/x.rels", '<R Target="https://rel.example/d"/>')
    rows = [
        ("https://h/a.pdf", "application/pdf", pdf), ("https://h/b.docx", "", box.getvalue()), ("https://h/c.txt", "text/plain", b"go http://t.example/x."),
        ("https://h/d.doc", "", "see http://wide.example/y ".encode("utf-16-le")), ("https://h/e.bin", "", b"\x00\x01\x02"), ("https://h/f", "text/html", b"<html>"),
    ]
    r = spark.createDataFrame(rows, "url string, content_type string, body binary")
    kinds = {x.url[-5:]: x.k for x in r.select("url", documents.kinds(F.col("body"), F.col("url"), F.col("content_type")).alias("k")).collect()}
    assert kinds["a.pdf"][0] == "pdf" and kinds[".docx"] == ["zip"] and kinds["c.txt"] == ["text"] and kinds["d.doc"] == ["legacy"] and kinds["e.bin"] == [] and kinds["//h/f"] == []
    found = {x.href for x in documents.document_links(r).collect()}
    assert {"http://in.stream/x", "https://rel.example/d", "http://t.example/x", "http://wide.example/y"} <= found


def test_code_and_markup(spark):
    df = spark.createDataFrame([("const a = () => fetch('x')",), ("<!-- c --><div>const let </div>",), ("plain words",)], "t string")
    got = [tuple(r) for r in df.select(documents.looks_like_code(F.col("t")), documents.looks_like_markup(F.col("t"))).collect()]
    assert got == [(True, False), (False, True), (False, False)]


def test_sandbox_calls(spark):
    rows = [("https://h/p", "/a?t=1&x=2", "get", "fetch", "", "", []), ("https://h/p", "/a?t=9&x=2", "get", "fetch", "", "", []), ("https://h/p", "data:x", "get", "image", "", "", []), ("https://h/p", "/a?x=2", "get", "fetch", "", "body", [])]
    hits = spark.createDataFrame(rows, "page_url string, raw_url string, method string, type string, initiator string, body string, headers array<struct<name: string, value: string>>")
    calls = sandbox.recorded_calls(hits)
    assert sandbox.distinct_calls(calls).count() == 3 and sandbox.distinct_calls(calls, strip=True).count() == 2
    errors = spark.createDataFrame([("x: TypeError: a at b",), ("y: TypeError: a\nz",)], "error string")
    s = sandbox.summary(calls, errors, 2).first()
    assert s.calls == 3 and s.errors == 1 and s.by_type == {"fetch": 3}


def site(spark):
    html = {
        "https://h/": '<a href="/a/">a</a><a href="/b">b</a><a href="https://o.example/x">o</a>',
        "https://h/a/": '<a href="/c/1">1</a><a href="/c/2">2</a><a href="/b">b</a>',
        "https://h/b": '<a href="/api/data">d</a><a href="/">home</a><img src="/i.png">',
        "https://h/c/1": '<a href="/deep">deep</a>',
    }
    rows = [(u, 200, "text/html", b.encode()) for u, b in html.items()] + [("https://h/json", 200, "application/json", b"{}")]
    return spark.createDataFrame(rows, "url string, status int, content_type string, body binary")


def capture(spark):
    got = crawl.crawl(site(spark), "https://h/", crawl.CrawlOptions(max_depth=3))
    l = graph.normalize(got["links"].withColumn("seq", F.xxhash64("href")).withColumn("param_variants", F.array().cast("array<string>")).drop("rank", "pos"), "https://h/")
    l = l.drop("key")
    p = patterns.link_patterns(l)
    obs = spark.createDataFrame([observation("https://h/api/data?q=1")], contracts.OBSERVATION)
    made = contracts.infer_contracts(obs)
    params = spark.createDataFrame([("q", "query", "request", "x", ["https://h/api/data"], 1)], "name string, kind string, owner string, carrier string, endpoints array<string>, count long")
    edges = graph.derive_edges(l, got["pages"], p, made["endpoints"], params)
    return Snapshot({"links": l, "pages": got["pages"], "patterns": p, "observations": obs, **made, "params": params, "edges": edges})


def test_crawl_depth_and_scope(spark):
    got = crawl.crawl(site(spark), "https://h/", crawl.CrawlOptions(max_depth=3))
    assert {r.url: r.depth for r in got["pages"].collect()} == {"https://h/": 0, "https://h/a/": 1, "https://h/b": 1, "https://h/c/1": 2}
    assert {r.href for r in got["links"].collect()} == {"/a/", "/b", "https://o.example/x", "/c/1", "/c/2", "/api/data", "/i.png", "/deep"}
    shallow = crawl.crawl(site(spark), "https://h/", crawl.CrawlOptions(max_depth=0))
    assert shallow["pages"].count() == 1


def test_snapshot_round_trip_session_and_report(spark, tmp_path):
    path = f"file://{tmp_path}/cap"
    made = capture(spark)
    Snapshot({"links": made["links"].limit(1)}).save(path)
    made.save(path)  # over the first
    c = Snapshot.load(spark, path)
    assert c["links"].count() == made["links"].count() > 1
    s = Session(c, "https://h/")
    assert [r.key for r in s.ls().collect()] == ["https://h/a/", "https://h/b", "https://o.example/x"]
    assert s.cd("a") == "https://h/a/" and s.cd("..") == "https://h/" and s.resolve("c/../x") == "https://h/x"
    assert [r.key for r in s.ls("/c").collect()] == ["https://h/c/1", "https://h/c/2"]
    assert [r.key for r in s.parents("/b").collect()] == ["https://h/"]
    assert s.what("/api/data").first().kind == "API" and list(s.what("/api/data").first().methods) == ["GET"]
    assert s.what("/i.png").first().kind == "asset: img"
    assert [r.key for r in s.find("image", "*.png").collect()] == ["https://h/i.png"]
    assert [r.key for r in s.find("any", "/c/*").collect()] == ["https://h/c/1", "https://h/c/2"]
    assert [r.path for r in s.complete("de").collect()] == ["/deep"] and s.observations("/api/data").count() == 1
    with pytest.raises(UnavailableError):
        s.references()
    with pytest.raises(KeyError):
        s.cd("/nowhere")
    r = Report(c, ["h"])
    assert [x.pattern for x in r.patterns().collect()] == ["https://h/c/{id: int}"]
    assert "/c/1" not in [x.href for x in r.rows().collect()] and "/deep" in [x.href for x in r.rows().collect()]
    assert {x.key: x.depth for x in r.tree("https://h/").collect()} == {"https://h/": 0, "https://h/a/": 1, "https://h/b": 1, "https://h/c/1": 2}
    assert {x.kind for x in r.edges().collect()} == {"source", "crawled", "pattern", "contract", "param"}
    assert r.params().count() == 0 and "# Links" in r.markdown()
    with pytest.raises(ValueError):
        Snapshot.load(spark, f"file://{tmp_path}/none")


def test_union_of_captures(spark):
    a, b = capture(spark), capture(spark)
    b.tables["links"] = b["links"].withColumn("tag", F.lit("other"))
    u = graph.union_captures(a.tables, b.tables)
    assert u["links"].count() == a["links"].count() and u["links"].where("tag = 'other'").isEmpty()
    assert u["edges"].count() == a["edges"].count() and u["observations"].count() == 2
    assert Session(a, "https://h/").extend(b).listed().count() == a["links"].where("not synthesized").count()


def test_archive(spark, tmp_path):
    import tarfile

    refs = extract.references(pages(spark, [("https://h/a/b?x", '<a href="/y">t</a>')]))
    files = snapshot.reference_files(refs)
    assert [r.name for r in files.collect()] == ["h/a/b.ref"]
    back = snapshot.parsed_reference_files(files).collect()
    assert [(r.target, r.offset) for r in back] == [(r.target, r.offset) for r in refs.collect()]
    more = snapshot.put_entries(files, spark.createDataFrame([("h/a/b.ref", bytearray(b"new")), ("x", bytearray(b"1"))], "name string, data binary"))
    assert sorted(r.name for r in more.collect()) == ["h/a/b.ref", "x"] and snapshot.drop_entry(more, "x").count() == 1
    snapshot.write_archive(more.union(more.where("name = 'x'")), str(tmp_path / "a.tar.gz"))
    with tarfile.open(tmp_path / "a.tar.gz") as t:
        assert sorted(t.getnames()) == ["h/a/b.ref", "x", "x-2"]


def test_credentials_are_not_stored(spark):
    meta = {r.key: r.value for r in snapshot.capture_meta(spark, {"depth": "3"}, ["Authorization: Bearer s3cret"]).collect()}
    assert meta == {"depth": "3", "header_names": "Authorization"}
    assert snapshot.masked_command(["scan", "-H", "Cookie: s3cret", "-b=s3cret", "-url", "x"]) == "scan -H *** -b=*** -url x"


def test_detector_stream(spark, tmp_path):
    feed = tmp_path / "in"
    feed.mkdir()
    stream = spark.readStream.schema("url string").json(str(feed))
    q = incremental.absorbed_urls(stream).writeStream.format("memory").queryName("absorbed").outputMode("append").start()
    try:
        for n, urls in enumerate([["https://h/c/1", "https://h/about"], ["https://h/c/2"], ["https://h/c/3", "https://h/d/1"]]):
            (feed / f"{n}.json").write_text("\n".join(json.dumps({"url": u}) for u in urls))
            q.processAllAvailable()
        assert {r.canonical for r in spark.table("absorbed").collect()} == {"https://h/c/2", "https://h/c/3"}
    finally:
        q.stop()


def test_page_log_stream_equals_batch(spark, tmp_path):
    rows = [("https://h/a", 2, "", 3, 1), ("https://h/a", 1, "text/html", 1, 2), ("https://h/b", 0, "x", 0, 3), ("https://h/a", 5, "late", 9, 4)]
    schema = "url string, depth int, content_type string, links int, seq long"
    batch = spark.createDataFrame(rows, schema)
    batch.write.json(str(tmp_path / "v"))
    q = incremental.page_log_stream(spark.readStream.schema(schema).json(str(tmp_path / "v"))).writeStream.format("memory").queryName("log").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("log").collect())) == sorted(map(tuple, fold.page_log(batch).collect())) == [("https://h/a", 1, "text/html", 9), ("https://h/b", 0, "x", 0)]
    finally:
        q.stop()


def paired_members(urls):
    """(mask, url) of all pairs of a bucket, by comparing every two."""
    import itertools

    expected, by_bucket = set(), {}
    for u in urls:
        segs = tuple(u.split("/")[3:])
        by_bucket.setdefault((len(segs), "" if segs[0].isdigit() else segs[0]), []).append((u, segs))
    for rows in by_bucket.values():
        for (u, a), (v, b) in itertools.combinations(rows, 2):
            mask = tuple("" if x != y else x for x, y in zip(a, b, strict=True))
            expected |= {(mask, u), (mask, v)}
    return expected


def deep_urls(rng, size):
    """Depths 9 to 12 that vary in four segments; of up to 150 URLs, those of depth 12 in eleven."""
    urls = set()
    while len(urls) < size:
        n = rng.choice([9, 11, 12])
        segs = [f"f{k}" for k in range(n)]
        for k in rng.sample(range(1, n), 4) if n == 12 and size <= 150 else [1, 4, 5, n - 1]:
            segs[k] = str(rng.randrange(4 if size <= 150 else 12))
        urls.add("https://deep.example/" + "/".join(segs))
    return sorted(urls)


@pytest.mark.parametrize("size", [0, 1, 150, 2000])
def test_deep_patterns_match_pairing(spark, size):
    urls = deep_urls(random.Random(17), size)
    if size:
        urls += ["https://deep.example/" + "/".join(["5"] * 70 + [x] * 3) for x in "12"]  # more segments than a long has bits
    rows = patterns.masked(patterns.canonical_urls(spark.createDataFrame([(u,) for u in urls], "url string")))
    found = [(tuple(r["mask"]), r["canonical"]) for r in rows.select("mask", "canonical").collect()]
    assert len(found) == len(set(found)) and set(found) == paired_members(urls)
