"""URL algebra as column expressions.

URLs are split by regular expressions of the generic syntax; nothing leaves the
JVM.  Absent parts are empty strings, never null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Percent-encoded bytes of a path that stay as they are in it.
PATH_SAFE = r"A-Za-z0-9\-._~$&+,/:;=@!'()*%"

# Query keys that only defeat caches.
CACHE_BUSTERS = "t _ v ver version rnd rand random ts cb nocache cache cachebuster _dc r".split()
SCRIPT_SUFFIXES = ".js .mjs .cjs .jsx .ts .tsx .mts .cts".split()


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(ASCII_SPACE))


def cut_at(c: Column, marks: str) -> Column:
    """The part before the first of ``marks``."""
    return F.regexp_extract(c, f"^[^{marks}]*", 0)


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, SCHEME, 1))


def host(c: Column) -> Column:
    """Host with port, without user information; empty without an authority."""
    return F.regexp_replace(F.regexp_extract(c, AUTHORITY, 1), "^.*@", "")


def without_port(h: Column) -> Column:
    return cut_at(h, ":")


def raw_path(c: Column) -> Column:
    """The path as written."""
    return F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def raw_query(c: Column) -> Column:
    """What follows the first ?, without the fragment."""
    return F.regexp_extract(c, r"^[^?]*\?([^#]*)", 1)


def decoded(c: Column) -> Column:
    """Percent-decoded; as it is where an escape is invalid.  A plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def form_decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def encoded_path(c: Column) -> Column:
    """A path with what may not stand in it percent-encoded, in UTF-8."""
    one = F.when(c.rlike(f"^[{PATH_SAFE}]*$"), c)
    parts = F.transform(
        F.regexp_extract_all(c, F.lit(f"([{PATH_SAFE}]+|[^{PATH_SAFE}]+)"), F.lit(1)),
        lambda p: F.when(p.rlike(f"^[{PATH_SAFE}]"), p).otherwise(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))),
    )
    return F.coalesce(one, F.array_join(parts, ""))


def is_web(c: Column) -> Column:
    return scheme(c).isin("http", "https") & (host(c) != "")


def canonical(c: Column) -> Column:
    """scheme://host and the encoded path without trailing slashes; null for what is no absolute URL."""
    t = trimmed(c)
    whole = F.concat(scheme(t), F.lit("://"), host(t), F.regexp_replace(encoded_path(raw_path(t)), "/+$", ""))
    return F.when((scheme(t) != "") & (host(t) != ""), whole)


def segments(c: Column) -> Column:
    """Decoded path segments of an http(s) URL; null if it has none."""
    path = F.regexp_replace(decoded(raw_path(c)), "^/+|/+$", "")
    return F.when(is_web(c) & (path != ""), F.split(path, "/", -1))


def split_query(c: Column) -> tuple[Column, Column]:
    """(base, query with its mark); a bare mark at the end is no query."""
    at = F.instr(c, "?")
    has = (at > 0) & (at < F.char_length(c))
    return F.when(has, F.substring_index(c, "?", 1)).otherwise(c), F.when(has, F.substr(c, at)).otherwise(F.lit(""))


def drop_query(c: Column) -> Column:
    return split_query(c)[0]


def path_of(c: Column) -> Column:
    """What follows the host; the whole of a URL without a scheme."""
    rest = F.regexp_extract(c, r"^.*?://[^/]*(/[\s\S]*)?$", 1)
    return F.when(F.instr(c, "://") == 0, c).when(rest == "", F.lit("/")).otherwise(rest)


def path_only(c: Column) -> Column:
    p = cut_at(path_of(c), "?#")
    return F.when(p == "", F.lit("/")).otherwise(p)


def place_key(c: Column) -> Column:
    """Decoded path without trailing slashes: two URLs of one place have the same."""
    p = F.regexp_replace(decoded(path_only(c)), "(?<=.)/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def host_path_key(c: Column) -> Column:
    return F.concat(F.lower(host(c)), place_key(c))


def link_type(c: Column) -> Column:
    return (
        F.when(c.startswith("//"), "web")
        .when(c.startswith("http://") | c.startswith("https://"), "absolute")
        .otherwise("relative")
    )


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(c: Column, parts: list[str]) -> Column:
    return any_of([c.contains(p) for p in parts if p])


def ends_with_any(c: Column, parts: list[str]) -> Column:
    return any_of([c.endswith(p) for p in parts])


def host_in(h: Column, domains: list[str], empty: bool = False) -> Column:
    """Whether a host, port aside, is one of the domains or below one; ``empty`` is the answer for no host."""
    name = F.lower(without_port(h))
    hit = any_of([(name == d) | name.endswith("." + d) for d in domains])
    return F.when(name == "", F.lit(empty)).otherwise(hit)


def is_script(c: Column) -> Column:
    return ends_with_any(F.lower(cut_at(c, "?#")), SCRIPT_SUFFIXES)


def short_source(c: Column) -> Column:
    """A source's path, from the left cut to 44 characters."""
    s = cut_at(path_of(c), "?#")
    return F.when(F.octet_length(s) > 44, F.concat(F.lit("..."), F.right(s, F.lit(41)))).otherwise(s)


def without_cache_busters(c: Column) -> Column:
    """The URL without cache-busting keys, the others sorted by name and encoded again."""
    pairs = F.filter(F.split(raw_query(c), "&", -1), lambda p: (p != "") & ~p.contains(";"))
    named = F.transform(
        pairs,
        lambda p: F.struct(
            form_decoded(F.substring_index(p, "=", 1)).alias("k"),
            form_decoded(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v"),
        ),
    )
    kept = F.filter(named, lambda p: ~p["k"].isin(CACHE_BUSTERS))
    # a stable sort by key: the position breaks ties
    order = F.array_sort(F.transform(kept, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    query = F.array_join(F.transform(order, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    fragment = F.regexp_extract(c, r"(#[\s\S]*)$", 1)
    mark = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.when(raw_query(c) == "", c).otherwise(F.concat(cut_at(c, "?#"), mark, fragment))


def append_query(c: Column, params: Column) -> Column:
    """A URL with encoded pairs (array of struct<name, value>) appended in order of their names."""
    named = F.filter(params, lambda p: p["name"] != "")
    order = F.array_sort(
        F.transform(named, lambda p, i: F.struct(p["name"].alias("n"), i.alias("i"), p["value"].alias("v")))
    )
    query = F.array_join(F.transform(order, lambda p: F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"]))), "&")
    sep = F.when(c.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when((c == "") | (F.size(params) == 0), c).otherwise(F.concat(c, sep, query))


def resolve_endpoint(endpoint: Column, base: Column) -> Column:
    """An endpoint of a script as an absolute URL; relative ones hang on the root of the script's host."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    return (
        F.when((endpoint == "") | endpoint.startswith("http://") | endpoint.startswith("https://"), endpoint)
        .when(endpoint.startswith("//"), F.concat(F.lit("https:"), endpoint))
        .when(endpoint.startswith("/"), F.concat(root, endpoint))
        .when(base != "", F.concat(root, F.lit("/"), endpoint))
        .otherwise(endpoint)
    )


def resolve(page: Column, href: Column) -> Column:
    """``href`` against the page it is on; empty where the page is no usable base.

    Dot segments are taken out by folding the segments over a stack.
    """
    h = trimmed(href)
    own_scheme = scheme(h)
    root = F.concat(scheme(page), F.lit("://"), host(page))
    fragment = F.regexp_extract(h, r"(#[\s\S]*)$", 1)
    tail = F.concat(F.regexp_extract(h, r"^[^?#]*(\?[^#]*)", 1), fragment)
    path = raw_path(h)
    folder = F.regexp_replace(raw_path(page), "[^/]*$", "")
    merged = F.when(path.startswith("/"), path).when(folder == "", F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    page_query = F.regexp_extract(page, r"^[^?#]*(\?[^#]*)", 1)
    same = F.concat(root, encoded_path(raw_path(page)), F.when(tail.startswith("?"), F.lit("")).otherwise(page_query), tail)
    joined = F.concat(root, encoded_path(without_dots(merged)), tail)
    on_host = F.concat(scheme(page), F.lit("://"), host(h), encoded_path(without_dots(path)), tail)
    absolute = F.concat(own_scheme, F.lit("://"), host(h), encoded_path(without_dots(path)), tail)
    return (
        F.when((h == "") | (host(page) == ""), F.lit(""))
        .when((own_scheme != "") & (host(h) != ""), absolute)
        .when(own_scheme != "", h)
        .when(h.startswith("//"), on_host)
        .when(path == "", same)
        .otherwise(joined)
    )


def without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    push = lambda stack, p: (
        F.when(p == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        .when(p == ".", stack)
        .otherwise(F.concat(stack, F.array(p)))
    )
    kept = F.aggregate(parts, F.array().cast("array<string>"), push)
    last = F.element_at(parts, -1)
    slash = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), slash)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), folded).otherwise(path)
