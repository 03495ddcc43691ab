"""Classification of hrefs, segments, hosts and values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteatlas.functions.url import any_of, contains_any, cut_at, ends_with_any, trimmed
from siteatlas.rules import CLI_RULES, Rules

# Parts of a .php path that mark a handler.
PHP_HANDLERS = (
    "/api /ajax /rest /rpc /xhr /handler /gateway /service /endpoint /action /process /submit /callback "
    "/webhook /notify /push /pull /login /auth /token /oauth /search /query /lookup"
).split()
# Asset subtypes by suffix.
ASSET_SUFFIXES = {
    "js": ".js .mjs .cjs .jsx .ts .tsx .mts .cts",
    "css": ".css .scss .sass .less",
    "img": ".png .jpg .jpeg .gif .svg .ico .webp .avif",
    "font": ".woff .woff2 .ttf .otf .eot",
    "doc": ".pdf .doc .docx .zip .rar",
    "media": ".mp4 .webm .ogg .mp3 .wav .flac",
    "data": ".json .xml",
}
# Parts of hosts that everyone links to.
WELL_KNOWN_HOSTS = (
    "cloudflare cloudflareinsights googleapis googletagmanager google-analytics google gstatic youtube ytimg github "
    "githubusercontent facebook fbcdn twitter twimg x.com linkedin jsdelivr cdnjs unpkg bootstrapcdn jquery fontawesome "
    "fonts.gstatic fonts.googleapis amazonaws aws microsoft azure vimeo instagram tiktok yandex mail.ru vk"
).split()
# What marks an endpoint in a script's string.
ENDPOINT_SIGNALS = (
    "/api/ /api. _api /rest restapi /rpc /graphql graphql /ajax ajax.php ajax_ -ajax /xhr /fetch/ /v1/ /v2/ /v3/ /v4/ "
    "wp-json admin-ajax xmlrpc.php /bitrix/services/ /bitrix/tools/ /services/main/ajax ?action= &action= action.php "
    "handler.php gateway.php service.php endpoint.php route.php soap.php /webhook /endpoint /gateway /handler /callback "
    "/socket.io /sse/ /oauth /token /graphiql"
).split()
# What rules an endpoint out.
NOT_ENDPOINT_PARTS = (
    ".html .htm .css .png .jpg .jpeg .gif .svg .ico .woff .woff2 .ttf .eot .mp4 .webm .mp3 .pdf .doc .docx # "
    "javascript: mailto: tel: data: about: chrome:"
).split()
NOT_ENDPOINT_SUFFIXES = [".js", ".mjs", ".ts"]
# Parts of an asset's path that make it worth a reader's while.
NAVIGATION_PARTS = ["/api/", "/v1/", "/v2/", "endpoint", "/ajax", "/xhr", "graphql", "/rest/", "_api", ".json", ".xml"]
SKIPPED_SUFFIXES = (
    ".png .jpg .jpeg .gif .svg .ico .webp .avif .css .scss .sass .woff .woff2 .ttf .otf .eot .mp4 .webm .ogg .mp3 .wav "
    ".flac .pdf .doc .docx .zip"
).split()
# Names that usually carry secrets.
SECRET_NAME = (
    r"(?i)sessid|csrf|_token|\btoken\b|x-csrf|apitoken|api[_-]?key|secret|signature|\bsign\b|\bhash\b|\bsid\b|session"
)
PATH_STARTS = ["/", "./", "../", "http://", "https://", "//"]


def starts_with_any(c: Column, parts: list[str]) -> Column:
    return any_of([c.startswith(p) for p in parts])


def has_alphanumeric(c: Column) -> Column:
    return c.rlike("[A-Za-z0-9]")


def is_bare_domain(c: Column) -> Column:
    return ~starts_with_any(c, [".", "http", "//"]) & c.rlike(r"^[A-Za-z0-9._\-]*[A-Za-z][A-Za-z0-9._\-]*$")


def looks_like_url(c: Column) -> Column:
    one_dot = c.rlike(r"^[^.]*\.[^.]*$") & ~c.rlike("[ '\"]") & (F.octet_length(c) > 3) & (F.octet_length(c) < 50)
    return c.contains("/") | (c.contains(".") & (~is_bare_domain(c) | one_dot))


def is_noise(c: Column) -> Column:
    return contains_any(c, [";", "${", "=>"]) | trimmed(c).contains(" ")


def matches_api(c: Column, rules: Rules = CLI_RULES) -> Column:
    return contains_any(F.lower(c), rules.api)


def is_php_handler(c: Column) -> Column:
    """A .php suffix of the whole href; with a query mark in it, or a handler's name."""
    low = F.lower(c)
    return low.endswith(".php") & (c.contains("?") | contains_any(low, PHP_HANDLERS))


def category(c: Column, rules: Rules = CLI_RULES) -> Column:
    low = F.lower(c)
    return (
        F.when(ends_with_any(cut_at(low, "?"), rules.extensions), "web-asset")
        .when(contains_any(low, rules.api) | is_php_handler(c), "API")
        .when(contains_any(low, rules.asset), "web-asset")
        .otherwise("web-page")
    )


def url_class(c: Column, rules: Rules = CLI_RULES) -> Column:
    low = F.lower(c)
    return (
        F.when(contains_any(low, rules.waf), "WAF")
        .when(contains_any(low, rules.cdn), "CDN")
        .when(contains_any(low, rules.cache), "cache")
        .when(~looks_like_url(c) | is_noise(c), "noise")
        .otherwise("normal")
    )


def has_params(c: Column) -> Column:
    at = F.instr(c, "?")
    return (at > 1) & (at < F.char_length(c))


def is_module_specifier(c: Column) -> Column:
    chars = c.rlike(r"^[A-Za-z0-9/._\-@~?#=%+:]{1,512}$")
    plain = ~c.rlike("[:?#=]") & (F.lower(c) == c)
    return chars & (looks_like_url(c) | c.contains("/") | c.contains("@") | plain)


def asset_kind(c: Column) -> Column:
    """js, css, img, font, doc, media, data or asset, by the suffix of the whole href."""
    low, found = F.lower(c), F
    for label, suffixes in ASSET_SUFFIXES.items():
        found = found.when(ends_with_any(low, suffixes.split()), label)
    return found.otherwise("asset")


def domain_kind(host: Column, target: Column) -> Column:
    return (
        F.when(host == "", "other")
        .when(host == target, "target")
        .when(F.endswith(host, F.concat(F.lit("."), target)), "subdomain")
        .when(contains_any(F.lower(host), WELL_KNOWN_HOSTS), "well-known")
        .otherwise("other")
    )


def custom_tag(c: Column, rules: Rules = CLI_RULES) -> Column:
    """The first custom tag, in the rules' order, with a part in the URL; empty if none."""
    low, found = F.lower(c), F
    for tag, parts in rules.tags.items():
        found = found.when(contains_any(low, parts), tag)
    return found.otherwise("") if rules.tags else F.lit("")


def is_base64(c: Column) -> Column:
    return (F.octet_length(c) >= 8) & c.rlike(r"^[0-9A-Za-z+/_\-]+={0,2}$") & (c.endswith("=") | c.rlike("[+/]"))


def segment_kind(c: Column) -> Column:
    """int, uuid, base64, hash or string; empty for what can't be a slot."""
    return (
        F.when((c == "") | c.rlike("[{}]"), "")
        .when(c.rlike(r"^[0-9]+$"), "int")
        .when(c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "uuid")
        .when(is_base64(c), "base64")
        .when(c.rlike(r"^[0-9A-Za-z_\-]{16,}$"), "hash")
        .otherwise("string")
    )


def is_secret(name: Column, value: Column) -> Column:
    """Whether a value must be masked: by its name, or as a long random run with a digit."""
    v = F.btrim(trimmed(value), F.lit("\"'"))
    random = v.rlike(r"^[0-9a-fA-F]{24,}$") | v.rlike(r"^[A-Za-z0-9_\-]{32,}={0,2}$")
    return name.rlike(SECRET_NAME) | (random & v.rlike("[0-9]"))


def shield(name: Column, value: Column) -> Column:
    return F.when(is_secret(name, value), F.concat(F.lit("<"), name, F.lit(">"))).otherwise(value)


def redact_pairs(c: Column, decode: bool) -> Column:
    """k=v&k=v with secret values masked; pairs without a name or a value stay."""
    from siteatlas.functions.url import form_decoded

    def one(p: Column) -> Column:
        k, v = F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", "")
        return F.when(F.instr(p, "=") > 1, F.concat(k, F.lit("="), shield(k, form_decoded(v) if decode else v))).otherwise(p)

    return F.array_join(F.transform(F.split(c, "&", -1), one), "&")


def redact_query(c: Column) -> Column:
    return redact_pairs(c, decode=True)


def clean_args(c: Column) -> Column:
    """One line of arguments, at most 70 characters; empty for punctuation alone."""
    a = F.ltrim(trimmed(c), F.lit(","))
    a = F.regexp_replace(F.replace(F.replace(trimmed(a), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")), " {2,}", " ")
    n = F.octet_length(a)
    empty = (n < 2) | ((n < 5) & ~a.rlike(r"[{\[/]"))
    return F.when(empty, "").when(n <= 70, a).otherwise(F.concat(F.left(a, F.lit(67)), F.lit("...")))


def format_variants(queries: Column) -> Column:
    """``page=2; q=a,b``: distinct values by name, both sorted, cut after five values."""
    pairs = F.filter(
        F.flatten(F.transform(F.array_distinct(queries), lambda q: F.split(F.regexp_replace(q, r"^\?", ""), "&", -1))),
        lambda p: F.instr(p, "=") > 1,
    )
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1))))

    def one(name: Column) -> Column:
        values = F.array_sort(
            F.array_distinct(
                F.filter(
                    F.transform(
                        F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == name),
                        lambda p: F.regexp_replace(p, "^[^=]*=", ""),
                    ),
                    lambda v: v != "",
                )
            )
        )
        shown = F.array_join(F.slice(values, 1, 5), ",")
        more = F.when(F.size(values) > 5, F.lit("+...")).otherwise(F.lit(""))
        return F.when(F.size(values) == 0, name).otherwise(F.concat(name, F.lit("="), shown, more))

    return F.array_join(F.array_sort(F.transform(names, one)), "; ")


def is_likely_not_api(c: Column) -> Column:
    low = F.lower(c)
    return (
        (F.octet_length(c) < 3)
        | contains_any(low, NOT_ENDPOINT_PARTS)
        | ends_with_any(low, NOT_ENDPOINT_SUFFIXES)
        | ~c.contains("/")
    )


def looks_like_endpoint(c: Column, rules: Rules = CLI_RULES) -> Column:
    """The strict test for a string without its call: shaped as a path or URL, no static file, a signal in it."""
    low = F.lower(c)
    shape = F.octet_length(c).between(4, 512) & ~c.rlike(r"[ \t\r\n<>(){}\"'`\\|]") & starts_with_any(c, ["/", "http://", "https://"])
    signal = (low.contains(".php") & c.contains("?")) | matches_api(c, rules) | contains_any(low, ENDPOINT_SIGNALS)
    return shape & ~is_likely_not_api(c) & signal


def endpoint_shape(c: Column, rules: Rules = CLI_RULES) -> Column:
    return looks_like_endpoint(F.regexp_replace(c, r"\{[^}]*\}", ""), rules)


def is_url_argument(c: Column) -> Column:
    t = trimmed(c)
    return starts_with_any(t, PATH_STARTS) | (t.startswith("{") & t.contains("/"))


def is_skipped_in_report(href: Column, cat: Column) -> Column:
    low = F.lower(href)
    dull = (cat == "web-asset") & ~contains_any(low, NAVIGATION_PARTS)
    return dull | ((cat != "web-page") & ends_with_any(low, SKIPPED_SUFFIXES))


def api_path_key(href: Column) -> Column:
    """What API links are grouped by in a report."""
    parts = F.split(href, "/", -1)
    nested = (F.size(parts) > 2) & F.coalesce(F.get(parts, F.lit(2)).contains("api"), F.lit(False))
    base = F.regexp_extract(F.regexp_replace(href, "/+$", ""), "([^/]*)$", 1)
    last = F.when(href == "", ".").when(base == "", "/").otherwise(base)
    return F.when(
        nested, F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "/"))
    ).otherwise(F.concat(F.lit("/"), last))


def node_id(c: Column) -> Column:
    return F.concat(F.lit("n"), F.regexp_replace(F.replace(c, F.lit("://"), F.lit("_")), r"[/.\-:?&=%#']", "_"))


def short_label(c: Column) -> Column:
    u = F.regexp_replace(F.regexp_replace(c, "^https://", ""), "^http://", "")
    return F.when(F.octet_length(u) <= 35, u).otherwise(F.concat(F.left(u, F.lit(32)), F.lit("...")))


def emulation_error(c: Column) -> Column:
    """An error without its source and place, for counting."""
    e = F.substring_index(F.substring_index(c, " at ", 1), "\n", 1)
    kind = F.regexp_extract(e, r"((?:TypeError|ReferenceError|SyntaxError|RangeError|aborted|skipped|panic)[\s\S]*)$", 1)
    return trimmed(F.when(kind != "", kind).otherwise(e))


def srcset(c: Column) -> Column:
    """The URLs of a srcset."""
    return F.filter(F.transform(F.split(c, ",", -1), lambda p: F.substring_index(F.regexp_replace(trimmed(p), r"\s+", " "), " ", 1)), lambda u: u != "")


def css_urls(c: Column) -> Column:
    """The arguments of url() in a style sheet."""
    found = F.regexp_extract_all(c, F.lit(r"""url\(\s*('[^']*'|"[^"]*"|[^)"']*)"""), F.lit(1))
    return F.transform(found, lambda u: F.when(u.rlike("^['\"]"), F.regexp_replace(u, "^['\"]|['\"]$", "")).otherwise(trimmed(u)))


def query_pairs(c: Column) -> Column:
    """A query as an ordered array of struct<name, value>."""
    parts = F.filter(F.split(F.regexp_replace(c, r"^\?", ""), "&", -1), lambda p: p != "")
    from siteatlas.functions.url import form_decoded

    return F.transform(
        parts,
        lambda p: F.struct(
            form_decoded(F.substring_index(p, "=", 1)).alias("name"),
            form_decoded(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("value"),
        ),
    )


def http_method(explicit: Column, verb: Column, payload: Column, continuation: Column) -> Column:
    """(method, source) of a call: named, by the callee's verb, by its shape, or the default."""
    named = F.upper(trimmed(explicit))
    by_verb = F.lit(None).cast("string")
    for m, verbs in VERBS.items():
        by_verb = F.when(F.lower(verb).isin(verbs.split()), m).otherwise(by_verb)
    shape = payload & continuation
    return F.struct(
        F.when(named != "", named).otherwise(F.coalesce(by_verb, F.when(shape, "POST").otherwise("GET"))).alias("method"),
        F.when(named != "", "init").when(by_verb.isNotNull(), "verb").when(shape, "shape").otherwise("default").alias("source"),
    )


# The verb that a callee's name stands for.
VERBS = {
    "GET": "get download list load search query fetch read find count",
    "POST": "post create add save send submit upload set insert",
    "PUT": "put update replace",
    "PATCH": "patch",
    "DELETE": "delete del remove destroy",
    "HEAD": "head",
    "OPTIONS": "options",
}
