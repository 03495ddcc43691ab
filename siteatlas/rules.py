"""Classification rules as plain values; every operator takes them as an argument."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

# Category, link type and class labels in the order of their codes.
CATEGORIES = ["unknown", "web-asset", "web-page", "API", "DYNAMIC"]
LINK_TYPES = ["unknown", "absolute", "relative", "web"]
CLASSES = ["normal", "WAF", "CDN", "cache", "noise"]

# The lists that both default rule sets share.
ASSET_PATTERNS = [
    "google-fonts", "fonts.googleapis", "fonts.gstatic", "cdnjs.cloudflare", "unpkg.com", "jsdelivr.net",
    "static.", "assets.", "/assets/", "/static/", ".min.", ".bundle.",
]
ASSET_EXTENSIONS = (
    ".css .scss .sass .less .js .mjs .ts .png .jpg .jpeg .gif .svg .ico .webp .avif .woff .woff2 .ttf .otf .eot "
    ".mp4 .webm .ogg .mp3 .wav .flac .pdf .doc .docx .zip .rar .json .xml"
).split()
WAF_PATTERNS = ["/cdn-cgi/", "cloudflare", "__cdn", "waf", "bot-detect", "recaptcha", "challenge"]
CDN_DOMAINS = [
    "cdnjs.cloudflare.com", "unpkg.com", "jsdelivr.net", "cdn.jsdelivr.net", "cdnjs.com", "stackpathcdn.com",
    "bootstrapcdn.com", "cdn.rawgit.com", "cdn.statically.io", "cdn.ampproject.org", "cdn.jsdelivr.",
]
CACHE_PATTERNS = ["?v=", "&v=", "?ver=", "&ver=", "?version=", "&version=", "cache-buster", "cachebuster"]


@dataclass(frozen=True)
class Rules:
    """Substring and suffix lists, and custom tags in order of priority."""

    api: list[str]
    asset: list[str] = field(default_factory=lambda: list(ASSET_PATTERNS))
    extensions: list[str] = field(default_factory=lambda: list(ASSET_EXTENSIONS))
    waf: list[str] = field(default_factory=lambda: list(WAF_PATTERNS))
    cdn: list[str] = field(default_factory=lambda: list(CDN_DOMAINS))
    cache: list[str] = field(default_factory=lambda: list(CACHE_PATTERNS))
    tags: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Preset:
    """Additions of a known platform to a base set."""

    api: list[str] = field(default_factory=list)
    asset: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    waf: list[str] = field(default_factory=list)
    cdn: list[str] = field(default_factory=list)
    cache: list[str] = field(default_factory=list)
    tags: dict[str, list[str]] = field(default_factory=dict)


# API substrings of the library's own default.
LIBRARY_RULES = Rules(
    api=[
        "/api/", "/v1/", "/v2/", "/v3/", "/graphql", "/rest/", "/rpc/", "/ajax", "/xhr/", "/fetch/", "_api",
        "api.php", "ajax.php", "endpoint.php", "rpc.php", "rest.php", "service.php", "handler.php", "gateway.php",
        "soap.php", "action.php", "route.php", "wp-json", "/bitrix/services/", "/services/main/ajax",
        "/wp-admin/admin-ajax", "/rest-api", "/restapi", "/endpoint", "/webhook", "/socket.io", "/sse/",
    ]
)

# API substrings and tags of a scan started from the command line.
CLI_RULES = Rules(
    api=[
        "/api/", "/v1/", "/v2/", "/v3/", "/graphql", "/rest/", "/rpc/", "/ajax", "/xhr/", "/fetch/", "_api", "api.js",
        "api.php", "ajax.php", "endpoint.php", "rpc.php", "rest.php", "service.php", "handler.php", "gateway.php",
        "soap.php", "/bitrix/services/", "/services/main/ajax",
    ],
    tags={
        "auth": ["/login", "/auth/", "/signin", "/signup", "/register", "/forgot", "/reset"],
        "admin": ["/admin/", "/dashboard", "/manage", "/control", "/moder", "/panel", "/cp/"],
        "api": ["/api/", "/rest/", "/graphql", "/ajax", "/rpc/", "/v1/", "/v2/"],
        "cdn": ["cdn.", "cloudfront", "fastly"],
        "static": ["/assets/", "/static/", "/uploads/", "/files/", ".min.", ".bundle."],
    },
)

# Platform presets.
PRESETS = {
    "bitrix": Preset(
        api=["/bitrix/services/", "/bitrix/tools/", "/bitrix/components/bitrix/", "ajax.php", "rest.php", "/rest/", "/oauth/"],
        cache=["?bitrix_include_areas=", "?bxrand=", "?sessid="],
        tags={
            "bitrix-api": ["/bitrix/services/", "/bitrix/tools/", "/rest/"],
            "bitrix-auth": ["/auth/", "/bitrix/services/main/ajax.php?action=auth", "/oauth/"],
        },
    ),
    "wp": Preset(
        api=["/wp-json/", "/wp-admin/admin-ajax.php", "/xmlrpc.php", "/wp-cron.php", "/rest_route/"],
        asset=["/wp-content/", "/wp-includes/", "/wp-json/"],
        waf=["wordfence", "wpscan", "wp-login"],
        cache=["?wp_cache=", "?w3tc_", "?page_id="],
        tags={
            "wp-api": ["/wp-json/", "/xmlrpc.php", "/wp-admin/admin-ajax.php"],
            "wp-auth": ["/wp-login", "/wp-admin/"],
            "wp-admin": ["/wp-admin/"],
        },
    ),
}

LISTS = ("api", "asset", "extensions", "waf", "cdn", "cache")
#: Names of the lists in a rule file.
FILE_KEYS = {
    "api_patterns": "api",
    "asset_patterns": "asset",
    "asset_extensions": "extensions",
    "waf_patterns": "waf",
    "cdn_domains": "cdn",
    "cache_patterns": "cache",
    "tags": "tags",
}


def merge_rules(base: Rules, *more: Preset) -> Rules:
    """``base`` with the lists of each preset appended; a tag keeps the place where it first came."""
    for p in more:
        tags = {k: list(v) for k, v in base.tags.items()}
        for k, v in p.tags.items():
            tags[k] = [*tags.get(k, []), *v]
        base = replace(base, tags=tags, **{n: [*getattr(base, n), *getattr(p, n)] for n in LISTS})
    return base


def load_rules(path: str) -> Preset:
    """A preset from a JSON file; unknown keys are ignored, wrong types are an error."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if not isinstance(raw, dict):
        raise ValueError(f"{path}: a rule file is an object")
    found = {FILE_KEYS[k]: v for k, v in raw.items() if k in FILE_KEYS}
    for k, v in found.items():
        if k == "tags" and not isinstance(v, dict) or k != "tags" and not isinstance(v, list):
            raise ValueError(f"{path}: {k} has the wrong type")
    return Preset(**found)


def overriding(base: Rules, **lists: list[str]) -> Rules:
    """``base`` with each list that is given and not empty in place of its own."""
    return replace(base, **{k: list(v) for k, v in lists.items() if v})
