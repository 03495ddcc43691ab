"""DuckDB SQL for the registered queries that SQL can express; rule lists come from the same values."""

from __future__ import annotations

from siteatlas.functions.classify import (
    ASSET_SUFFIXES,
    ENDPOINT_SIGNALS,
    NAVIGATION_PARTS,
    NOT_ENDPOINT_PARTS,
    NOT_ENDPOINT_SUFFIXES,
    PHP_HANDLERS,
    SKIPPED_SUFFIXES,
)
from siteatlas.functions.documents import CODE_HINTS, EXTENSIONS
from siteatlas.functions.url import CACHE_BUSTERS, SCRIPT_SUFFIXES
from siteatlas.rules import CATEGORIES, CLASSES, CLI_RULES, LINK_TYPES


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(c: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {text(p)})" for p in parts) + ")"


def ends(c: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({c}, {text(p)})" for p in parts) + ")"


HREF = r"""'(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>'"""
NOISE = "(contains(href, ';') OR contains(href, '${') OR contains(href, '=>') OR contains(trim(href), ' '))"
LOOKS = "(contains(href, '/') OR contains(href, '.'))"
PHP = f"(ends_with(lower(href), '.php') AND (contains(href, '?') OR {has('lower(href)', PHP_HANDLERS)}))"
CATEGORY = f"""CASE WHEN {ends("split_part(lower(href), '?', 1)", CLI_RULES.extensions)} THEN 'web-asset'
  WHEN {has('lower(href)', CLI_RULES.api)} OR {PHP} THEN 'API'
  WHEN {has('lower(href)', CLI_RULES.asset)} THEN 'web-asset' ELSE 'web-page' END"""
CLASS = f"""CASE WHEN {has('lower(href)', CLI_RULES.waf)} THEN 'WAF' WHEN {has('lower(href)', CLI_RULES.cdn)} THEN 'CDN'
  WHEN {has('lower(href)', CLI_RULES.cache)} THEN 'cache' WHEN NOT {LOOKS} OR {NOISE} THEN 'noise' ELSE 'normal' END"""
TYPE = """CASE WHEN starts_with(href, '//') THEN 'web' WHEN starts_with(href, 'http://') OR starts_with(href, 'https://')
  THEN 'absolute' ELSE 'relative' END"""
PARAMS = "(strpos(href, '?') > 1 AND strpos(href, '?') < length(href))"
MATCHES = f"""m AS (SELECT url AS source_url, unnest(regexp_extract_all(html, {HREF}, 1)) AS raw FROM pages),
l AS (SELECT DISTINCT source_url, 'a' AS tag, trim(raw) AS href FROM m
  WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '#') AND NOT starts_with(trim(raw), 'javascript:')
  AND NOT starts_with(trim(raw), 'mailto:') AND NOT starts_with(trim(raw), 'tel:') AND regexp_matches(raw, '[A-Za-z0-9]'))"""
DESCRIBED = f"""{MATCHES},
links AS (SELECT *, {TYPE} AS link_type, {CATEGORY} AS category, {CLASS} AS class, {PARAMS} AS has_params FROM l)"""
ROOT = "regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*', 0)"
HOST = "regexp_extract({0}, '^[a-zA-Z]+://([^/?#]*)', 1)"
ENCODED = "replace(replace(url_encode(href), '%2F', '/'), '%2C', ',')"
RESOLVED = f"""{DESCRIBED},
r AS (SELECT *, {ROOT.format('source_url')} || {ENCODED} AS resolved, {HOST.format('source_url')} AS domain FROM links)"""
# The pages' own URLs as links.
URLS = f"""u0 AS (SELECT url AS href, page_id AS seq FROM pages),
u AS (SELECT href, seq, href AS resolved, {HOST.format('href')} AS domain, {TYPE} AS link_type, {CATEGORY} AS category,
  {CLASS} AS class, {PARAMS} AS has_params FROM u0)"""
BASE = "CASE WHEN strpos({0}, '?') > 0 AND strpos({0}, '?') < length({0}) THEN split_part({0}, '?', 1) ELSE {0} END"
QUERY = "CASE WHEN strpos({0}, '?') > 0 AND strpos({0}, '?') < length({0}) THEN substr({0}, strpos({0}, '?')) ELSE '' END"
CANONICAL = f"""c AS (SELECT DISTINCT {ROOT.format('url')} || regexp_replace(regexp_extract(substr(url, length({ROOT.format('url')}) + 1),
  '^[^?#]*', 0), '/+$', '') AS canonical FROM pages),
cu AS (SELECT canonical, {HOST.format('canonical')} AS host,
  string_split(substr(canonical, length({ROOT.format('canonical')}) + 2), '/') AS segs
  FROM c WHERE length(canonical) > length({ROOT.format('canonical')}))"""


def kind(s: str) -> str:
    return f"""CASE WHEN {s} = '' OR contains({s}, '{{') OR contains({s}, '}}') THEN ''
  WHEN regexp_matches({s}, '^[0-9]+$') THEN 'int'
  WHEN regexp_matches({s}, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$') THEN 'uuid'
  WHEN length({s}) >= 8 AND regexp_matches({s}, '^[0-9A-Za-z+/_-]+={{0,2}}$') AND (ends_with({s}, '=') OR contains({s}, '+')) THEN 'base64'
  WHEN regexp_matches({s}, '^[0-9A-Za-z_-]{{16,}}$') THEN 'hash' ELSE 'string' END"""


BUCKET = f"CASE WHEN ({kind('segs[1]')}) IN ('int', 'uuid', 'base64', 'hash') THEN '' ELSE segs[1] END"
# All paths of the supplied pages have two segments.
SHAPES = f"""{CANONICAL},
b AS (SELECT *, {BUCKET} AS bucket, len(segs) AS n FROM cu),
p AS (SELECT a.host, a.canonical AS c1, d.canonical AS c2, a.segs AS s1,
  CASE WHEN a.segs[1] = d.segs[1] THEN a.segs[1] ELSE '' END AS m1,
  CASE WHEN a.segs[2] = d.segs[2] THEN a.segs[2] ELSE '' END AS m2
  FROM b a JOIN b d ON a.host = d.host AND a.n = d.n AND a.bucket = d.bucket AND a.canonical <> d.canonical
  AND (a.segs[1] <> d.segs[1] OR a.segs[2] <> d.segs[2]) WHERE a.n = 2),
mem AS (SELECT DISTINCT host, m1, m2, c1 AS canonical, s1[1] AS v1, s1[2] AS v2 FROM p WHERE m1 <> '' OR m2 <> ''),
g AS (SELECT host, m1, m2, count(*) AS n,
  count(DISTINCT CASE WHEN m1 = '' THEN {kind('v1')} ELSE {kind('v2')} END) AS kinds,
  min(CASE WHEN m1 = '' THEN {kind('v1')} ELSE {kind('v2')} END) AS k, min(canonical) AS lead,
  string_agg(canonical, '|' ORDER BY canonical) AS members
  FROM mem GROUP BY host, m1, m2),
pat0 AS (SELECT *, CASE WHEN kinds = 1 AND k <> '' THEN k ELSE 'string' END AS kind FROM g WHERE n >= 2),
pat AS (SELECT host AS domain, m1, m2, kind, n, members, regexp_extract(lead, '^[a-zA-Z]+', 0) || '://' || host || '/' ||
  CASE WHEN m1 = '' THEN '{{id: ' || kind || '}}' ELSE m1 END || '/' ||
  CASE WHEN m2 = '' THEN '{{id: ' || kind || '}}' ELSE m2 END AS pattern FROM pat0)"""
PATTERN_ROWS = "SELECT domain, pattern, CAST(n AS INTEGER) AS count, m1 || '|' || m2 AS mask, members FROM pat"
FOLDED = f"""{URLS},
q AS (SELECT *, {BASE.format('href')} AS base, {QUERY.format('href')} AS query FROM u),
f AS (SELECT base, class, bool_or(query = '') AS bare,
  arg_min(href, (query <> '')::INT || href) AS lead, bool_or(has_params) AS any_params,
  min(domain) AS domain, min(category) AS category, min(link_type) AS link_type,
  coalesce(string_agg(DISTINCT CASE WHEN query <> '' THEN query END, '|' ORDER BY CASE WHEN query <> '' THEN query END), '') AS variants
  FROM q GROUP BY base, class)"""
PATH = "regexp_extract(substr({0}, length(" + ROOT + ") + 1), '^[^?#]*', 0)"
GET_PATH = f"""o AS (SELECT page_id AS seq, url, regexp_replace({ROOT.format('url')} || {PATH.format('url')}, '/+$', '') AS path,
  regexp_extract(url, '^[^?]*\\?([^#]*)', 1) AS query FROM pages WHERE {PATH.format('url')} <> '')"""

ORACLES: dict[str, str] = {
    "extract_links": f"WITH {DESCRIBED} SELECT * FROM links",
    "match_counts": f"WITH {MATCHES} SELECT 'a' AS tag, count(*) AS n, count(DISTINCT raw) AS n_distinct FROM m",
    "resolve_links": f"WITH {RESOLVED} SELECT source_url, href, resolved, domain FROM r",
    "link_stats": f"""WITH {RESOLVED},
      counted AS (
        SELECT 'category' AS dimension, category AS key FROM r UNION ALL SELECT 'link_type', link_type FROM r
        UNION ALL SELECT 'class', class FROM r UNION ALL SELECT 'tag', tag FROM r
        UNION ALL SELECT 'links', 'total' FROM r UNION ALL SELECT 'links', 'resolved' FROM r WHERE resolved <> ''
        UNION ALL SELECT 'links', 'unresolved' FROM r WHERE href <> '' UNION ALL SELECT 'links', 'with_params' FROM r WHERE has_params),
      domain AS (SELECT * FROM (VALUES {", ".join(f"('{d}', '{k}')" for d, ks in (("category", CATEGORIES[1:]), ("link_type", LINK_TYPES[1:]), ("class", CLASSES), ("links", ["total", "resolved", "unresolved", "with_params"])) for k in ks)}) t(dimension, key)),
      n AS (SELECT dimension, key, count(*) AS n FROM counted GROUP BY dimension, key)
      SELECT coalesce(n.dimension, d.dimension) AS dimension, coalesce(n.key, d.key) AS key, coalesce(n.n, 0) AS n
      FROM n FULL JOIN domain d ON n.dimension = d.dimension AND n.key = d.key""",
    "host_counts": f"WITH {RESOLVED} SELECT domain AS host, count(*) AS n FROM r GROUP BY domain",
    "hidden_classes": f"WITH {URLS} SELECT class, count(*) AS n FROM u GROUP BY class",
    "visible_in_scope": f"""WITH {URLS} SELECT href, domain, class FROM u WHERE class = 'normal' AND (domain = 'example.com'
      OR ends_with(domain, '.example.com') OR domain = 'site1.example.org' OR ends_with(domain, '.site1.example.org'))""",
    "display_rows": f"""WITH {RESOLVED}, d AS (SELECT DISTINCT href, domain, category, class FROM r)
      SELECT * FROM d ORDER BY list_position({CLASSES}, class), list_position({CATEGORIES}, category), domain, href""",
    "fold_params": f"""WITH {FOLDED} SELECT CASE WHEN bare THEN lead ELSE {BASE.format('lead')} END AS href,
      CASE WHEN bare THEN lead ELSE base END AS resolved, 'https://index.example/' AS source_url, 'a' AS tag, domain, category,
      link_type, class, bare AND {PARAMS.replace('href', 'lead')} AS has_params, variants AS param_variants FROM f""",
    "observed_names": f"""WITH {FOLDED} SELECT DISTINCT split_part(p, '=', 1) AS name FROM (
      SELECT unnest(string_split(substr(query, 2), '&')) AS p FROM q WHERE query <> '') WHERE strpos(p, '=') > 1""",
    "valuable_links": f"""WITH {DESCRIBED} SELECT source_url, href, category FROM links WHERE NOT (
      (category = 'web-asset' AND NOT {has('lower(href)', NAVIGATION_PARTS)})
      OR (category <> 'web-page' AND {ends('lower(href)', SKIPPED_SUFFIXES)}))""",
    "canonical_urls": f"""WITH {CANONICAL} SELECT canonical, host, array_to_string(segs, '|') AS segs, CAST(len(segs) AS INTEGER) AS n,
      {BUCKET} AS bucket FROM cu""",
    "segment_kinds": f"WITH {CANONICAL}, s AS (SELECT DISTINCT unnest(segs) AS seg FROM cu) SELECT seg, {kind('seg')} AS kind FROM s",
    "find_patterns": f"WITH {SHAPES} {PATTERN_ROWS} WHERE kind <> 'string'",
    "find_string_patterns": f"WITH {SHAPES} {PATTERN_ROWS}",
    "without_pattern_members": f"""WITH {SHAPES}, {URLS},
      gone AS (SELECT DISTINCT unnest(string_split(members, '|')) AS canonical FROM pat WHERE kind <> 'string')
      SELECT href, category FROM u WHERE {ROOT.format('href')} || regexp_replace({PATH.format('href')}, '/+$', '')
      NOT IN (SELECT canonical FROM gone)""",
    "best_patterns": f"""WITH {SHAPES}, uu AS (SELECT DISTINCT url FROM pages),
      x AS (SELECT url, {ROOT.format('url')} || regexp_replace({PATH.format('url')}, '/+$', '') AS canonical FROM uu),
      y AS (SELECT x.url, b.host, b.segs, b.n FROM x JOIN b ON x.canonical = b.canonical),
      z AS (SELECT y.url, pat.pattern, CASE WHEN pat.m2 <> '' THEN 1 ELSE 0 END AS lits, pat.n AS members FROM y JOIN pat
        ON y.host = pat.domain AND y.n = 2 AND (pat.m1 = '' OR pat.m1 = y.segs[1]) AND (pat.m2 = '' OR pat.m2 = y.segs[2]))
      SELECT url, pattern FROM z QUALIFY row_number() OVER (PARTITION BY url ORDER BY lits DESC, members DESC, pattern) = 1""",
    "contract_endpoints": f"""WITH {GET_PATH} SELECT path, 'GET' AS methods, count(*) AS calls, false AS unobserved,
      false AS method_inferred, (SELECT string_agg(line, '|' ORDER BY s) FROM (SELECT 'GET ' || {PATH.format('i.url')} ||
        CASE WHEN i.query <> '' THEN '?' || i.query ELSE '' END AS line, min(i.seq) AS s FROM o i WHERE i.path = o.path GROUP BY 1)) AS raw
      FROM o GROUP BY path""",
    "contract_fields": f"""WITH {GET_PATH}, v AS (SELECT path, seq, unnest(string_split(query, '&')) AS p FROM o WHERE query <> ''),
      w AS (SELECT path, split_part(p, '=', 1) AS name, substr(p, strpos(p, '=') + 1) AS value, min(seq) AS s FROM v GROUP BY 1, 2, 3),
      x AS (SELECT path, name, count(*) AS n, string_agg(value, '|' ORDER BY s) AS vals, min(value) AS one,
        bool_and(regexp_matches(value, '^[0-9]+$')) AS ints, bool_and(value IN ('0', '1')) AS bools FROM w GROUP BY path, name)
      SELECT path, 'query' AS section, name, CASE WHEN bools THEN 'bool' WHEN ints THEN 'uint' WHEN n = 1 THEN 'str' WHEN n <= 8 THEN 'enum' ELSE 'str' END AS kind,
      vals AS values, n = 1 AS constant, CASE WHEN n = 1 THEN one ELSE '' END AS const_val, false AS inferred FROM x""",
    "contract_kinds": f"""WITH {GET_PATH}, v AS (SELECT path, unnest(string_split(query, '&')) AS p FROM o WHERE query <> ''),
      w AS (SELECT DISTINCT path, split_part(p, '=', 1) AS name, substr(p, strpos(p, '=') + 1) AS value FROM v),
      x AS (SELECT path, name, count(*) AS n, min(value) AS one, bool_and(regexp_matches(value, '^[0-9]+$')) AS ints,
        bool_and(value IN ('0', '1')) AS bools FROM w GROUP BY path, name)
      SELECT path, name, CASE WHEN bools THEN 'bool' WHEN ints THEN 'uint' WHEN n = 1 THEN 'str' WHEN n <= 8 THEN 'enum' ELSE 'str' END AS kind,
      n AS n_values, CASE WHEN n = 1 THEN one ELSE '' END AS const_val, false AS inferred FROM x""",
    "source_edges": f"WITH {RESOLVED} SELECT DISTINCT source_url AS from_key, resolved AS to_key FROM r",
    "page_parents": f"""WITH {RESOLVED} SELECT resolved AS to_key, count(DISTINCT source_url) AS n, min(source_url) AS first_parent
      FROM r GROUP BY resolved""",
    "first_sources": f"WITH {RESOLVED} SELECT resolved AS to_key, min(source_url) AS source_url FROM r GROUP BY resolved",
    "find_pages": f"WITH {URLS} SELECT DISTINCT href AS key FROM u WHERE category = 'web-page' AND regexp_matches({PATH.format('href')}, '(^|/)en/[^/]*$')",
    "visual_edges": f"""WITH {RESOLVED}, e AS (SELECT DISTINCT {BASE.format('source_url')} AS a, resolved AS b FROM r)
      SELECT 'n' || regexp_replace(replace(a, '://', '_'), '[/.:?&=%#''-]', '_', 'g') AS from_id,
        'n' || regexp_replace(replace(b, '://', '_'), '[/.:?&=%#''-]', '_', 'g') AS to_id FROM e WHERE a <> b""",
    "union_first_wins": """WITH a AS (SELECT url AS href, url AS resolved, page_id AS n FROM pages WHERE page_id % 3 <> 0),
      b AS (SELECT url AS href, url AS resolved, -page_id AS n FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0)
      SELECT * FROM a UNION ALL SELECT * FROM b WHERE href NOT IN (SELECT href FROM a)""",
    "page_log": """SELECT 'https://x.example/' || CAST(user_id AS VARCHAR) AS url, CAST(min(event_id % 5) AS INTEGER) AS depth,
      coalesce(arg_min(event_type, event_id) FILTER (event_id % 3 = 0), '') AS content_type, CAST(max(event_id % 17) AS INTEGER) AS links
      FROM events GROUP BY user_id""",
    "document_kinds": f"""SELECT doc_id, 'text' AS kinds,
      ({" + ".join(f"contains(substr(text, 1, 8192), {text(h)})::INT" for h in CODE_HINTS)}) >= 2 AS code, false AS markup FROM documents""",
    "place_keys": f"""SELECT url, CASE WHEN {PATH.format('url')} = '' THEN '/' ELSE {PATH.format('url')} END AS path_only,
      CASE WHEN regexp_replace({PATH.format('url')}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH.format('url')}, '/+$', '') END AS place,
      CASE WHEN {PATH.format('url')} = '' THEN '/' ELSE {PATH.format('url')} END AS short,
      {HOST.format('url')} || CASE WHEN regexp_replace({PATH.format('url')}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH.format('url')}, '/+$', '') END AS host_path
      FROM pages""",
    "masked_queries": r"SELECT page_id, regexp_extract(url, '^[^?]*\?([^#]*)', 1) || '&token=<token>' AS q FROM pages",
}

TAGS = "CASE " + " ".join(f"WHEN {has('lower(href)', v)} THEN '{k}'" for k, v in CLI_RULES.tags.items()) + " ELSE '' END"
ASSETS = "CASE " + " ".join(f"WHEN {ends('lower(href)', v.split())} THEN '{k}'" for k, v in ASSET_SUFFIXES.items()) + " ELSE 'asset' END"
ENDPOINT = f"""(strlen(href) BETWEEN 4 AND 512 AND NOT regexp_matches(href, '[ <>(){{}}"`|]') AND NOT contains(href, '''')
  AND (starts_with(href, '/') OR starts_with(href, 'http://') OR starts_with(href, 'https://'))
  AND NOT {has('lower(href)', NOT_ENDPOINT_PARTS)} AND NOT {ends('lower(href)', NOT_ENDPOINT_SUFFIXES)}
  AND ({has('lower(href)', CLI_RULES.api)} OR {has('lower(href)', ENDPOINT_SIGNALS)} OR (contains(lower(href), '.php') AND contains(href, '?'))))"""
BARE = "split_part(split_part(href, '?', 1), '#', 1)"
LAST = "regexp_extract(regexp_replace(href, '/+$', ''), '([^/]*)$', 1)"
DOCUMENT_EXTENSIONS = ", ".join(text(x) for v in EXTENSIONS.values() for x in v.split())
SHOWN = """v AS (SELECT DISTINCT base, class, split_part(p, '=', 1) AS name, substr(p, strpos(p, '=') + 1) AS value
    FROM (SELECT base, class, unnest(string_split(substr(query, 2), '&')) AS p FROM q WHERE query <> '') WHERE strpos(p, '=') > 1),
  a AS (SELECT base, class, name || '=' || string_agg(value, ',' ORDER BY value) AS part FROM v WHERE value <> '' GROUP BY base, class, name),
  t AS (SELECT base, class, string_agg(part, '; ' ORDER BY part) AS params FROM a GROUP BY base, class)"""

ORACLES |= {
    "classify_links": f"""WITH {MATCHES}, h AS (SELECT DISTINCT href FROM l)
      SELECT href, {ASSETS} AS asset, {TAGS} AS custom_tag, {ends(f"lower({BARE})", SCRIPT_SUFFIXES)} AS is_script,
      {NOISE} AS is_noise, {LOOKS} AS looks_like_url, {ENDPOINT} AS endpoint,
      regexp_extract(lower({BARE}), '[.]([^.]+)$', 1) IN ({DOCUMENT_EXTENSIONS}) AS is_document,
      CASE WHEN len(string_split(href, '/')) > 2 AND contains(split_part(href, '/', 3), 'api')
        THEN '/' || array_to_string(list_slice(string_split(href, '/'), 3, len(string_split(href, '/')) - 1), '/')
        ELSE '/' || CASE WHEN {LAST} = '' THEN '/' ELSE {LAST} END END AS api_key
      FROM h""",
    "inline_scripts": """WITH s AS (SELECT url, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS codes FROM pages)
      SELECT url, CAST(generate_subscripts(codes, 1) - 1 AS INTEGER) AS pos, unnest(codes) AS code FROM s""",
    "text_urls": f"""WITH u AS (SELECT DISTINCT url AS href FROM pages)
      SELECT href AS source_url, href, {CATEGORY} AS category, {TYPE} AS link_type FROM u""",
    "text_urls_in_documents": "SELECT CAST(doc_id AS VARCHAR) AS source_url, text AS href, text AS class FROM documents WHERE contains(text, '://')",
    "param_annotations": f"""WITH {FOLDED}, {SHOWN} SELECT CASE WHEN f.bare THEN f.lead ELSE f.base END AS resolved,
      coalesce(t.params, '') AS params FROM f LEFT JOIN t ON f.base = t.base AND f.class = t.class""",
    "describe_patterns": f"""WITH {SHAPES},
      v AS (SELECT DISTINCT host, m1, m2, CAST(CASE WHEN m1 = '' THEN v1 ELSE v2 END AS BIGINT) AS x FROM mem
        WHERE regexp_matches(CASE WHEN m1 = '' THEN v1 ELSE v2 END, '^[0-9]+$')),
      r AS (SELECT host, m1, m2, count(*) AS n, min(x) AS low, max(x) AS high, string_agg(CAST(x AS VARCHAR), ', ' ORDER BY x) AS listed
        FROM v GROUP BY host, m1, m2)
      SELECT pat.domain, pat.pattern, pat.kind AS grouped_by, '(' || pat.kind || ': id)' AS annotation,
      'id(' || pat.kind || '): ' || CASE WHEN r.n >= 2 AND r.high - r.low + 1 = r.n
        THEN CAST(r.low AS VARCHAR) || '..' || CAST(r.high AS VARCHAR) ELSE r.listed END AS slots
      FROM pat JOIN r ON pat.domain = r.host AND pat.m1 = r.m1 AND pat.m2 = r.m2 WHERE pat.kind = 'int'""",
    "pattern_shapes": f"""WITH {SHAPES} SELECT domain, pattern, CAST(n AS INTEGER) AS count, kind AS kinds, m1 || '|' || m2 AS mask
      FROM pat WHERE kind <> 'string'""",
    "pattern_members": f"""WITH {SHAPES} SELECT domain, pattern, unnest(string_split(members, '|')) AS canonical FROM pat
      WHERE kind <> 'string'""",
    "pattern_kinds": f"""WITH {SHAPES} SELECT domain, pattern, 'web-page' AS category, 'absolute' AS link_type, 'normal' AS class,
      'js' AS asset FROM pat WHERE kind <> 'string'""",
    "event_bodies": """SELECT 'https://api.example/v1/' || event_type AS path, 'json' AS body_kind, 'k' AS name,
      CASE WHEN sum(length(k)) >= 24 THEN 'token' WHEN bool_and(k IN ('0', '1')) THEN 'bool' ELSE 'uint' END AS kind,
      CAST(count(*) AS INTEGER) AS n_values
      FROM (SELECT DISTINCT event_type, regexp_extract(props, '"k": ([0-9]+)', 1) AS k FROM events) GROUP BY event_type""",
    "normalize_links": f"""WITH {RESOLVED}, k AS (SELECT DISTINCT resolved AS key FROM r),
      s AS (SELECT source_url AS key FROM r UNION SELECT 'https://index.example/'),
      made AS (SELECT key FROM s WHERE key NOT IN (SELECT key FROM k))
      SELECT false AS synthesized, count(*) AS n, count(*) FILTER (contains(key, '?')) AS with_query FROM k
      UNION ALL SELECT true, count(*), count(*) FILTER (contains(key, '?')) FROM made""",
    "visual_nodes": f"""WITH {FOLDED}, {SHOWN}, n AS (SELECT DISTINCT base FROM q),
      s AS (SELECT base, regexp_replace(base, '^https?://', '') AS short FROM n)
      SELECT 'n' || regexp_replace(replace(s.base, '://', '_'), '[/.:?&=%#''-]', '_', 'g') AS id, s.base AS url,
      CASE WHEN length(short) <= 35 THEN short ELSE substr(short, 1, 32) || '...' END AS label, 'page' AS kind,
      coalesce(t.params, '') AS params FROM s LEFT JOIN t ON s.base = t.base""",
    "pattern_contracts": f"""WITH {SHAPES}, {GET_PATH},
      x AS (SELECT o.seq, o.path, b.host, b.segs, b.n FROM o LEFT JOIN b ON o.path = b.canonical),
      z AS (SELECT x.seq, pat.pattern, CASE WHEN pat.m2 <> '' THEN 1 ELSE 0 END AS lits, pat.n AS members FROM x JOIN pat
        ON x.host = pat.domain AND x.n = 2 AND (pat.m1 = '' OR pat.m1 = x.segs[1]) AND (pat.m2 = '' OR pat.m2 = x.segs[2])
        WHERE pat.kind <> 'string'),
      best AS (SELECT seq, pattern FROM z QUALIFY row_number() OVER (PARTITION BY seq ORDER BY lits DESC, members DESC, pattern) = 1)
      SELECT coalesce(best.pattern, x.path) AS path, count(*) AS calls FROM x LEFT JOIN best ON x.seq = best.seq GROUP BY 1""",
    "edge_counts": f"""WITH {RESOLVED}, {SHAPES}, {GET_PATH},
      nodes AS (SELECT resolved AS key FROM r UNION SELECT source_url FROM r),
      e AS (SELECT DISTINCT 'source' AS kind, source_url AS a, resolved AS z FROM r
        UNION ALL SELECT DISTINCT 'crawled', source_url, resolved FROM r WHERE resolved IN (SELECT url FROM pages)
        UNION ALL SELECT 'pattern', pattern, key FROM (SELECT pattern, unnest(string_split(members, '|')) AS key FROM pat
          WHERE kind <> 'string') WHERE key IN (SELECT key FROM nodes)
        UNION ALL SELECT DISTINCT 'contract', path, path FROM o WHERE path IN (SELECT key FROM nodes))
      SELECT kind, count(*) AS n FROM e GROUP BY kind""",
    "strip_cache_busters": f"""WITH p AS (SELECT split_part(url, '#', 1) AS b,
        CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#')) ELSE '' END AS f FROM pages),
      u AS (SELECT b || CASE WHEN contains(b, '?') THEN '&t=1&q=x' ELSE '?q=x&ts=9' END AS b, f FROM p)
      SELECT b || f AS url, split_part(b, '?', 1) || '?' || array_to_string(list_sort([x FOR x IN string_split(split_part(b, '?', 2), '&')
        IF split_part(x, '=', 1) NOT IN ({", ".join(map(text, CACHE_BUSTERS))})]), '&') || f AS stripped FROM u""",
    "reference_positions": r"""WITH m AS (SELECT url, html,
        regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>') AS found,
        regexp_extract(html, '(?is)^.*?<a[^>]+href=["'']', 0) AS before, regexp_extract(html, '(?is)^.*<a[^>]+href=["'']', 0) AS until FROM pages)
      SELECT url AS source_url, CAST(len(found) AS BIGINT) AS n, CAST(strlen(before) AS BIGINT) AS first_offset,
        CAST(len(string_split(until, chr(10))) AS BIGINT) AS last_line FROM m WHERE len(found) > 0""",
    "crawl": f"""WITH RECURSIVE {RESOLVED},
      home AS (SELECT min(url) AS url, {HOST.format('min(url)')} AS host FROM pages),
      w AS (SELECT url, 0 AS depth FROM home
        UNION SELECT split_part(r.resolved, '#', 1), w.depth + 1 FROM w JOIN r ON r.source_url = w.url CROSS JOIN home
        WHERE w.depth < 5 AND r.category IN ('web-page', 'API') AND r.class = 'normal'
          AND (r.domain = home.host OR ends_with(r.domain, '.' || home.host))),
      v AS (SELECT url, min(depth) AS depth FROM w GROUP BY url)
      SELECT href, resolved, source_url, v.depth + 1 AS depth, category FROM v JOIN r ON r.source_url = v.url
      QUALIFY row_number() OVER (PARTITION BY href ORDER BY v.depth, source_url) = 1""",
}
