"""Registered queries over the structure of pages and captures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.functions import url
from siteatlas.operators import contracts, dom, extract, graph, scope, tree
from siteatlas.plans import oracles
from siteatlas.plans.oracles import RESOLVED, URLS
from siteatlas.plans.queries import bodies, links, page_observations, query, table, url_links, url_patterns
from siteatlas.plans.session import Report
from siteatlas.rules import CATEGORIES
from siteatlas.sources import site_files
from siteatlas.sources.snapshot import Snapshot

ORACLES: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


#: Pages without comments and without the text of scripts, styles and titles.
PLAIN_MARKUP = r"""p AS (SELECT url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)(<(script|style|title)\b[^>]*>).*?</(script|style|title)\s*>', '\1', 'g') AS h FROM pages)"""


@query
def dom_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each tag every document has."""
    return dom.dom_nodes(bodies(spark, sf_dir)).groupBy("source_url", "tag").agg(F.count("*").alias("n"))


sql("dom_elements", rf"""
WITH {PLAIN_MARKUP}, t AS (SELECT url, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][^\s/>]*)', 1))) AS tag FROM p)
SELECT url AS source_url, tag, count(*) AS n FROM t GROUP BY ALL
""")  # fmt: skip


@query
def dom_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by an attribute selector."""
    found = dom.select(dom.dom_nodes(bodies(spark, sf_dir)), 'a[href^="/"]')
    return found.select("source_url", F.col("attrs")["href"].alias("href"))


sql("dom_links", rf"""
WITH {PLAIN_MARKUP} SELECT url AS source_url, unnest(regexp_extract_all(h, '<a href="(/[^"]*)"', 1)) AS href FROM p
""")  # fmt: skip


@query
def dom_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by their ancestors, for two selectors at once."""
    found = dom.select(dom.dom_nodes(bodies(spark, sf_dir)), "nav li a, article b")
    return found.groupBy("source_url", "tag").agg(F.count("*").alias("n"))


sql("dom_descendants", rf"""
WITH {PLAIN_MARKUP},
a AS (SELECT url, 'a' AS tag, unnest(regexp_extract_all(regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1), '<a ')) FROM p),
b AS (SELECT url, 'b' AS tag, unnest(regexp_extract_all(regexp_extract(h, '(?s)<article>(.*?)</article>', 1), '<b>')) FROM p)
SELECT url AS source_url, tag, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL
""")  # fmt: skip


@query
def dom_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by their parents: direct children of the page's body and of lists."""
    found = dom.select(dom.dom_nodes(bodies(spark, sf_dir)), "html > body > *, ul > li")
    return found.groupBy("source_url", "tag", "level").agg(F.count("*").alias("n"))


sql("dom_children", rf"""
WITH {PLAIN_MARKUP}, t AS (
  SELECT url, unnest(regexp_extract_all(h, '<(nav|div|article|footer)[ >]', 1)) AS tag, 2 AS level FROM p
  UNION ALL SELECT url, unnest(regexp_extract_all(h, '<(li)>', 1)), 4 FROM p)
SELECT url AS source_url, tag, CAST(level AS INTEGER) AS level, count(*) AS n FROM t GROUP BY ALL
""")  # fmt: skip


@query
def dom_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many forms, images, links and scripts every document has."""
    return dom.collections(dom.dom_nodes(bodies(spark, sf_dir)))


sql("dom_collections", rf"""
WITH {PLAIN_MARKUP}, t AS (SELECT url, lower(unnest(regexp_extract_all(h, '<(form|img|a|script)[ >]', 1))) AS tag FROM p)
SELECT url AS source_url, CASE tag WHEN 'form' THEN 'forms' WHEN 'img' THEN 'images' WHEN 'a' THEN 'links' ELSE 'scripts' END AS name,
  count(*) AS n FROM t GROUP BY ALL
""")  # fmt: skip


#: Where pages stand: host and path, without scheme, port, query and fragment.
PLACE = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')"


def place_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of a capture as a forest: hosts, and below them the places of pages and all that lead to them."""
    places = table(spark, sf_dir, "pages").select(F.split(F.expr(PLACE), "/").alias("s")).distinct()
    steps = places.select("s", F.explode(F.sequence(F.lit(2), F.greatest(F.size("s"), F.lit(2)))).alias("n")).where(F.col("n") <= F.size("s"))
    head = lambda n: F.array_join(F.slice("s", F.lit(1), n), "/")
    edges = steps.select(head(F.col("n") - 1).alias("from_key"), head(F.col("n")).alias("to_key")).distinct()
    return tree.forest(edges, places.select(F.get("s", F.lit(0)).alias("key")).distinct())


PLACES = f"""p AS (SELECT DISTINCT string_split({PLACE}, '/') AS s FROM pages),
n AS (SELECT DISTINCT array_to_string(list_slice(s, 1, k), '/') AS key, k - 1 AS depth, CASE WHEN k > 1 THEN array_to_string(list_slice(s, 1, k - 1), '/') END AS parent
  FROM (SELECT s, unnest(generate_series(1, len(s))) AS k FROM p)),
t AS (SELECT key, parent, CAST(depth AS INTEGER) AS depth, (SELECT count(*) FROM n b WHERE starts_with(b.key, n.key || '/')) AS below,
  row_number() OVER (ORDER BY string_split(key, '/')) - 1 AS place FROM n)"""


@query
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first order, and how many places are below each."""
    return tree.depth_first(place_tree(spark, sf_dir))


sql("tree_walk", f"WITH {PLACES} SELECT * FROM t")


@query
def tree_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk down to a depth, with what it hides."""
    return tree.shown_tree(place_tree(spark, sf_dir), max_depth=1).select("key", "depth", "hidden")


sql("tree_cut", f"WITH {PLACES} SELECT key, depth, CASE WHEN depth = 1 THEN below ELSE 0 END AS hidden FROM t WHERE depth <= 1")


@query
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places each host has at each depth, by the walk from its root."""
    found = place_tree(spark, sf_dir)
    return found.groupBy(F.substring_index("key", "/", 1).alias("host"), "depth").agg(F.count("*").alias("n"))


sql("tree_counts", f"""
WITH RECURSIVE {PLACES},
r(root, key, depth) AS (SELECT key, key, 0 FROM n WHERE parent IS NULL UNION ALL SELECT r.root, n.key, r.depth + 1 FROM r JOIN n ON n.parent = r.key)
SELECT root AS host, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM r GROUP BY ALL
""")  # fmt: skip


@query
def covered_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of pages' addresses that a template, an address with its numbers as slots, says in full."""
    pages = table(spark, sf_dir, "pages")
    template = F.regexp_replace("url", "/[0-9]+", "/{id}")
    heads = pages.select(F.regexp_extract("url", "^(.*?/)[0-9]", 1).alias("fragment")).union(pages.select("url"))
    return scope.covered(heads, pages.select(F.col("url").alias("href"), template.alias("resolved")))


sql("covered_fragments", """
WITH f AS (SELECT regexp_extract(url, '^(.*?/)[0-9]', 1) AS fragment FROM pages UNION SELECT url FROM pages),
t AS (SELECT DISTINCT regexp_replace(url, '/[0-9]+', '/{id}', 'g') AS t FROM pages)
SELECT fragment FROM f WHERE fragment <> '' AND EXISTS (
  SELECT 1 FROM t WHERE contains(t, '{') AND length(t) > length(fragment) AND starts_with(t, fragment))
""")  # fmt: skip


def page_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of domains: hosts of three labels, and the domains of two labels that begin with them."""
    hosts = table(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("host")).distinct()
    three = hosts.where(F.size(F.split("host", r"\.")) == 3).select(F.col("host").alias("domain"))
    return three.union(hosts.select(F.regexp_extract("host", r"([^.]+\.(?:com|net))$", 1))).where("domain <> ''").distinct()


SCOPES = """h AS (SELECT DISTINCT lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), ':[0-9]+$', '')) AS host FROM pages),
s AS (SELECT host AS domain FROM h WHERE len(string_split(host, '.')) = 3
  UNION SELECT regexp_extract(host, '([^.]+\.(?:com|net))$', 1) FROM h),
m AS (SELECT host, domain, row_number() OVER (PARTITION BY host ORDER BY length(domain) DESC) AS n
  FROM h JOIN s ON domain <> '' AND (host = domain OR ends_with(host, '.' || domain)))"""


@query
def longest_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page's host the longest domain of the list that it is under."""
    hosts = table(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("host"))
    return scope.longest_domain(hosts, page_scopes(spark, sf_dir))


sql("longest_scopes", f"WITH {SCOPES} SELECT host, domain FROM m WHERE n = 1")


@query
def scoped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as requests: a header for each scope, one for every host in scope, none outside."""
    scopes = page_scopes(spark, sf_dir)
    given = scopes.select("domain", F.lit("X-Scope").alias("name"), F.col("domain").alias("value"))
    given = given.union(scopes.select("domain", F.lit("Accept"), F.lit("text/html")))
    own = F.array(F.struct(F.lit("accept").alias("name"), F.lit("*/*").alias("value")), F.struct(F.lit("Host").alias("name"), url.host(F.col("url")).alias("value")))
    sent = scope.apply_headers(table(spark, sf_dir, "pages").select("url", own.alias("headers")), given, scopes)
    return sent.select("url", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "|").alias("headers"))


sql("scoped_headers", f"""
WITH {SCOPES}, r AS (SELECT url, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS given FROM pages)
SELECT url, CASE WHEN m.domain IS NULL THEN 'accept: */*|Host: ' || given
  ELSE 'Host: ' || given || '|Accept: text/html|X-Scope: ' || m.domain END AS headers
FROM r LEFT JOIN m ON n = 1 AND m.host = lower(regexp_replace(given, ':[0-9]+$', ''))
""")  # fmt: skip


@query
def links_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links of pages each category has."""
    return site_files.by_category(links(spark, sf_dir))


sql("links_by_category", f"WITH {RESOLVED} SELECT category, count(*) AS n FROM r GROUP BY category")

RANK = "CASE category " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(CATEGORIES)) + " END"


@query
def links_in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each page's link in a capture's file."""
    return graph.in_file_order(url_links(spark, sf_dir)).select("href", "nth")


sql("links_in_file_order", f"WITH {URLS} SELECT href, row_number() OVER (ORDER BY resolved, {RANK}, href) - 1 AS nth FROM u")


@query
def report_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sections of a report under one budget of lines, with the notice of what is cut."""
    l = url_links(spark, sf_dir)
    report = Report(Snapshot({"links": l}), [], everything=True, limit=120)
    found = report.lines([("hosts", report.hosts()), ("categories", site_files.by_category(l)), ("links", l.select("href"))])
    return found.select("section_no", "section", "nth", "line")


sql("report_budget", f"""
WITH {URLS}, l AS (
  SELECT 0 AS section_no, 'hosts' AS section, '{{"host":"' || domain || '","n":' || count(*) || '}}' AS line FROM u GROUP BY domain
  UNION ALL SELECT 1, 'categories', '{{"category":"' || category || '","n":' || count(*) || '}}' FROM u GROUP BY category
  UNION ALL SELECT 2, 'links', '{{"href":"' || href || '"}}' FROM u),
n AS (SELECT section_no, section, row_number() OVER (ORDER BY section_no, line) - 1 AS nth, line FROM l)
SELECT CAST(section_no AS INTEGER) AS section_no, section, nth, line FROM n WHERE nth < 120
UNION ALL SELECT 3, '', 120, '... ' || (count(*) - 120) || ' more lines' FROM n HAVING count(*) > 120
""")  # fmt: skip


@query
def contract_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL patterns that some request falls under."""
    found = contracts.patterns_with_contracts(page_observations(spark, sf_dir), url_patterns(spark, sf_dir), url_links(spark, sf_dir))
    return found.select("pattern")


sql("contract_patterns", oracles.ORACLES["pattern_contracts"].split("SELECT coalesce(best.pattern")[0] + "SELECT DISTINCT pattern FROM best")


@query
def first_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of pages with the first content type that each document was answered with."""
    pages = table(spark, sf_dir, "pages")
    answers = pages.select("url", F.when(F.col("page_id") % 2 == 1, F.regexp_extract("html", "(?i)<html lang=.([a-z]+)", 1)).otherwise("").alias("content_type"), F.col("page_id").alias("seq"))
    refs = extract.references(bodies(spark, sf_dir)).where("tag = 'a'").select("source_url", "target")
    return extract.with_content_types(refs, answers).groupBy("source_url", "content_type").agg(F.count("*").alias("n"))


sql("first_content_types", r"""
WITH a AS (SELECT url, CASE WHEN page_id % 2 = 1 THEN regexp_extract(html, '(?i)<html lang=.([a-z]+)', 1) ELSE '' END AS t, page_id FROM pages),
f AS (SELECT url, arg_min(t, page_id) AS t FROM a WHERE t <> '' GROUP BY url),
m AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>', 1)) AS target FROM pages)
SELECT m.url AS source_url, coalesce(f.t, '') AS content_type, count(*) AS n FROM m LEFT JOIN f ON m.url = f.url GROUP BY ALL
""")  # fmt: skip
