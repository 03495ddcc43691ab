"""Hosts against lists of domains, and fragments against longer addresses, as equi-joins.

A host is under a domain if one of its label suffixes is that domain, so each
distinct host is exploded into its suffixes and joined with the list by
equality: a list of thousands of domains is a table, not a chain of conditions,
and the longest match is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import url


def label_suffixes(host: Column) -> Column:
    """``a.b.c``, ``b.c``, ``c``: the domains that a host, port aside and in lower case, is or is under; none without a host."""
    labels = F.split(F.lower(url.without_port(host)), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.isNotNull() & (url.without_port(host) != ""), suffixes).otherwise(F.array().cast("array<string>"))


def longest_domain(hosts: DataFrame, scopes: DataFrame, host: str = "host") -> DataFrame:
    """(host, domain): for each distinct host the longest domain of ``scopes`` (column domain) that it is or is under; others are left out."""
    each = hosts.select(F.col(host).alias("host")).distinct()
    under = each.select("host", F.explode(label_suffixes(F.col("host"))).alias("domain"))
    names = scopes.select(F.lower("domain").alias("domain")).distinct()
    found = under.join(names, "domain")
    # A host's suffixes have different lengths, so there is one longest.
    return found.groupBy("host").agg(F.max_by("domain", F.length("domain")).alias("domain"))


def with_domain(rows: DataFrame, scopes: DataFrame, host: str = "host") -> DataFrame:
    """``rows`` with ``scope``: the longest domain that fits their host, null outside of all."""
    found = longest_domain(rows, scopes, host).withColumnsRenamed({"host": "__matched", "domain": "scope"})
    return rows.join(found, rows[host].eqNullSafe(found["__matched"]), "left").drop("__matched")


def apply_headers(requests: DataFrame, headers: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Requests (url, headers: array of name, value) with the user's headers, for hosts in scope only.

    ``headers`` has domain, name and value: a host gets those of the longest of
    its domains, of the empty domain where no other fits.  ``scopes`` (domain),
    if given, is what may get any at all.  A header given replaces all of its
    name, in whatever case; the others stay first, in their order.  Out of scope
    a request is returned as it is.
    """
    rows = requests.withColumn("__host", url.host(F.col("url")))
    if scopes is not None:
        rows = with_domain(rows, scopes, "__host").withColumn("__may", F.col("scope").isNotNull()).drop("scope")
    else:
        rows = rows.withColumn("__may", F.lit(True))
    lists = headers.groupBy(F.lower("domain").alias("scope")).agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("__given"))
    rows = with_domain(rows, lists.select(F.col("scope").alias("domain")), "__host").withColumn("scope", F.coalesce("scope", F.lit("")))
    rows = rows.join(lists, "scope", "left").withColumn(
        "__given", F.when(F.col("__may"), F.coalesce("__given", F.array())).otherwise(F.array())
    )
    names = F.transform("__given", lambda h: F.lower(h["name"]))
    own = F.filter("headers", lambda h: ~F.array_contains(names, F.lower(h["name"])))
    return rows.withColumn("headers", F.concat(own, "__given")).select(*requests.columns)


def covered(fragments: DataFrame, links: DataFrame, column: str = "fragment") -> DataFrame:
    """The distinct fragments that are the head of a longer template among the links.

    ``links`` has href and resolved; only those with a ``{`` count.  Templates
    are cut to the lengths that fragments have, of which there are few, and the
    heads meet the fragments by equality.  A null or empty fragment is never
    covered.
    """
    wanted = fragments.select(F.col(column).alias("fragment")).where("fragment <> ''").distinct()
    lengths = sorted(r[0] for r in wanted.select(F.char_length("fragment").alias("n")).distinct().collect())  # at most the longest's length
    if not lengths:
        return wanted
    whole = links.select(F.explode(F.array("href", "resolved")).alias("t")).where("t is not null and contains(t, '{')").distinct()
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.char_length("t"))
    heads = whole.select("t", F.explode(fits).alias("n")).select(F.left("t", F.col("n")).alias("fragment")).distinct()
    return wanted.join(heads, "fragment", "left_semi")


def without_covered(fragments: DataFrame, links: DataFrame, column: str = "fragment") -> DataFrame:
    """The rows of ``fragments`` that no longer template covers; rows that repeat or have a null stay."""
    gone = covered(fragments, links, column)
    return fragments.join(gone, fragments[column] == gone["fragment"], "left_anti")
