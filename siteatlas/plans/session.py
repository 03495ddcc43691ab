"""Questions to a saved capture: where a resource is linked, what it is, what calls it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import classify, url
from siteatlas.operators import fold, graph
from siteatlas.operators.extract import link_key
from siteatlas.operators.patterns import described_patterns, without_members
from siteatlas.operators.tree import running_total
from siteatlas.sources.places import Places
from siteatlas.sources.snapshot import Snapshot


class UnavailableError(Exception):
    """The capture was made without what a section needs."""


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression: no wildcard crosses a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out += "[" + inner.replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(full: Column, glob: str) -> Column:
    """The pattern fits the path, the whole URL, or, unless it starts at the root, the end of the path from a slash on."""
    rx, path = glob_regex(glob), url.path_only(full)
    hit = path.rlike(rx) | full.rlike(rx)
    if not glob.startswith("/"):
        hit = hit | path.rlike(f"(?:^|/){rx[1:]}")
    return hit


KINDS = {"css": "css", "js": "js", "image": "img", "img": "img", "font": "font", "doc": "doc", "media": "media", "data": "data"}


def is_kind(kind: str) -> Column:
    """Whether a link row is of a kind by the words of ``find``."""
    cat = F.col("category")
    if kind in ("any", ""):
        return F.lit(True)
    if kind in KINDS:
        return (cat == "web-asset") & (classify.asset_kind(F.col("href")) == KINDS[kind])
    return cat == {"api": "API", "html": "web-page", "page": "web-page", "asset": "web-asset"}.get(kind, "?")


def resource_kind(has_contract: Column) -> Column:
    cat = F.col("category")
    return (
        F.when(has_contract | (cat == "API"), "API")
        .when(cat == "web-asset", F.concat(F.lit("asset: "), classify.asset_kind(F.col("href"))))
        .when(cat == "DYNAMIC", "unknown")
        .otherwise(cat)
    )


# Documents that stand for a directory.
INDEX_PAGES = ["index.html", "index.htm", "index.php"]


@dataclass
class Session:
    """A place in a capture, and the verbs of the explorer as DataFrames."""

    capture: Snapshot
    target: str
    place: str = ""
    show: set[str] = field(default_factory=set)
    places: Places | None = None  #: the capture's links by place, to read only those that a verb is about

    def __post_init__(self):
        self.place = self.place or self.target

    def listed(self) -> DataFrame:
        """Links that the capture itself listed, with their key."""
        links = self.capture["links"].withColumn("key", link_key())
        return links.where("not synthesized") if "synthesized" in links.columns else links

    def resolve(self, path: str) -> str:
        """A path against the current place; ``..`` goes up as in a shell."""
        if "://" in path:
            return path
        at = urlsplit(self.place)
        own = at.path if path and not path.startswith("/") else ""
        if own and not own.endswith("/"):
            own += "/" if self.is_directory() else ""
        stack: list[str] = []
        for part in (own + path).split("/"):
            if part == "..":
                stack = stack[:-1]
            elif part not in ("", "."):
                stack.append(part)
        tail = "/" if path.endswith("/") and stack else ""
        return f"{at.scheme}://{at.netloc}/" + "/".join(stack) + tail

    def is_directory(self) -> bool:
        return self.page_at(self.place) is None

    def page_at(self, full: str) -> str | None:
        """The fetched document at a URL: the page itself, without its slash, then an index page below it."""
        bare = full.rstrip("/")
        wanted = [full, bare, bare + "/", *(f"{bare}/{p}" for p in INDEX_PAGES)]
        rows = self.capture["pages"].where(F.col("url").isin(wanted)).select("url").distinct().collect()  # six at most
        found = {r["url"] for r in rows}
        for w in wanted:
            if w in found:
                return w
        key = url.host_path_key(F.col("url"))
        same = self.capture["pages"].where(key == url.host_path_key(F.lit(full))).agg(F.min("url")).first()
        return same[0]

    def cd(self, path: str) -> str:
        """Move to a page, or to a directory if something is below it."""
        full = self.resolve(path)
        page = self.page_at(full)
        if page is None and self.under(full).isEmpty():
            raise KeyError(full)
        self.place = page or full
        return self.place

    def children(self, page: str) -> DataFrame:
        """Links found on a page, by edge or by their own source, each once, by key."""
        ends = self.capture["edges"].where((F.col("kind") == "source") & (F.col("from_key") == page)).select(F.col("to_key").alias("key"))
        links = self.listed()
        by_edge = links.join(ends.distinct(), "key", "left_semi")
        source = F.col("source_url")
        by_source = links.where((source != "") & ((source == page) | (url.path_only(source) == url.path_only(F.lit(page)))))
        return by_edge.unionByName(by_source).dropDuplicates(["key"]).orderBy("key")

    def under(self, prefix: str) -> DataFrame:
        """URLs at or below a path, at any depth."""
        path, at = url.path_only(F.col("key")), url.path_only(F.lit(prefix))
        exact = F.regexp_replace(at, "(?<=.)/$", "")
        below = F.when(exact == "/", F.lit(True)).otherwise(F.startswith(path, F.concat(exact, F.lit("/"))))
        return self.listed().where((path == exact) | below).select("key").distinct().orderBy("key")

    def ls(self, path: str = "") -> DataFrame:
        full = self.resolve(path) if path else self.place
        page = self.page_at(full)
        return self.children(page) if page else self.under(full)

    def node(self, full: str) -> DataFrame:
        """The best link row of a URL: of equal key, else of an equal place on the same host, listed ones first."""
        links = self.places.at(full) if self.places else self.capture["links"].withColumn("key", link_key())
        exact = F.col("key") == full
        same = url.host_path_key(F.col("key")) == url.host_path_key(F.lit(full))
        made = F.col("synthesized").cast("int") if "synthesized" in links.columns else F.lit(0)
        return links.where(exact | same).orderBy(F.when(exact, 0).otherwise(1), made, F.length("key"), "key").limit(1)

    def contract(self, full: str) -> DataFrame:
        """The contract of a URL: over an edge, else by place."""
        edges = self.capture["edges"].where((F.col("kind") == "contract") & (F.col("from_key") == full)).select(F.col("to_key").alias("path"))
        ends = self.capture["endpoints"].join(edges.withColumn("rank", F.lit(0)), "path")
        place = self.capture["endpoints"].where(url.place_key(F.col("path")) == url.place_key(F.lit(full))).withColumn("rank", F.lit(1))
        return ends.unionByName(place).orderBy("rank", "path").limit(1).drop("rank")

    def contracts(self) -> DataFrame:
        return self.capture["endpoints"].orderBy("path")

    def what(self, path: str) -> DataFrame:
        """(key, kind, domain, depth, methods) of a resource."""
        full = self.resolve(path)
        own = self.contract(full).select("methods", F.lit(True).alias("has"))
        row = self.node(full).join(own, how="left")
        return row.select("key", resource_kind(F.coalesce("has", F.lit(False))).alias("kind"), "domain", "link_type", "class", "methods")

    def parents(self, path: str) -> DataFrame:
        """Pages that reference a resource: edges read backwards."""
        full = self.resolve(path)
        rows = self.capture["edges"].where((F.col("kind") == "source") & (F.col("to_key") == full))
        return rows.select(F.col("from_key").alias("key")).distinct().orderBy("key")

    def observations(self, path: str) -> DataFrame:
        full = self.resolve(path)
        return self.capture["observations"].where(url.place_key(F.col("url")) == url.place_key(F.lit(full)))

    def references(self, path: str = "") -> DataFrame:
        """Where a resource stands; all references without a path."""
        if "refs" not in self.capture:
            raise UnavailableError("references: the capture was made without them")
        refs = self.capture["refs"]
        if not path:
            return refs.orderBy("source_url", "offset")
        return refs.where(url.place_key(F.col("target")) == url.place_key(F.lit(self.resolve(path)))).orderBy("source_url", "offset")

    def find(self, kind: str, glob: str) -> DataFrame:
        """URLs of a kind that a shell pattern fits: links, else patterns, and contracts for APIs."""
        links = self.listed().where(is_kind(kind) & glob_match(F.col("key"), glob)).select("key")
        if links.isEmpty():
            p = self.capture["patterns"]
            fits = F.lit(True) if kind in ("any", "") else classify.matches_api(F.col("pattern")) if kind == "api" else F.lit(False)
            links = p.where(fits & glob_match(F.col("pattern"), glob)).select(F.col("pattern").alias("key"))
        if kind in ("api", "any", ""):
            links = links.union(self.capture["endpoints"].where(glob_match(F.col("path"), glob)).select("path"))
        return links.distinct().orderBy("key")

    def complete(self, word: str) -> DataFrame:
        """Candidates for a word: paths that start with it, or any segment of which does."""
        keys = self.listed().select("key").union(self.capture["pages"].select("url")).union(self.capture["endpoints"].select("path"))
        path = url.path_only(F.col("key"))
        if word.startswith("/"):
            hit = path.startswith(word)
        else:
            hit = F.exists(F.split(path, "/", -1), lambda s: (s != "") & s.startswith(word))
        return keys.where(hit).select(path.alias("path")).distinct().orderBy("path")

    def extend(self, other: Snapshot) -> Session:
        """A session over the union with another capture."""
        return Session(Snapshot(graph.union_captures(self.capture.tables, other.tables)), self.target, self.place, self.show)


@dataclass
class Report:
    """The sections of a capture's report, each a DataFrame made when asked for."""

    capture: Snapshot
    domains: list[str]
    show: set[str] = field(default_factory=set)
    everything: bool = False
    group: bool = True
    limit: int = 0

    def rows(self) -> DataFrame:
        """The link table: in scope, visible, no members of patterns, queries folded, in display order."""
        links = fold.visible(fold.in_scope(self.capture["links"], self.domains, self.everything), self.show)
        if "synthesized" in links.columns:
            links = links.where("not synthesized")
        if self.group and "patterns" in self.capture:
            links = without_members(links, self.capture["patterns"])
        return fold.sorted_for_display(fold.fold_params(links))

    def statistics(self, show_tags: bool = False) -> DataFrame:
        return fold.link_stats(self.capture["links"], show_tags)

    def hidden_classes(self) -> DataFrame:
        return self.capture["links"].where("class <> 'normal'").groupBy("class").agg(F.count(F.lit(1)).alias("n"))

    def patterns(self) -> DataFrame:
        """Patterns with the first three members."""
        p = described_patterns(self.capture["patterns"])
        return p.select("domain", "pattern", "count", "annotation", "slots", F.slice("members", 1, 3).alias("members")).orderBy("domain", "pattern")

    def params(self) -> DataFrame:
        order = F.array_position(F.array(*map(F.lit, fold.OWNERS)), F.col("owner"))
        return fold.unseen_params(self.capture["params"], self.capture["links"]).orderBy(order.desc(), "kind", "name")

    def contracts(self) -> DataFrame:
        self.need("endpoints")
        return self.capture["endpoints"].orderBy("path")

    def observations(self) -> DataFrame:
        self.need("observations")
        return self.capture["observations"].orderBy("url", "method")

    def references(self) -> DataFrame:
        self.need("refs")
        return self.capture["refs"].orderBy("source_url", "offset")

    def tree(self, root: str, depth: int = 20) -> DataFrame:
        return graph.crawl_tree(self.capture["edges"], root, depth)

    def edges(self) -> DataFrame:
        return graph.edge_counts(self.capture["edges"])

    def hosts(self) -> DataFrame:
        return fold.host_counts(self.capture["links"])

    def need(self, table: str) -> None:
        """A section that the capture can't answer is an error, not an empty table."""
        if table not in self.capture:
            raise UnavailableError(f"{table}: the capture was made without it")

    def lines(self, sections: list[tuple[str, DataFrame]]) -> DataFrame:
        """(section_no, section, nth, line) of several sections, cut to one budget of lines over all of them.

        A line's number is a running count in two passes, per range and over
        the ranges, so no sort of all lines is in one task.  Where lines are
        cut, one more says how many.
        """
        parts = [
            df.select(F.lit(k).alias("section_no"), F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("line"))
            for k, (name, df) in enumerate(sections)
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        numbered = running_total(out.withColumn("__one", F.lit(1)), ["section_no", "line"], "__one", "nth").drop("__one")
        numbered = numbered.select("section_no", "section", "nth", "line")
        if not self.limit:
            return numbered
        cut = numbered.agg((F.count("*") - self.limit).alias("n")).where("n > 0")
        notice = cut.select(
            F.lit(len(sections)).alias("section_no"),
            F.lit("").alias("section"),
            F.lit(self.limit).cast("long").alias("nth"),
            F.concat(F.lit("... "), F.col("n").cast("string"), F.lit(" more lines")).alias("line"),
        )
        return numbered.where(F.col("nth") < self.limit).unionByName(notice)

    def markdown(self, rows: int = 200) -> str:
        """A short written report for a screen; ``rows`` of each list, and how many there are.

        :func:`siteatlas.sources.site_files.save_report` writes whole lists.
        """
        out = []
        for title, df, text in [
            ("Links", fold.valuable(self.rows()), lambda r: f"- {r['href']} ({r['category']})"),
            ("Patterns", self.patterns(), lambda r: f"- {r['pattern']} {r['annotation']}"),
        ]:
            total = df.count()
            out += [f"# {title}", "", *map(text, df.limit(rows).collect())]
            out += [f"- ... {total - rows} more"] * (total > rows) + [""]
        return "\n".join(out) + "\n"
