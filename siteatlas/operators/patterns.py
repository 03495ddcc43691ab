"""URL patterns: families of similar URLs as shapes with typed slots.

Two URLs of a host with the same number of segments and the same first literal
share a shape: the segments in which they agree, slots elsewhere.  A shape's
members are all URLs of all pairs that share it.

Pairs are not made one by one.  A pair that differs at a set of positions is
found by grouping on the segments outside the set: the groups of every
non-empty set of positions, with two members or more that differ in each of
the set's positions.  Only positions that vary within the bucket count.  Sets
grow by ``STEP`` positions at a time, and rows that are alone in their group,
or whose group agrees in a position that is to be a slot, are dropped before
the next step: no larger set can bring them a partner.  So the rows of a step
follow the shapes that exist.

Sets double with each varying position, so a bucket of many positions and few
URLs is better paired.  Which way a bucket goes is counted before: if the pairs
that share a segment are no more than the sets of slots of its URLs, the pairs
are made from an index of segments (:func:`paired`).  Both ways give the same
rows, so the choice is one of cost alone, and pairs never outnumber the sets
that they replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import classify, url
from siteatlas.operators.extract import link_key
from siteatlas.sources.tables import written

#: By so many positions the sets of slots grow before rows without a partner are dropped.
STEP = 4
#: So many rows of one segment meet as many others in a task; more are split into blocks.
BLOCK_ROWS = 1000


def canonical_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """(canonical, host, segs, n, bucket) of the distinct usable http(s) URLs."""
    rows = urls.select(url.canonical(F.col(column)).alias("canonical")).where("canonical is not null").distinct()
    rows = rows.select("canonical", url.host(F.col("canonical")).alias("host"), url.segments(F.col("canonical")).alias("segs"))
    first = F.get("segs", F.lit(0))
    typed = classify.segment_kind(first).isin("int", "uuid", "hash", "base64")
    return rows.where("segs is not null").select(
        "canonical", "host", "segs", F.size("segs").alias("n"), F.when(typed, "").otherwise(first).alias("bucket")
    )


BUCKET = ["host", "bucket", "n"]


def masked(rows: DataFrame) -> DataFrame:
    """(host, mask, canonical, segs): members of every shape; a slot is an empty segment.

    For each set of positions, rows are grouped by the other segments.  A row
    is a member of the shape if its group has a row that differs from it in all
    positions of the set.  Empty tables give no shapes.
    """
    ends = rows.select(*BUCKET, F.posexplode("segs").alias("i", "s")).groupBy(*BUCKET, "i").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    vary = ends.where("low <> high").groupBy(*BUCKET).agg(F.array_sort(F.collect_list("i")).alias("vary"))  # as many as a path has segments
    now = written(rows.join(vary, BUCKET), "varying")
    size = lambda of: of.agg(F.max(F.size("vary"))).first()[0] or 0
    deepest, pairs = size(now), None
    if deepest > STEP:  # one step makes all the sets of the others
        few = written(cheaper_in_pairs(now), "few")
        pairs, now = paired(now.join(few, BUCKET, "left_semi")), now.join(few, BUCKET, "left_anti")
        deepest = size(now)
    by_sets = masked_by_sets(now, deepest)
    return by_sets if pairs is None else by_sets.union(pairs)


def with_mask(rows: DataFrame) -> DataFrame:
    """``rows`` with ``mask``: their segments, empty at the positions ``at``."""
    return rows.withColumn("mask", F.transform("segs", lambda s, i: F.when(F.array_contains("at", i), F.lit("")).otherwise(s)))


def masked_by_sets(now: DataFrame, deepest: int) -> DataFrame:
    """Members by sets of slots; no URL of ``now`` has more than ``deepest`` varying positions."""
    now, out = now.withColumn("at", F.array().cast("array<int>")), None
    for done in range(STEP, max(deepest, 1) + STEP, STEP):
        now = with_slots(now, done)
        if done < deepest:
            now = written(now, "slots")  # read by what ends here, and twice by the next step
        ended = now.where((F.size("vary") <= done) & (F.size("at") > 0))
        out = ended if out is None else out.union(ended)
        now = now.where(F.size("vary") > done)
    slots = F.transform("at", lambda i: F.get("segs", i))
    keyed = with_mask(out).select("host", "mask", "canonical", "segs", slots.alias("slots"))
    # With one slot, any other value will do, and the group has one; with more, a partner must differ in every slot.
    several = partners(written(keyed.where(F.size("slots") > 1), "several"), deepest)
    one = keyed.where(F.size("slots") == 1)
    if deepest > STEP:  # literals of later steps may have left one path under two schemes, which has one value
        values = one.groupBy("host", "mask").agg(F.min("slots").alias("low"), F.max("slots").alias("high")).where("low <> high")
        one = one.join(values.select("host", "mask"), ["host", "mask"], "left_semi")
    return one.drop("slots").union(several.select("host", "mask", "canonical", "segs"))


def with_slots(rows: DataFrame, done: int) -> DataFrame:
    """``rows`` once for each set of slots among the last ``STEP`` of the first ``done`` varying positions, if a group goes with it.

    ``at`` has the slots so far.  The group has the same literals at the other
    positions so far, two rows or more, and two values or more at each slot.
    Its counts are aggregates, combined before the exchange.
    """
    last = f"slice(vary, {done - STEP + 1}, {STEP})"
    sets = rows.withColumn("q", F.explode(F.expr(f"sequence(0, cast(shiftleft(1, size({last})) as int) - 1)")))
    sets = sets.withColumn("new", F.expr(f"filter({last}, (p, k) -> (shiftright(q, k) & 1) = 1)")).withColumn("at", F.concat("at", "new"))
    literals = F.expr(f"transform(filter(slice(vary, 1, {done}), p -> not array_contains(at, p)), p -> get(segs, p))")
    sets = sets.withColumn("literals", literals)
    key = [*BUCKET, "at", "literals"]
    values = [F.get("segs", F.get("new", F.lit(k))) for k in range(STEP)]
    ends = [f(v).alias(f"{name}{k}") for k, v in enumerate(values) for name, f in (("low", F.min), ("high", F.max))]
    groups = sets.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *ends).where("rows > 1")
    for k in range(STEP):
        groups = groups.where(f"low{k} is null or low{k} <> high{k}")
    return sets.join(groups.select(*key), key, "left_semi").select(*BUCKET, "canonical", "segs", "vary", "at")


def partners(keyed: DataFrame, most: int) -> DataFrame:
    """Rows with several slots, ``most`` at most, that have a partner of their mask which differs in each.

    The tuples that share no value with a row's are counted by inclusion and
    exclusion over sets of slots, each a grouped count of the others with the
    same values there.  The sets grow as those of :func:`with_slots` do: where
    no other tuple has the same values, none has with more slots.
    """
    key = ["host", "mask", "slots"]
    now, out = keyed.select(*key).distinct().withColumn("on", F.array().cast("array<int>")), None
    for done in range(STEP, max(most, 1) + STEP, STEP):
        last = f"filter(sequence({done - STEP}, {done - 1}), p -> p < size(slots))"
        sets = now.withColumn("q", F.explode(F.expr(f"sequence(0, cast(shiftleft(1, size({last})) as int) - 1)")))
        sets = sets.withColumn("on", F.concat("on", F.expr(f"filter({last}, (p, k) -> (shiftright(q, k) & 1) = 1)"))).drop("q")
        sets = sets.withColumn("part", F.transform("on", lambda p: F.get("slots", p)))
        same = sets.groupBy("host", "mask", "on", "part").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
        now = sets.join(same, ["host", "mask", "on", "part"]).select(*key, "on", "others")
        if done < most:
            now = written(now, "parts")
        ended = now.where(F.size("slots") <= done)
        out = ended if out is None else out.union(ended)
        now = now.where(F.size("slots") > done).drop("others")
    signed = F.when(F.size("on") % 2 == 0, F.col("others")).otherwise(-F.col("others"))
    apart = out.groupBy(*key).agg(F.sum(signed).alias("apart")).where("apart > 0")
    return keyed.join(apart.drop("apart"), key, "left_semi")


def segment_index(rows: DataFrame) -> DataFrame:
    """(host, bucket, n, i, s, sharing): how many URLs of a bucket have segment ``s`` at a varying position."""
    at = rows.select(*BUCKET, F.explode("vary").alias("i"), "segs").withColumn("s", F.get("segs", F.col("i")))
    return at.groupBy(*BUCKET, "i", "s").agg(F.count(F.lit(1)).alias("sharing"))


def cheaper_in_pairs(rows: DataFrame) -> DataFrame:
    """(host, bucket, n) of buckets with more than ``STEP`` varying positions and no more agreeing pairs than sets of slots."""
    pairs = segment_index(rows.where(F.size("vary") > STEP)).groupBy(*BUCKET).agg(
        F.sum(F.col("sharing") * (F.col("sharing") - 1.0) / 2).alias("pairs"), F.countDistinct("i").alias("positions"), F.sum("sharing").alias("all")
    )
    sets = F.col("all") / F.col("positions") * F.pow(F.lit(2.0), F.col("positions"))
    return pairs.where(F.col("pairs") <= sets).select(*BUCKET)


def paired(rows: DataFrame) -> DataFrame:
    """(host, mask, canonical, segs) as of :func:`masked`, by the pairs that share a segment.

    A pair is made at the first varying position in which it agrees, so once
    only; segments of one URL make none.  The URLs of a common segment are split
    into blocks of ``BLOCK_ROWS``, and a task holds two blocks at most.  Pairs
    that agree in no varying position are not made: a URL is a member of the
    shape with a slot in each if its partners by segments are fewer than the
    other URLs of its bucket.
    """
    index = segment_index(rows).where("sharing > 1").withColumn("blocks", F.ceil(F.col("sharing") / BLOCK_ROWS).cast("int"))
    spread = rows.withColumn("i", F.explode("vary")).withColumn("s", F.get("segs", F.col("i"))).join(index, [*BUCKET, "i", "s"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("canonical"), F.col("blocks")).cast("int"))
    left = spread.withColumns({"low": F.col("block"), "high": F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))})
    right = spread.withColumns({"high": F.col("block"), "low": F.explode(F.sequence(F.lit(0), F.col("block")))})
    left = left.select(*BUCKET, "i", "s", "low", "high", "vary", F.struct("canonical", "segs").alias("a"))
    right = right.select(*BUCKET, "i", "s", "low", "high", F.struct("canonical", "segs").alias("b"))
    agree = lambda p: F.get("a.segs", p) == F.get("b.segs", p)
    both = left.join(right, [*BUCKET, "i", "s", "low", "high"]).where((F.col("low") < F.col("high")) | (F.col("a.canonical") < F.col("b.canonical")))
    both = both.where(~F.exists("vary", lambda p: (p < F.col("i")) & agree(p)))
    apart = F.filter("vary", lambda p: ~agree(p))
    ends = both.select(*BUCKET, apart.alias("at"), F.explode(F.array("a", "b")).alias("end")).select(*BUCKET, "end.*", "at")
    ends = written(ends.groupBy(*BUCKET, "canonical", "segs", "at").agg(F.count(F.lit(1)).alias("partners")), "pairs")
    met = ends.groupBy("canonical").agg(F.sum("partners").alias("partners"))
    others = rows.groupBy(*BUCKET).agg((F.count(F.lit(1)) - 1).alias("others"))
    alone = rows.join(others, BUCKET).join(met, "canonical", "left").where(F.coalesce("partners", F.lit(0)) < F.col("others"))
    found = ends.where(F.size("at") > 0).select("host", "canonical", "segs", "at")
    found = found.union(alone.select("host", "canonical", "segs", F.col("vary").alias("at")))
    return with_mask(found).select("host", "mask", "canonical", "segs")


def slot_name(i: Column, total: Column) -> Column:
    return F.when(total == 1, F.lit("id")).otherwise(F.concat(F.lit("id"), (i + 1).cast("string")))


def kind_of_values(values: Column) -> Column:
    """The kind that all values have, else string."""
    kinds = F.array_distinct(F.transform(values, classify.segment_kind))
    return F.when((F.size(kinds) == 1) & (kinds[0] != ""), kinds[0]).otherwise("string")


def shapes(members: DataFrame, min_count: int = 2, group_strings: bool = False) -> DataFrame:
    """Patterns of member rows, without their members: (domain, pattern, count, kinds, mask).

    Counts and kinds are aggregates, combined before each exchange; no task
    ever holds the members of a pattern.
    """
    key = ["host", "mask"]
    heads = members.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.min("canonical").alias("lead"))
    heads = heads.where((F.col("count") >= max(min_count, 2)) & F.exists("mask", lambda s: s != ""))
    slots = members.select(*key, F.posexplode("mask").alias("i", "literal"), "segs").where("literal = ''")
    kind = classify.segment_kind(F.get("segs", F.col("i")))
    kinds = slots.groupBy(*key, "i").agg(F.min(kind).alias("low"), F.max(kind).alias("high"))
    one = F.when((F.col("low") == F.col("high")) & (F.col("low") != ""), F.col("low")).otherwise("string")
    kinds = kinds.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", one.alias("kind")))).alias("slots"))  # as many as a path has segments
    rows = heads.join(kinds, key)
    if not group_strings:
        rows = rows.where(~F.exists("slots", lambda v: v["kind"] == "string"))
    at = F.transform("slots", lambda v: v["i"])
    number = lambda i: F.array_position(at, i).cast("int") - 1
    shown = F.transform(
        "mask",
        lambda s, i: F.when(s != "", s).otherwise(
            F.concat(F.lit("{"), slot_name(number(i), F.size("slots")), F.lit(": "), F.get("slots", number(i))["kind"], F.lit("}"))
        ),
    )
    root = F.concat(url.scheme(F.col("lead")), F.lit("://"), F.col("host"))
    return rows.select(
        F.col("host").alias("domain"),
        F.concat(root, F.lit("/"), F.array_join(shown, "/")).alias("pattern"),
        F.col("count").cast("int").alias("count"),
        F.transform("slots", lambda v: v["kind"]).alias("kinds"),
        "mask",
    )


def pattern_members(urls: DataFrame, min_count: int = 2, group_strings: bool = False, column: str = "url") -> DataFrame:
    """(domain, pattern, canonical): a row for each member of each pattern."""
    rows = written(masked(canonical_urls(urls, column)), "shapes")  # read several times
    found = shapes(rows, min_count, group_strings).select(F.col("domain").alias("host"), "mask", "pattern")
    return rows.join(found, ["host", "mask"]).select(F.col("host").alias("domain"), "pattern", "canonical")


def find_patterns(urls: DataFrame, min_count: int = 2, group_strings: bool = False, column: str = "url") -> DataFrame:
    """Fold URLs into patterns: (domain, pattern, count, vars, mask, members).

    ``vars``: kind and values of each slot in the order of members.  Shapes
    without a literal are never patterns; with ``group_strings`` off neither
    are those with a slot of plain words.  Members are listed in the row, for
    captures and reports; :func:`shapes` and :func:`pattern_members` are the
    forms for patterns of any size.
    """
    rows = written(masked(canonical_urls(urls, column)), "shapes")  # read several times
    found = shapes(rows, min_count, group_strings)
    listed = rows.join(found.select(F.col("domain").alias("host"), "mask"), ["host", "mask"], "left_semi")
    listed = listed.groupBy("host", "mask").agg(F.array_sort(F.collect_list(F.struct("canonical", "segs"))).alias("rows"))
    both = found.join(listed.withColumnRenamed("host", "domain"), ["domain", "mask"])
    at = F.filter(F.transform("mask", lambda s, i: F.when(s == "", i)), lambda i: i.isNotNull())
    values = F.transform(at, lambda i: F.transform("rows", lambda r: F.get(r["segs"], i)))
    return both.select(
        "domain",
        "pattern",
        "count",
        F.zip_with("kinds", values, lambda k, v: F.struct(k.alias("kind"), v.alias("values"))).alias("vars"),
        "mask",
        F.transform("rows", lambda r: r["canonical"]).alias("members"),
    )


def link_patterns(links: DataFrame, **how) -> DataFrame:
    """Patterns of links that are no endpoints."""
    pages = links.where(~F.col("category").isin("API", "DYNAMIC")).select(link_key().alias("url"))
    return find_patterns(pages, **how)


def without_members(links: DataFrame, patterns: DataFrame) -> DataFrame:
    """Links that no pattern absorbed: a left anti join on the canonical URL.

    ``patterns`` lists members in its rows or is the table of member rows.
    """
    rows = patterns if "canonical" in patterns.columns else patterns.select(F.explode("members").alias("canonical"))
    members = rows.select("canonical").distinct()
    keyed = links.withColumn("canonical", url.canonical(link_key()))
    return keyed.join(members, "canonical", "left_anti").drop("canonical")


def matching_patterns(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url, pattern, vars, trailing, count) of every pattern that fits a URL.

    A URL is masked once for each set of slots that patterns of its host and
    depth have, which are few however many patterns there are, and meets the
    patterns by an equi-join on host and mask, literals included.
    """
    u = urls.select("url", url.canonical(F.col("url")).alias("c")).where("c is not null")
    u = u.select("url", url.host(F.col("c")).alias("domain"), url.segments(F.col("c")).alias("segs")).where("segs is not null")
    u = u.withColumn("n", F.size("segs"))
    slots = F.transform("mask", lambda m: m == "")
    vars_ = F.size(F.filter("mask", lambda m: m == ""))
    p = patterns.select("domain", "pattern", "mask", "count", vars_.alias("vars"), slots.alias("slots"), F.size("mask").alias("n"))
    sets = p.select("domain", "n", "slots").distinct()
    masked_ = F.zip_with("segs", "slots", lambda s, slot: F.when(slot, F.lit("")).otherwise(s))
    both = u.join(sets, ["domain", "n"]).select("url", "domain", "n", masked_.alias("mask")).join(p, ["domain", "n", "mask"])
    trailing = F.coalesce(F.array_position(F.reverse("slots"), True) - 1, F.size("mask").cast("long"))
    return both.select("url", "pattern", "vars", F.when(trailing < 0, F.col("n")).otherwise(trailing).alias("trailing"), "count")


def best_pattern(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url, pattern): the narrowest: fewest slots, then most trailing literals, then most members, then by name."""
    w = Window.partitionBy("url").orderBy("vars", F.desc("trailing"), F.desc("count"), "pattern")
    ranked = matching_patterns(urls.select("url").distinct(), patterns).withColumn("nth", F.row_number().over(w))
    return ranked.where("nth = 1").select("url", "pattern")


def value_range(kind: Column, values: Column) -> Column:
    """``3..7`` for consecutive numbers, else the distinct values."""
    numbers = F.array_sort(F.array_distinct(F.transform(values, lambda v: v.try_cast("long"))))
    plain = (kind == "int") & ~F.exists(numbers, lambda v: v.isNull())
    low, high = F.array_min(numbers), F.array_max(numbers)
    run = (F.size(numbers) >= 2) & (high - low + 1 == F.size(numbers))
    listed = F.array_join(F.transform(numbers, lambda v: v.cast("string")), ", ")
    return (
        F.when(plain & run, F.concat(low.cast("string"), F.lit(".."), high.cast("string")))
        .when(plain, listed)
        .otherwise(F.array_join(F.array_distinct(values), ", "))
    )


def described_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns with the texts that reports show: grouped_by, annotation, slots."""
    total = F.size("vars")
    kinds = F.transform("vars", lambda v: v["kind"])
    names = F.transform("vars", lambda v, i: F.concat(v["kind"], F.lit(": "), slot_name(i, total)))
    slots = F.transform(
        "vars",
        lambda v, i: F.concat(slot_name(i, total), F.lit("("), v["kind"], F.lit("): "), value_range(v["kind"], v["values"])),
    )
    return (
        patterns.withColumn("grouped_by", F.array_join(F.array_distinct(kinds), ","))
        .withColumn("annotation", F.concat(F.lit("("), F.array_join(names, ", "), F.lit(")")))
        .withColumn("slots", slots)
    )


def cluster_ranges(patterns: DataFrame) -> DataFrame:
    """(annotation, slot, kind, range): values merged over the patterns of one annotation."""
    rows = described_patterns(patterns).select("annotation", "pattern", F.posexplode("vars").alias("slot", "v"))
    merged = rows.groupBy("annotation", "slot").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pattern", F.col("v.values").alias("x")))), lambda r: r["x"])).alias("values")
    )
    kind = kind_of_values(F.col("values"))
    return merged.select("annotation", "slot", kind.alias("kind"), value_range(kind, F.col("values")).alias("range"))


def slot_values(members: DataFrame, found: DataFrame) -> DataFrame:
    """(annotation, slot, value): the distinct values of a slot over all patterns of one annotation, a row for each.

    ``members`` are rows of :func:`masked`, ``found`` those of :func:`shapes`.
    """
    names = F.transform("kinds", lambda k, i: F.concat(k, F.lit(": "), slot_name(i, F.size("kinds"))))
    noted = found.select(F.col("domain").alias("host"), "mask", F.concat(F.lit("("), F.array_join(names, ", "), F.lit(")")).alias("annotation"))
    at = F.filter(F.transform("mask", lambda s, i: F.when(s == "", i)), lambda i: i.isNotNull())
    rows = members.join(noted, ["host", "mask"]).select("annotation", "segs", F.posexplode(at).alias("slot", "i"))
    return rows.select("annotation", "slot", F.get("segs", F.col("i")).alias("value")).distinct()


def slot_ranges(members: DataFrame, found: DataFrame) -> DataFrame:
    """(annotation, slot, kind, n_values, low, high, consecutive) of the values that :func:`slot_values` has.

    Ends and counts are aggregates, combined before the exchange, so a slot of
    any number of values is one small row; ``low`` and ``high`` are null unless
    all values are numbers.  Numbers written in two ways count once for
    ``consecutive``.
    """
    number, kind = F.col("value").try_cast("long"), classify.segment_kind(F.col("value"))
    rows = slot_values(members, found).withColumns({"number": number, "kind": kind})
    counted = rows.groupBy("annotation", "slot", "number").agg(
        F.count(F.lit(1)).alias("values"), F.min("kind").alias("first"), F.max("kind").alias("last")
    )
    ends = counted.groupBy("annotation", "slot").agg(
        F.sum("values").alias("n_values"), F.min("number").alias("low"), F.max("number").alias("high"), F.count("number").alias("numbers"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or(F.col("number").isNull()).alias("other"),
    )
    one = F.when((F.col("first") == F.col("last")) & (F.col("first") != ""), F.col("first")).otherwise("string")
    plain = (one == "int") & ~F.col("other")
    run = plain & (F.col("numbers") >= 2) & (F.col("high") - F.col("low") + 1 == F.col("numbers"))
    return ends.select(
        "annotation", "slot", one.alias("kind"), "n_values", F.when(plain, F.col("low")).alias("low"), F.when(plain, F.col("high")).alias("high"),
        run.alias("consecutive"),
    )


# Which label wins a tie of a vote, first to last.
VOTE_ORDER = {
    "category": ["API", "DYNAMIC", "web-page", "web-asset"],
    "link_type": ["absolute", "relative", "web"],
    "class": ["normal", "CDN", "WAF", "cache", "noise"],
    "asset": ["js", "css", "img", "font", "media", "doc", "data", "asset"],
}


def pattern_kinds(patterns: DataFrame, links: DataFrame) -> DataFrame:
    """(pattern, category, link_type, class, asset) by a vote of the member links, one link for each URL."""
    one = links.withColumn("canonical", url.canonical(F.col("resolved"))).where("canonical is not null")
    one = one.groupBy("canonical").agg(
        *(F.min_by(c, F.struct("source_url", "href")).alias(c) for c in ("category", "link_type", "class", "href"))
    )
    votes = patterns.select("domain", "pattern", F.explode("members").alias("canonical")).join(one, "canonical")
    votes = votes.withColumn("asset", F.when(F.col("category") == "web-asset", classify.asset_kind(F.col("href"))))
    best = []
    for name, order in VOTE_ORDER.items():
        counts = F.array(*(F.struct(F.count_if(F.col(name) == v).alias("n"), F.lit(-k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(order)))
        top = F.array_max(counts)
        none = "unknown" if name in ("category", "link_type") else "js" if name == "asset" else "normal"
        best.append(F.when(top["n"] > 0, top["v"]).otherwise(none).alias(name))
    return votes.groupBy("domain", "pattern").agg(*best)
