"""Links by place: the same rows as whole scans, from few row groups."""

import random

import pytest
from pyspark.sql import functions as F

from siteatlas.functions import url
from siteatlas.sources.places import Places, save_places


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(4)
    out = [f"https://h{rng.randrange(3)}.example/{'/'.join(rng.choice(['a', 'b', 'a b', 'a0', 'é', str(rng.randrange(40))]) for _ in range(rng.randrange(4)))}{rng.choice(['', '/', '?x=1', '#y'])}" for _ in range(3000)]
    return [*out, "https://h0.example/a", "https://h0.example/a/1/2", "https://h0.example/a0", "/relative/x", ""]


@pytest.fixture(scope="module")
def places(spark, urls, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('places')}/p"
    links = spark.createDataFrame([(u, u if "://" in u else "") for u in urls], "href string, resolved string")
    save_places(links, folder, row_group=1 << 14)
    return Places.load(spark, folder)


def place_of(spark, urls):
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url.host_path_key(F.col("u")).alias("p")).collect()
    return {r["u"]: r["p"] for r in rows}


def test_lookups_match_a_scan(spark, urls, places):
    keys = place_of(spark, [*urls, "https://h9.example/none"])
    for wanted in ["https://h0.example/a", "http://H0.EXAMPLE/a/?q=2#z", "https://h1.example/", "https://h1.example", "https://h2.example/a%20b", "https://h9.example/none"]:
        own = place_of(spark, [wanted])[wanted]
        assert sorted(r["href"] for r in places.at(wanted).collect()) == sorted(u for u in urls if keys[u] == own)
        head = own if own.endswith("/") else own + "/"
        below = sorted(u for u in urls if keys[u] == own or keys[u].startswith(head))
        assert sorted(r["href"] for r in places.under(wanted).collect()) == below
        steps = {}
        for u in below:
            if keys[u] != own:
                step = head + keys[u][len(head) :].split("/")[0]
                n, has = steps.get(step, (0, False))
                steps[step] = n + 1, has or keys[u] == step
        assert {r["place"]: (r["n"], r["own"]) for r in places.children(wanted).collect()} == steps


def rows_scanned(spark, df):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_a_verb_reads_few_row_groups(spark, urls, places):
    assert rows_scanned(spark, places.table) == len(urls)
    assert rows_scanned(spark, places.at("https://h1.example/b/7")) <= len(urls) / 2
    assert rows_scanned(spark, places.under("https://h1.example/b/7")) <= len(urls) / 2
    assert rows_scanned(spark, places.at("https://h1.example/zz/none")) == 0
