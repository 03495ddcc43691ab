"""A stored crawl, stopped anywhere, against one run."""

import random

import pytest

from siteatlas.operators.crawl import CrawlOptions, crawl
from siteatlas.operators.resume import IN_ORDER, StoredCrawl
from siteatlas.sources.tables import setting


def site(spark, n=60):
    """A site whose pages link a few others, some twice, one outside, one missing."""
    rng = random.Random(12)
    rows = []
    for k in range(n):
        targets = [f"/p/{rng.randrange(n)}?x={rng.randrange(2)}#{k}" if rng.random() < 0.2 else f"/p/{min(n - 1, k + rng.randrange(1, 9))}" for _ in range(3)]
        html = "".join(f'<a href="{t}">t</a>' for t in [*targets, targets[0], "https://other.example/x", "/missing"])
        rows.append((f"https://h.example/p/{k}", 200, "application/json" if k % 9 == 4 else "text/html", html))
    return spark.createDataFrame(rows, "url string, status int, content_type string, body string")


def rows_of(result):
    return {k: sorted(map(str, t.select(sorted(t.columns)).collect())) for k, t in result.items()}


def stored(spark, folder, options):
    return StoredCrawl(spark, f"file://{folder}", "https://h.example/p/0", options, buckets=3, fan=2)


@pytest.mark.parametrize("options", [CrawlOptions(max_depth=6), CrawlOptions(max_depth=9, request_limit=17)], ids=["deep", "limited"])
def test_stopped_and_continued_is_one_run(spark, tmp_path, options):
    responses = site(spark)
    want = rows_of(crawl(responses, "https://h.example/p/0", options))
    more, n = True, 0
    while more:
        more = stored(spark, tmp_path, options).advance(responses, levels=2)  # a new state each time, from the folder alone
        n += 1
    assert n > 1 and len(want["pages"]) > 10
    state = stored(spark, tmp_path, options)
    assert rows_of(state.result(responses)) == want
    assert not state.advance(responses) and rows_of(state.result(responses)) == want
    if not options.request_limit:
        assert len(state.runs()) <= 3  # compacted
        assert state.is_queued(["https://h.example/p/1", "https://h.example/none", "https://h.example/p/0"]) >= {"https://h.example/p/0"}


def test_a_level_that_was_stopped_is_done_again(spark, tmp_path):
    options = CrawlOptions(max_depth=4)
    responses = site(spark)
    want = rows_of(crawl(responses, "https://h.example/p/0", options))
    stored(spark, tmp_path, options).advance(responses, levels=3)
    (tmp_path / "level-2" / "frontier" / "_SUCCESS").unlink()  # as if the job had ended before
    state = stored(spark, tmp_path, options)
    assert state.levels == 2
    state.advance(responses)
    assert rows_of(state.result(responses)) == want


def test_runs_stay_in_their_buckets(spark, tmp_path):
    options = CrawlOptions(max_depth=3)
    state = stored(spark, tmp_path, options)
    state.fan = 9
    state.advance(site(spark))
    before = spark.sql("SHOW TABLES").count()
    with setting(spark, IN_ORDER, "true"):
        plan = state.new_urls(spark.createDataFrame([("u",)], "url string"), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and plan.count("Sort [") == 1 and spark.sql("SHOW TABLES").count() == before


def test_nothing_to_fetch(spark, tmp_path):
    state = stored(spark, tmp_path, CrawlOptions())
    none = site(spark).limit(0)
    assert not state.advance(none) and state.result(none) == {}
