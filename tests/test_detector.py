"""The pattern detector over a stream: confirmation across batches, restart, forgetting, and equality with batch patterns."""

import json
import random

import pytest

from siteatlas.operators import patterns
from siteatlas.streaming.detector import OUTPUT, detect_patterns

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


class Feed:
    """A stream of files; every batch is a run of its own, started from the checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.n = spark, folder, options, 0
        (folder / "in").mkdir(parents=True)

    def send(self, urls):
        (self.folder / "in" / f"{self.n:04}.json").write_text("\n".join(json.dumps({"url": u}) for u in urls))
        self.n += 1
        before = set(self.rows())
        stream = self.spark.readStream.schema("url string").json(str(self.folder / "in"))
        out = detect_patterns(stream, **self.options).writeStream.format("parquet").option("path", str(self.folder / "out"))
        query = out.option("checkpointLocation", str(self.folder / "state")).trigger(once=True).start()
        assert query.awaitTermination(120)
        return {(k, v) for k, _, _, _, v in set(self.rows()) - before}

    def rows(self):
        if not (self.folder / "out" / "_spark_metadata").exists():
            return []
        return [tuple(r) for r in self.spark.read.schema(OUTPUT).parquet(str(self.folder / "out")).collect()]


def test_confirmed_across_batches_and_restarts(spark, tmp_path, rocks):
    feed = Feed(spark, tmp_path)
    both = ["https://h/complex/9223/contacts", "https://h/complex/9224/contacts"]
    assert feed.send(both) == {("confirmed", "complex//contacts"), *(("absorbed", u) for u in both)}
    assert feed.send(["https://h/c/1", "https://h/about", "mailto:x"]) == set()
    got = feed.send(["https://h/complex/12345/contacts", "https://h/unrelated/path", "https://h/c/2", "https://g/c/3"])
    assert got == {("absorbed", "https://h/complex/12345/contacts"), ("absorbed", "https://h/c/2"), ("confirmed", "c/")}


def test_equals_batch_patterns(spark, tmp_path, rocks):
    rng = random.Random(9)
    urls = sorted({f"https://h{rng.randrange(2)}/{rng.choice('ab')}/{rng.choice('xyz')}/{rng.randrange(6)}" for _ in range(60)})
    rng.shuffle(urls)
    feed = Feed(spark, tmp_path, group_strings=True)
    for k in range(0, len(urls), 20):
        feed.send(urls[k : k + 20])
    confirmed = [r for r in feed.rows() if r[0] == "confirmed"]
    assert len(confirmed) == len(set(confirmed))
    rows = patterns.masked(patterns.canonical_urls(spark.createDataFrame([(u,) for u in urls], "url string")))
    assert {(h, v) for _, h, _, _, v in confirmed} == {(r["host"], "/".join(r["mask"])) for r in rows.collect() if any(r["mask"])}


def test_state_is_bounded_and_forgotten(spark, tmp_path, rocks):
    feed = Feed(spark, tmp_path / "a", samples=3)
    feed.send([f"https://h/s/a{k}/x{k}" for k in range(5)])
    assert feed.send(["https://h/s/a0/7"]) == set()  # its partner is no longer among the last three
    feed = Feed(spark, tmp_path / "b", forget_after=1)
    assert len(feed.send(["https://h/p/1", "https://h/p/2"])) == 3
    feed.send(["https://other/q"])  # a later run fires the timer of the first key
    assert feed.send(["https://h/p/3"]) == set()
