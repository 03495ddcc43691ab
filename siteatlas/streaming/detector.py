"""Pattern detection over a stream of URLs, with typed state for each family of URLs.

URLs can share a pattern only if they have the host, the number of segments and
the first literal in common, so these are the key: a busy host is many keys.
State of a key: a list of the last unconfirmed and confirmed samples, bounded,
and a map of the confirmed shapes with the time of their last hit.  A timer of
a key forgets shapes and samples that nothing has hit for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteatlas.operators.patterns import canonical_urls
from siteatlas.streaming.incremental import SAMPLES, SLOT, fits, shapes

OUTPUT = "kind string, host string, n int, bucket string, value string"


class Detector(StatefulProcessor):
    """Rows of kind ``absorbed`` (a URL of the batch that a confirmed shape fits) and ``confirmed`` (a new shape).

    A shape is the path with empty segments for slots.  It is confirmed once,
    with ``min_count`` members among the last ``samples`` URLs of its key, and
    stays so until ``forget_after`` milliseconds (0: never) pass without a hit.
    """

    def __init__(self, min_count: int, group_strings: bool, samples: int, forget_after: int):
        self.min_count, self.group_strings = min_count, group_strings
        self.most, self.forget_after = samples, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "path string")
        self.confirmed = handle.getMapState("confirmed", "mask string", "hit long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.forget_after else 0
        new: dict[str, str] = {}
        for batch in rows:
            new.update(zip(batch["canonical"], (SLOT.join(s) for s in batch["segs"]), strict=True))
        recent = [r[0] for r in self.samples.get()] if self.samples.exists() else []
        recent = [*recent, *new.values()][-self.most :]
        self.samples.put([(p,) for p in recent])
        known = {m[0] for m, _ in self.confirmed.iterator()}
        fresh = sorted({SLOT.join(m) for m in shapes([p.split(SLOT) for p in recent], self.min_count, self.group_strings)} - known)
        hit: dict[str, None] = dict.fromkeys(fresh)
        absorbed = []
        masks = [(m, m.split(SLOT)) for m in [*sorted(known), *fresh]]
        for url, path in new.items():
            fitting = [m for m, split in masks if fits(split, path.split(SLOT))]
            if fitting:
                absorbed.append(url)
                hit.update(dict.fromkeys(fitting))
        for m in hit:
            self.confirmed.updateValue((m,), (now,))
        if self.forget_after:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + self.forget_after)
        yield self.rows(key, [*(("confirmed", m.replace(SLOT, "/")) for m in fresh), *(("absorbed", u) for u in absorbed)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The key was silent for ``forget_after``: its samples and shapes go."""
        self.samples.clear()
        self.confirmed.clear()
        yield self.rows(key, [])

    @staticmethod
    def rows(key, found: list[tuple[str, str]]) -> pd.DataFrame:
        host, n, bucket = key
        out = pd.DataFrame(found, columns=["kind", "value"], dtype=object)
        return out.assign(host=host, n=n, bucket=bucket).astype({"n": "int32"})[["kind", "host", "n", "bucket", "value"]]

    def close(self) -> None:
        pass


def detect_patterns(
    urls: DataFrame, min_count: int = 2, group_strings: bool = False, samples: int = SAMPLES, forget_after: int = 0
) -> DataFrame:
    """(kind, host, n, bucket, value) as described at :class:`Detector`; ``urls`` is a stream with a column url.

    Needs the RocksDB state store.  A URL without a usable path gives no row; a
    URL that repeats within a batch is one.  Keys that nothing feeds hold
    ``samples`` paths at most, and the shapes that these confirmed.
    """
    rows = canonical_urls(urls) if not urls.isStreaming else streamed(urls)
    return rows.groupBy("host", "n", "bucket").transformWithStateInPandas(
        Detector(min_count, group_strings, samples, forget_after), OUTPUT, "Append", "ProcessingTime" if forget_after else "None"
    )


def streamed(urls: DataFrame) -> DataFrame:
    """The rows of :func:`canonical_urls` for a stream, repeats included: what is distinct is settled by the state."""
    from pyspark.sql import functions as F

    from siteatlas.functions import classify, url

    c = urls.select(url.canonical(F.col("url")).alias("canonical")).where("canonical is not null")
    rows = c.select("canonical", url.host(F.col("canonical")).alias("host"), url.segments(F.col("canonical")).alias("segs"))
    first = F.get("segs", F.lit(0))
    typed = classify.segment_kind(first).isin("int", "uuid", "hash", "base64")
    return rows.where("segs is not null").select("canonical", "host", "segs", F.size("segs").alias("n"), F.when(typed, "").otherwise(first).alias("bucket"))
