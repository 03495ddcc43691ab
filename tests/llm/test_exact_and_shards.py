import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from siteatlas.llm.common import runs_in_order
from siteatlas.llm.exact_dedup import digests, drop_exact_duplicates, exact_dedup, merge_runs, sorted_runs, tree_merge
from siteatlas.llm.sharding import shard_by_bytes
from tests.llm.corpora import SCHEMA, documents, frame, lower


def test_exact_dedup_matches_brute_force(spark):
    rows = documents()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted(
        (str(i), str(keep[lower(t)]), len(groups[lower(t)]), i == keep[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest())
        for i, t in rows
    )
    for runs in (1, 2, 5):
        found = exact_dedup(frame(spark, rows), runs=runs).collect()
        assert sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in found) == expected


def test_merge_walks_along_sorted_runs(spark):
    """Both runs are read in order from their buckets: no sort, no exchange, no hash, and no table is left in the catalog."""
    before = spark.sql("SHOW TABLES").count()
    table = digests(frame(spark, documents())).withColumn("run", F.col("run") % 3)
    runs = sorted_runs(table, "largest", 3)
    with runs_in_order(spark):
        plan = merge_runs(runs[0], runs[1], "largest")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan and "HashAggregate" not in plan
    rows = tree_merge(runs, "largest").collect()
    assert len(rows) == len({r.text_sha256 for r in rows}) == table.select("text_sha256").distinct().count()
    assert sum(r.group_size for r in rows) == table.count()
    assert spark.sql("SHOW TABLES").count() == before


def test_smallest_can_stay(spark):
    found = exact_dedup(frame(spark, [(3, "a"), (1, "A"), (2, "b")]), keep="smallest").collect()
    assert {r.doc_id: r.keep_id for r in found} == {3: 1, 1: 1, 2: 2}


def test_drop_keeps_columns_and_one_of_repeated_rows(spark):
    docs = frame(spark, [(1, "a"), (2, "A"), (2, "A"), (3, None), (4, ""), (2, "other")])
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "A"), (2, "other"), (4, "")]


def test_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(900)]
    found = exact_dedup(frame(spark, rows)).where("group_size > 1").collect()
    assert len(found) == 600 and {r.keep_id for r in found} == {899}


def test_shards_match_brute_force(spark):
    rows = documents()
    found = shard_by_bytes(frame(spark, rows), shards=8).collect()
    order = sorted(
        ((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    )
    total, before, shards = sum(o[2] for o in order), 0, []
    for o in order:
        shards.append(min(7, 8 * (2 * before + o[2]) // (2 * total)))
        before += o[2]
    expected, slots = [], defaultdict(int)
    for (has, i, size, crc), s in zip(order, shards, strict=True):
        expected.append((str(i if has else None), size, crc, "bytes", s, slots[s], None))
        slots[s] += 1
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(expected)


def test_shards_are_balanced(spark):
    rows = [(i, "x" * (i % 50)) for i in range(4000)]
    found = shard_by_bytes(frame(spark, rows), shards=8).collect()
    sizes = defaultdict(int)
    for r in found:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(none).collect() == [] and shard_by_bytes(none).collect() == []
    assert drop_exact_duplicates(none).collect() == []
