import hashlib
from collections import defaultdict

from siteatlas.llm.common import runs_in_order
from siteatlas.llm.line_dedup import LineRuns, batches_of, dedup_lines, long_lines
from tests.llm.corpora import SCHEMA, documents, frame, lower


def brute(rows, least=5):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        owner = lambda k: max((x for x in holders[k] if x is not None), default=None)
        kept = [x for x in lines if len(holders[key(x)]) < least or owner(key(x)) == i]
        text = "\n".join(kept)
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    rows = documents() + [(900 + i, f"{'z' * 39}\n  {'Z' * 40}\t\nend") for i in range(6)]
    for batches, fan in ((1, 2), (4, 2), (5, 3)):
        found = dedup_lines(frame(spark, rows), batches=batches, fan=fan).collect()
        got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in found)
        assert got == brute(rows)


def test_runs_are_levelled_and_fresh_keys_have_an_owner(spark):
    runs = LineRuns(fan=2)
    for k in range(3):
        rows = [(100 - 10 * k - j, "y" * (50 + j % (k + 1))) for j in range(4)]
        runs.add(long_lines(frame(spark, rows), 40))
    assert [len(level) for level in runs.levels] == [1, 1]
    found = {r.n_docs: r.owner for r in runs.keys().collect()}
    assert sum(found) == 12 and max(x for x in found.values()) == 100


def test_many_dropped_lines_in_one_document(spark):
    line = ["the same long line over and over again, number %d" % (k % 7) for k in range(20000)]
    rows = [(i, "\n".join(line[: 7 if i < 9 else 20000])) for i in range(10)] + [(20, "\n".join(line[:7]))]
    found = {r.doc_id: r for r in dedup_lines(frame(spark, rows)).collect()}
    assert found[9].n_dropped == 20000 and found[9].kept_text == "" and found[20].n_dropped == 0


def test_runs_are_read_in_order(spark):
    """A merge-anti-join sorts the batch alone, a compaction nothing; no table is left in the catalog."""
    before = spark.sql("SHOW TABLES").count()
    runs = LineRuns(fan=4)
    for k in range(2):
        runs.add(long_lines(frame(spark, [(100 - 10 * k - j, "y" * (50 + j)) for j in range(4)]), 40))
    with runs_in_order(spark):
        plan = runs.keys()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan
    assert spark.sql("SHOW TABLES").count() == before


def test_ids_of_text(spark):
    rows = [(None if i is None else f"d{i:05}", t) for i, t in documents()] + [(f"d{900 + i:05}", "z" * 45) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for batches in (1, 4):
        found = dedup_lines(docs, batches=batches).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in found) == brute(rows)
    assert batches_of(docs, 4).select("batch").distinct().count() > 1


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
