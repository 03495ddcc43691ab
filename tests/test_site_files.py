"""Folders of text: files equal to their rows, and nothing left of a job that fails."""

import json

import pytest
from pyspark.sql import functions as F

from siteatlas.operators import fold
from siteatlas.operators.extract import extract_links, with_resolved
from siteatlas.plans.session import Report
from siteatlas.sources.site_files import graph_lines, read_files, report_lines, save_graph, save_report, write_files
from siteatlas.sources.snapshot import Snapshot


@pytest.fixture(scope="module")
def links(spark):
    pages = [(f"https://h/{k}", "".join(f'<a href="/p/{k * 7 + j}?q={j}">x</a>' for j in range(7)) + '<a href="/api/v1/x">y</a><script src="/s.js"></script>') for k in range(60)]
    found = with_resolved(extract_links(spark.createDataFrame(pages, "url string, body string")))
    return found.withColumn("param_variants", F.array().cast("array<string>")).cache()


def test_files_equal_rows(spark, links, tmp_path):
    folder = f"file://{tmp_path}/graph"
    save_graph(links, folder)
    nodes = [tuple(map(str, r)) for r in fold.visual_nodes(links).collect()]
    got = [json.loads(x) for x in read_files(spark, folder, "nodes.jsonl")]
    assert [n["id"] for n in got] == sorted(n["id"] for n in got) and len(got) == len(nodes) > 400
    assert {n["id"] for n in got} == {n[0] for n in nodes}
    assert len(read_files(spark, folder, "edges.jsonl")) == fold.visual_edges(links).count()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["graph"]


def test_whole_report(spark, links, tmp_path):
    folder = f"file://{tmp_path}/report"
    save_report(links, folder)
    pages = read_files(spark, folder, "pages.md")
    keys = links.where("category = 'web-page'").select("resolved").distinct().count()
    assert pages[0] == "# Pages" and len(pages) == keys + 1 > 201 and pages[1:] == sorted(pages[1:])
    assert read_files(spark, folder, "api.md") == ["# API", "- https://h/api/v1/x (https://h/0)"]
    assert read_files(spark, folder, "assets.md") == ["# Assets", "- https://h/s.js (https://h/0)"]
    readme = read_files(spark, folder, "README.md")
    assert readme[:2] == ["# Site", "- API: 60"] and sum(x.startswith("## ") for x in readme) == 60
    assert len(readme) == report_lines(links).where("file = 'README.md'").count()


def test_a_failed_task_leaves_nothing(spark, links, tmp_path):
    bad = graph_lines(links).withColumn("line", F.when(F.col("order").endswith("_41_q_1"), F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("line")))
    bad = bad.withColumn("line", F.when(F.rand() >= 0, F.col("line")))  # evaluated in the tasks that write
    bad = bad.unionByName(bad.limit(1).withColumn("line", F.raise_error(F.lit("no")).cast("string")))
    with pytest.raises(Exception, match="no"):
        write_files(bad, f"file://{tmp_path}/graph")
    assert list(tmp_path.iterdir()) == []


def test_a_folder_is_kept_unless_told(spark, tmp_path):
    rows = lambda text: spark.createDataFrame([("a.md", 1, text), ("a.md", 2, None)], "file string, order int, line string")
    folder = f"file://{tmp_path}/out"
    write_files(rows("one"), folder)
    with pytest.raises(Exception, match="out"):
        write_files(rows("two"), folder)
    assert read_files(spark, folder, "a.md") == ["one", ""]
    write_files(rows("two"), folder, overwrite=True)
    assert read_files(spark, folder, "a.md") == ["two", ""]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    write_files(rows("x").limit(0), f"file://{tmp_path}/none")
    assert list((tmp_path / "none").iterdir()) == []


def test_lines_under_a_budget(spark, links):
    sections = [("a", links.select("href")), ("b", links.select("tag"))]
    report = Report(Snapshot({"links": links}), [], everything=True, limit=30)
    rows = report.lines(sections).orderBy("nth").collect()
    assert [r.nth for r in rows] == list(range(31)) and rows[-1].line == f"... {2 * links.count() - 30} more lines"
    whole = Report(Snapshot({"links": links}), [], everything=True).lines(sections).orderBy("nth").collect()
    assert [r.line for r in whole[:30]] == [r.line for r in rows[:30]] and len(whole) == 2 * links.count()
    assert [r.section_no for r in whole] == sorted(r.section_no for r in whole)
