"""Pages of one URL with different texts, and pages that are alike in both, against the SQL of the queries."""

from collections import Counter

import duckdb
import pytest

from siteatlas.plans import derived, oracles, structure
from siteatlas.plans.queries import QUERIES

ORACLES = {**oracles.ORACLES, **structure.ORACLES, **derived.ORACLES}
SF = "/root/testdata/sf0.001"
NAMES = ["bracketed_urls", "dom_children", "reference_positions", "tagged_resources"]


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    """The pages, twenty of them with another page's text besides, five a second time as they are."""
    folder, con = tmp_path_factory.mktemp("pages"), duckdb.connect()
    con.execute(f"""create table pages as with p as (select * from '{SF}/pages.parquet'), n as (select *, row_number() over (order by page_id) as n from p)
      select * from p union all select a.page_id + 1000000, a.url, b.html from n a join n b on b.n = a.n + 1 where a.n <= 20
      union all select page_id + 2000000, url, html from n where n > 20 and n <= 25""")
    con.execute(f"copy pages to '{folder}/pages.parquet' (format parquet)")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    folder, con = duck
    ours = QUERIES[name](spark, str(folder))
    columns = sorted(ours.columns)
    theirs = con.execute(ORACLES[name])
    at = [[d[0] for d in theirs.description].index(c) for c in columns]
    want = Counter(tuple(str(r[i]) for i in at) for r in theirs.fetchall())
    assert Counter(tuple(str(r[c]) for c in columns) for r in ours.collect()) == want
