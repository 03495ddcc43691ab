"""The registered queries that have SQL, against DuckDB on the same tables."""

from collections import Counter

import duckdb
import pytest

from siteatlas.llm.oracles import ORACLES
from siteatlas.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = duck.execute(ORACLES[name])
    at = [[d[0] for d in theirs.description].index(c) for c in columns]
    assert Counter(tuple(str(r[i]) for i in at) for r in theirs.fetchall()) == Counter(tuple(str(r[c]) for c in columns) for r in ours.collect())
