from collections import Counter

import duckdb
import pytest

from tests.goldens import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_literal_rows(spark, name):
    ours = QUERIES[name](spark, "").toPandas()
    theirs = duckdb.sql(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert sorted(theirs.columns) == columns
    rows = lambda d: Counter(tuple(map(str, r)) for r in d[columns].values.tolist())
    assert rows(ours) == rows(theirs)
