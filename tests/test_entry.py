import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from siteatlas.plans import derived, oracles, structure
from siteatlas.plans.queries import QUERIES

ORACLES = {**oracles.ORACLES, **structure.ORACLES, **derived.ORACLES}
SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert sorted(theirs.columns) == columns
    rows = lambda d: Counter(tuple(map(str, r)) for r in d[columns].values.tolist())
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_imports_without_the_llm_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("siteatlas", "__spark_entry__.py"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else None
    import shutil

    shutil.copytree(f"{root}/siteatlas", tmp_path / "siteatlas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    os.remove(tmp_path / "__spark_entry__.py")
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
