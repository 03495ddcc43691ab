"""op13: top-k by integer inner product against all products, with ties, copies and every sort of bad vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import siteatlas.llm.inner_products as ip
from siteatlas.llm.inner_products import top_k
from siteatlas.llm.queries import op13_inner_products

SCHEMA = "vec_id long, embedding array<float>, label int, row long, id long, query string, norm double, vector int"


def frame(spark, rows):
    """The rows with columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, None, 1, 2, "q", 0.5, 3) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k):
    good = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for n, (i, v) in enumerate(good):
        if i % 100 == 0:
            scores = sorted(((-int(v @ w), j) for m, (j, w) in enumerate(good) if m != n))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def vectors(n=900, width=12, seed=4):
    rng = np.random.default_rng(seed)
    lengths = rng.lognormal(0, 1, n)
    m = rng.normal(size=(n, width)) * rng.geometric(0.3, width) * lengths[:, None] / 8
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    hot = [float(x) for x in m[7]]
    rows += [(2000 + i, hot) for i in range(400)]  # a third of the rows: one vector, ids that are queries among them
    rows += [(5000, None), (5100, [None] + [0.5] * 11), (5200, [float("nan")] * 12), (5300, [float("inf")] + [0.1] * 11)]
    rows += [(5400, []), (5500, [0.5]), (5600, [0.0] * 12), (None, [1.0] * 12), rows[100], rows[200], rows[200]]
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks small enough for several rounds of several blocks."""
    monkeypatch.setattr(ip, "BLOCK", 64)
    monkeypatch.setattr(ip, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ip, "GROWTH", 3)


def test_all_products(spark, small_blocks):
    rows = vectors()
    out = top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, k=10)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect())) == plain(rows, 10)


def test_query_over_its_table(spark, tmp_path):
    rows = vectors(300, 9, 8)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(map(tuple, op13_inner_products(spark, str(tmp_path)).collect())) == plain(rows, 10)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, -2.0]), (100, [0.5, 0.5]), (3, [0.1, 0.1])]
    assert sorted(map(tuple, top_k(frame(spark, rows), F.col("vec_id") % 100 == 0).collect())) == plain(rows, 10)
    assert top_k(frame(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert top_k(frame(spark, [(5, None)]), F.col("vec_id") % 100 == 0).count() == 0


def test_products_beyond_doubles():
    """Scores above 2 ** 53 are added in integers."""
    rng = np.random.default_rng(2)
    m = rng.integers(-(1 << 29), 1 << 29, (6, 8))
    norm = np.sqrt((m.astype(float) ** 2).sum(axis=1))
    row = {"row": np.arange(6).tobytes(), "id": np.arange(6).tobytes(), "norm": norm.tobytes(), "floor": np.full(6, -np.inf).tobytes(), "vector": ip.narrow(m).tobytes(), "kind": ip.narrow(m).dtype.str}
    b = ip.Block(row, 8, np.eye(8))
    q, x, score = ip.best_of(b, b, 3)
    for a, c, s in zip(q, x, score, strict=True):
        assert s == int(m[a].astype(object) @ m[c].astype(object))
    assert len(q) == 18


def test_most_of_a_block_is_ruled_out_early(spark):
    """With a floor near the best, few pairs reach the exact products."""
    rng = np.random.default_rng(1)
    m = np.floor(1024 * rng.normal(size=(500, 32)) * 0.8 ** np.arange(32)).astype(np.int64)
    norm = np.sqrt((m.astype(float) ** 2).sum(axis=1))
    floor = np.sort(m @ m.T, axis=1)[:, -11].astype(float)
    row = {"row": np.arange(500).tobytes(), "id": np.arange(500).tobytes(), "norm": norm.tobytes(), "floor": floor.tobytes(), "vector": ip.narrow(m).tobytes(), "kind": ip.narrow(m).dtype.str}
    b = ip.Block(row, 32, np.linalg.eigh((m.T @ m).astype(float))[1][:, ::-1])
    seen = []
    real = ip.products
    ip.products = lambda q, x, pairs: (seen.append(len(pairs[0])), real(q, x, pairs))[1]
    try:
        ip.best_of(b, b, 10)
    finally:
        ip.products = real
    assert seen[0] < 500 * 500 / 8
