import numpy as np
import pytest

from covenant.llm import topk_search as T


def brute(rows, k, step=20):
    good = [(i, [np.floor(64 * np.float64(c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in good), default=0)
    x = [(i, [*map(int, v)] + [0] * (dim - len(v))) for i, v in good]
    out = set()
    for q, v in {i: min(w for j, w in x if j == i) for i, _ in x if i % step == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in x if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def got(df, k, **more):
    rows = T.usable(df)
    out = [tuple(r) for r in T.search(rows, rows.filter("id % 20 = 0"), k, **more).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got(df, 20) == brute(rows, 20)


@pytest.mark.parametrize("rows", [1, 7, 64])
def test_small_annuli_ties_and_odd_vectors(spark, monkeypatch, rows):
    monkeypatch.setattr(T.indexed, "__defaults__", (rows,))
    monkeypatch.setattr(T, "QUERY_ROWS", 3)
    monkeypatch.setattr(T, "TILE_ROWS", 7)
    monkeypatch.setattr(T, "SHARD_ANNULI", 5)
    rng = np.random.default_rng(4)
    data = [(int(i), [float(c) for c in rng.integers(-2, 3, 3) / 4]) for i in range(300)]
    data += [(400, None), (420, [1.0, None, 0.0]), (440, [float("nan"), 0.0, 1.0]), (460, [float("inf"), 0.0, 1.0]), (480, [1.0]), (500, []), (None, [1.0, 1.0, 1.0])]
    data += [(i, [0.5, 0.5, 0.5]) for i in range(600, 800)]  # a third is one vector
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, id string")
    assert got(df, 5, pivots=4, sample=32) == brute(data, 5)


def test_large_components_stay_exact(spark):
    data = [(i, [float(i * 200_003), 1e6 + i]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert got(df, 3) == brute(data, 3)


def test_empty_and_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert got(spark.createDataFrame([], schema), 20) == set()
    assert got(spark.createDataFrame([(0, [1.0]), (3, [2.0])], schema), 20) == {(0, 1, 3, 64 * 128)}
    assert got(spark.createDataFrame([(0, [1.0])], schema), 20) == set()


def test_one_tile_and_many(spark, monkeypatch):
    """Queries in one tile, or in tiles of one block, find the same."""
    rng = np.random.default_rng(6)
    data = [(i, [float(c) for c in rng.normal(i % 5, 0.3, 4)]) for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    monkeypatch.setattr(T.indexed, "__defaults__", (16,))
    exp = brute(data, 6)
    assert got(df, 6) == exp
    monkeypatch.setattr(T, "QUERY_ROWS", 2)
    monkeypatch.setattr(T, "TILE_BYTES", 1)
    assert got(df, 6) == exp
