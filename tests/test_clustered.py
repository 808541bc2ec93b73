import numpy as np
import pytest

from kiln.operators import clustered, dense


def made(spark, n, dim, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    x = centres[rng.integers(0, groups, n)] + 0.15 * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]  # a tie
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("k", "block"), [(5, 2048), (40, 16)])
def test_rows_of_the_full_search(spark, monkeypatch, k, block):
    monkeypatch.setattr(clustered, "BLOCK", block)
    vectors = made(spark, 600, 16, 12)
    queries = vectors.where("vec_id % 25 = 3")
    clusters = clustered.build(vectors)
    got = clustered.visit(clusters, queries, k)
    assert sorted(map(tuple, got.rows.collect())) == sorted(map(tuple, dense.search(vectors, queries, k).collect()))
    share = got.visited.agg({"n": "sum"}).first()[0] / (600 * queries.count())
    assert clusters.n == 600 and 0 < share <= 1
    if k == 5:
        assert share < 0.5


def test_any_centres_are_right(spark):
    vectors = made(spark, 80, 4, 3)
    for centres, sample in ((1, 10), (80, 80), (5, 7)):
        got = clustered.search(clustered.build(vectors, centres=centres, sample=sample), vectors.limit(20), 100)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dense.search(vectors, vectors.limit(20), 100).collect()))


def test_empty(spark):
    none = made(spark, 10, 4, 2).where("size(embedding) = 0")
    assert clustered.search(clustered.build(none), made(spark, 10, 4, 2)).collect() == []
    assert clustered.search(clustered.build(made(spark, 10, 4, 2)), none).collect() == []
