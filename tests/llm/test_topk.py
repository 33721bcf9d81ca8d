"""The M-tree walk by itself: exact on drawn and clustered vectors, and pages are left out where clusters allow it."""

import numpy as np
import pytest

from veilwork.llm import topk


def walk(exact, asked, own, k=5, bound=None):
    ids = [[i] for i in range(len(exact))]
    top = float((exact ** 2).sum(1).max())
    slack = 1e-6 * (1 + np.sqrt(max(top, float((asked ** 2).sum(1).max()))))
    points = np.hstack([exact.astype(float), np.sqrt(np.maximum(top - (exact ** 2).sum(1), 0))[:, None]])
    bound = np.full(len(asked), topk.LEAST) if bound is None else bound
    best = topk.Best(asked, own, bound, k, top, slack)
    done = topk.search(topk.build(points, slack, np.random.default_rng(1)), exact, ids, best)
    got = [[] for _ in asked]
    for q, s, i in zip(best.query, best.score, best.id):
        got[q].append((-s, i))
    return [sorted(g) for g in got], done / (len(asked) * len(exact))


def plain(exact, asked, own, k=5):
    scores = asked @ exact.T
    return [sorted((-s, i) for i, s in enumerate(row) if i != o)[:k] for row, o in zip(scores, own)]


@pytest.mark.parametrize("spread,share", [(0.02, 0.25), (1.0, 1.0)])
def test_walk_is_exact_and_leaves_out_pages_of_other_clusters(spread, share):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    x = centers[rng.integers(0, 40, 8000)] + spread * rng.normal(size=(8000, 16)) / 4
    exact = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    own = np.arange(0, 8000, 50)
    got, computed = walk(exact, exact[own], own)
    assert got == plain(exact, exact[own], own)
    assert computed <= share


def test_equal_vectors_few_rows_and_long_queries():
    own = np.arange(3)
    same = np.full((700, 4), 7)
    assert walk(same, same[:3], own)[0] == plain(same, same[:3], own)
    few = np.array([[1, 2], [3, 4], [-5, 6]])
    assert walk(few, few, own)[0] == plain(few, few, own)
    far = few * 100_000
    assert walk(few, far, own)[0] == plain(few, far, own)


def test_rows_below_a_true_bound_never_matter():
    rng = np.random.default_rng(4)
    x = rng.integers(-128, 128, (3000, 8))
    own = np.arange(0, 3000, 100)
    want = plain(x, x[own], own)
    bound = np.array([-w[-1][0] for w in want])
    assert walk(x, x[own], own, bound=bound)[0] == want


def test_extra_columns_may_have_any_name(spark):
    rows = [(i, [float(i % 7), 1.0], 1, 2, 3, 4, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, v int, s int, rank int, `a.b` string")
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).groupBy("query_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 5), (50, 5)]
