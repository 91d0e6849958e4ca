"""The mixture's hierarchical start against a plain search, planted clusters of unequal size, and EM's log-likelihood."""

import numpy as np
import pytest

from lattica.operators import cluster


def plain_merges(x, groups):
    """The same clustering, every determinant worked out."""
    parts = [[i] for i in range(len(x))]
    start = np.eye(x.shape[1]) * ((x - x.mean(axis=0)) ** 2).sum() / x.size
    scatter = lambda rows: (x[rows] - x[rows].mean(axis=0)).T @ (x[rows] - x[rows].mean(axis=0))
    while len(parts) > groups:
        best = None
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                after = [p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] + parts[j]]
                d = np.linalg.det(start + sum(scatter(p) for p in after))
                if best is None or d < best[0] * (1 - 1e-12):
                    best = (d, i, j)
        _, i, j = best
        parts[i] += parts.pop(j)
    return {frozenset(p) for p in parts}


@pytest.mark.parametrize("seed", [0, 1])
def test_merges_by_determinant(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(18, 2)) @ np.diag([5, 0.3]) + rng.integers(0, 3, (18, 1)) * np.array([0, 3.0])
    got = cluster.determinant_merges(x, 3)
    assert {frozenset(np.flatnonzero(got == g).tolist()) for g in range(3)} == plain_merges(x, 3)
    assert set(cluster.determinant_merges(np.ones((4, 2)), 2)) == {0, 1} and len(set(cluster.determinant_merges(x[:2], 5))) == 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unequal_clusters_whatever_the_seed(spark, seed):
    """Long parallel clusters of 500, 120 and 30 cells, which distances alone would cut across."""
    rng = np.random.default_rng(9)
    truth = np.repeat([0, 1, 2], [500, 120, 30])
    x = rng.normal(size=(650, 3)) @ np.diag([20, 0.5, 1]) + truth[:, None] * np.array([0, 5.0, 0]) + 1e5
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, pc array<double>").persist()
    got = {r.cell_id: r.label for r in cluster.gaussian_mixture(e, 3, seed=seed).collect()}
    assert np.mean([got[i] == truth[i] for i in range(650)]) > 0.995
    if seed == 1:
        trace = cluster.fit_mixture(e, 4, rounds=15, tol=-1.0)[3]
        assert len(trace) == 15 and np.all(np.diff(trace) > -1e-6 * abs(trace[0]))
    e.unpersist()


def test_few_rows(spark):
    e = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "cell_id long, pc array<double>")
    assert cluster.gaussian_mixture(e, 4).count() == 2 and cluster.gaussian_mixture(e.limit(0), 4).count() == 0
