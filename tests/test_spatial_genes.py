"""Spatially variable genes against numpy, and planted patterns against shuffled ones."""

import numpy as np
import pytest

from lattica.operators import graph, spatial_genes as sg

from .test_spatial import make_cells


def smooth(x, pairs, t):
    a = np.zeros((len(x), len(x)))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    d = a.sum(axis=1)
    s = 1 / np.sqrt(np.maximum(d, 1))
    values, vectors = np.linalg.eigh(np.diag((d > 0) * 1.0) - s[:, None] * a * s)
    f = x - x.mean()
    return (np.exp(-t * values) * (vectors.T @ f) ** 2).sum() / (f @ f)


def test_shares_equal_numpys_and_patterns_come_first(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((150, 2))
    patterns = np.stack([np.sin(6 * xy[:, 0]), xy[:, 1] > 0.5, np.hypot(*(xy - 0.5).T)], axis=1) + 0.3 * rng.normal(size=(150, 3))
    genes = np.concatenate((patterns, rng.permuted(patterns, axis=0), np.ones((150, 1))), axis=1)
    expr = spark.createDataFrame([(i, j, float(genes[i, j])) for i in range(150) for j in range(7)], "cell_id long, gene_id int, value double")
    edges = graph.knn_graph(make_cells(spark, xy), 5).where("src <> 7 and dst <> 7").select("src", "dst").persist()
    got = {r.gene_id: r for r in sg.spatially_variable(expr, edges, 3, t=3.0, steps=12).collect()}
    pairs = [tuple(r) for r in edges.collect()]
    for j in range(6):
        assert got[j].share == pytest.approx(smooth(genes[:, j], pairs, 3.0), abs=1e-7)
        assert got[j].energy == pytest.approx(((genes[:, j] - genes[:, j].mean()) ** 2).sum())
    assert {j for j in got if got[j].spatially_variable} == {0, 1, 2} and got[6].share is None and got[6].rank == 7
    names = spark.createDataFrame([(j, f"g{j}") for j in range(7)], "gene_id int, gene_name string")
    chosen = sg.selected(names, names.where("gene_id in (4, 5)"), names.where("gene_id in (5, 6)"))
    assert {r.gene_id for r in chosen.collect()} == {4, 5, 6}


def test_a_small_space_is_used_up(spark):
    """Three cells in a row and one apart: a gene's space ends after three steps, and the share is exact."""
    x = np.array([1.0, 2.0, 4.0, -3.0])
    expr = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x.tolist())], "cell_id long, gene_id int, value double")
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src long, dst long")
    assert sg.smooth_share(expr, edges, 2.0, 20).first().share == pytest.approx(smooth(x, [(0, 1), (1, 2)], 2.0), abs=1e-12)
    assert sg.smooth_share(expr.limit(0), edges).count() == 0
